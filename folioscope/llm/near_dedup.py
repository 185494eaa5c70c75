"""Near duplicates by bottom-k sketches, with every link confirmed on full shingle sets.

One hash function orders all shingles; a document's sketch is the lowest
``SKETCH`` of its set. Equal sets are one node from the start.

1. Inverted lists of retained values. Two sets that are alike share at least
   ``SHARED`` of their retained values, so with each sketch ordered by how
   many sketches hold a value, rarest first, a common value lies among the
   first ``SKETCH - SHARED + 1``. Only those are listed; a value that no other
   sketch holds needs no list. Passages in very many texts come last.
2. Overlaps of the members of a list give the sketch of their union and an
   estimate. Pairs far below the threshold go; the others form families, of
   which a list gives a spanning forest.
3. Inside a family full sets are compared, except for pairs already known to be
   connected, and a spanning forest of the confirmed links is kept.

Lists and families beyond a block's size are cut into blocks and each pair of
blocks is compared in a task of its own, so no group is held in one task and
no pair is left out. The chance that step 1 or 2 misses a pair just at the
threshold is that of a binomial tail, about one in 100,000; copies need none of
it.

A NULL or empty text, or one of white space, has an empty set and no links.
Rows with equal text are linked. Repeated rows stay. A NULL ``doc_id`` stays,
and counts as a component's smallest only if there is no other; ids only label
rows, which are told apart by a hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_slices, worker_cache, written
from .components import connected_components
from .shingles import shingle_set

SKETCH = 64
#: Chance that two sets just at the threshold share fewer retained values than is asked for.
MISS = 5e-6
LIST_ROWS, BLOCK_ELEMENTS = 1_000, 1_500_000


def _node(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64)))


def shared_part(percent: int) -> float:
    """The part of its retained values that a set shares with one at the threshold, but for the chance ``MISS``."""
    p, below, least = percent / 100, 0.0, 0
    while least < SKETCH:
        below += math.comb(SKETCH, least) * p**least * (1 - p) ** (SKETCH - least)
        if below > MISS:
            break
        least += 1
    return least / SKETCH


def _texts(documents: DataFrame) -> DataFrame:
    """Ids and texts with a hash of the text, which tells rows apart that share an id or have none."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """Size of the shingle set, a hash of the whole set and its lowest values."""

    def work(columns: list[list]) -> list[list]:
        sizes, nodes, lows = [], [], []
        for text in columns[2]:
            s = shingle_set(text, width)
            sizes.append(len(s))
            nodes.append(_node(s))
            lows.append(s[:SKETCH].view(np.int64))
        return [*columns[:2], sizes, nodes, lows]

    return map_slices(
        _texts(documents), work, "doc_id bigint, text_hash bigint, n bigint, node bigint, sketch array<bigint>"
    )


def _listed(distinct: DataFrame, share: float) -> DataFrame:
    """For each sketch the values under which it is listed."""
    values = distinct.select("node", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
    ordered = values.join(shared, "value").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("common")
    )
    size = F.size("sketch")
    # Values of one holder come first in the order and need no list.
    wanted = size - F.ceil(size * share) + 1 - (size - F.size("common"))
    return distinct.join(ordered, "node").filter(wanted > 0).select(
        "node", "n", "sketch", F.slice("common.value", F.lit(1), F.least(wanted, F.size("common")).cast("int")).alias("values")
    )


def block_pairs(key: str, blocks: F.Column, node: str = "node"):
    """Columns for the pairs of blocks that a row of a cut group goes to."""
    mine = F.pmod(F.xxhash64(node, F.lit(7)), blocks)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    return F.explode(F.transform(others, lambda o: F.struct(
        F.least(o, mine).alias("low"), F.greatest(o, mine).alias("high"), mine.alias("mine")
    )))


def grouped_links(df: DataFrame, keys: list[str], links: Callable[[dict], list[tuple[int, int]]]) -> DataFrame:
    """Links that ``links`` finds within each group of rows with equal keys; groups are bounded."""
    places = [df.columns.index(k) for k in keys]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        # Words that were learned for the sets make room; comparing needs none.
        worker_cache("links")
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in places])
            change = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            borders = [0, *change.tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for a, b in zip(borders, borders[1:]):
                now = tuple(marks[:, a])
                if held and now != key:
                    found += _within(held, names, links)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
            yield _pairs(found)
        if held:
            yield _pairs(_within(held, names, links))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _within(held: list[pa.RecordBatch], names: list[str], links: Callable) -> list[tuple[int, int]]:
    if len(held) == 1 and held[0].num_rows < 2:
        return []
    return links({n: [x for h in held for x in h.column(i).to_pylist()] for i, n in enumerate(names)})


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"]
    )


def spanning(nodes: list[int], sizes: np.ndarray, sets: list[np.ndarray], passes: Callable, percent: int):
    """A spanning forest of the pairs that pass, by sizes; connected pairs aren't compared again.

    ``passes(i, others, common)`` says which of the candidates pass, from the
    numbers of common values.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, sets, nodes = sizes[order], [sets[i] for i in order], [nodes[i] for i in order]
    flat = np.concatenate(sets)
    distinct, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mark = np.zeros(len(distinct), bool)
    group = np.arange(len(nodes))
    found = []
    for i in range(len(nodes) - 1):
        # Sets more unlike in size than the threshold allows can't be links.
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        others = np.arange(i + 1, end)
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        if len(others) == end - i - 1:
            hits = mark[flat[starts[i + 1] : starts[end]]]
            common = np.add.reduceat(hits, starts[i + 1 : end] - starts[i + 1], dtype=np.int64)
        else:
            common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in others.tolist()])
        mark[own] = False
        for j in others[passes(order[i], order[others], common)].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((nodes[i], nodes[j]))
    return found


def _list_links(percent: int) -> Callable[[dict], list[tuple[int, int]]]:
    """Pairs of a list whose union sketch doesn't rule them out."""
    share = shared_part(percent)

    def links(rows: dict) -> list[tuple[int, int]]:
        sizes = np.array(rows["n"])
        sets = [np.array(s, np.int64).view(np.uint64) for s in rows["sketch"]]
        lengths = np.array([len(s) for s in sets])

        def passes(i: int, others: np.ndarray, common: np.ndarray) -> np.ndarray:
            good = common >= np.ceil(share * np.minimum(lengths[i], lengths[others]))
            for at in np.flatnonzero(good).tolist():
                a, b = sets[i], sets[others[at]]
                union = np.union1d(a, b)
                whole = sizes[i] <= SKETCH and sizes[others[at]] <= SKETCH
                if whole:
                    good[at] = 100 * common[at] >= percent * len(union)
                else:
                    low = union[:SKETCH]
                    both = np.intersect1d(a, b, assume_unique=True)
                    good[at] = np.count_nonzero(both <= low[-1]) >= share * len(low)
            return good

        return spanning(rows["node"], sizes, sets, passes, percent)

    return links


def _set_links(percent: int) -> Callable[[dict], list[tuple[int, int]]]:
    """Confirmed links of a family."""

    def links(rows: dict) -> list[tuple[int, int]]:
        sizes = np.array(rows["n"])
        sets = [np.frombuffer(s, "<u8") for s in rows["shingles"]]

        def passes(i: int, others: np.ndarray, common: np.ndarray) -> np.ndarray:
            return 100 * common >= percent * (sizes[i] + sizes[others] - common)

        return spanning(rows["node"], sizes, sets, passes, percent)

    return links


def _families(distinct: DataFrame, percent: int) -> DataFrame:
    listed = written(_listed(distinct, shared_part(percent)), "lists").select("node", "n", "sketch", F.explode("values").alias("value"))
    counts = listed.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / LIST_ROWS)
    dealt = listed.join(counts, "value").select(
        "value", "node", "n", "sketch", block_pairs("value", blocks).alias("pair")
    ).select("value", "pair.low", "pair.high", "node", "n", "sketch")
    return connected_components(grouped_links(dealt, ["value", "low", "high"], _list_links(percent)), "a", "b")


def _confirmed(documents: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between full sets inside families."""

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for node, family, text in zip(*columns):
            s = shingle_set(text, width)
            if _node(s) == node:
                for to, x in zip(out, (node, family, len(s), s.astype("<u8").tobytes())):
                    to.append(x)
        return out

    wanted = members.select(F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("text_hash"), "node", "family")
    texts = _texts(documents).join(wanted, "text_hash")
    joined = texts.filter(F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "family", "text")
    sets = map_slices(joined, work, "node bigint, family bigint, n bigint, shingles binary")
    weights = members.groupBy("family").agg(F.sum("n").alias("weight"))
    blocks = F.ceil(F.col("weight") / BLOCK_ELEMENTS)
    dealt = sets.join(cut(weights), "family").select(
        "family", "node", "n", "shingles", block_pairs("family", blocks).alias("pair")
    ).select("family", "pair.low", "pair.high", "node", "n", "shingles")
    return grouped_links(dealt, ["family", "low", "high"], _set_links(percent))


def _labelled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Every row with the hash of its text, its set's size and its component."""
    signed = written(sketches(documents, width), "sketches")
    filled = signed.filter("n > 0")
    distinct = written(filled.select("node", "n", "sketch").distinct(), "distinct")
    # A row with an id, if there is one, stands for its set.
    row = F.struct("doc_id", "text_hash")
    classes = cut(filled.groupBy("node").agg(
        F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.max("n").alias("n")
    ))
    families = _families(distinct, percent)
    members = cut(families.join(classes, "node").select("first", "node", F.col("component").alias("family"), "n"))
    linked = cut(connected_components(_confirmed(documents, members, width, percent), "a", "b"))
    rooted = classes.join(linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("smallest"))
    labels = cut(rooted.join(smallest, "root").select("node", "root", "smallest"))
    keyed = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return keyed.join(labels, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", "root", F.coalesce("smallest", "doc_id").alias("component_id")
    )


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """Every document with its set's size, its component and whether it is the one that stays.

    Links hold where 100 * intersection >= percent * union of the shingle sets.
    """
    return _labelled(documents, width, percent).drop("text_hash", "root").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates, the one with the smallest id.

    Where several rows of a group have that id, or none of them has any, one of these stays.
    Rows of empty texts stay, but of equal ones with an id one.
    """
    found = _labelled(documents, width, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own, key, text, rows, filled = (fresh(documents, c) for c in ("_id", "_key", "_text", "_rows", "_filled"))
    group = F.coalesce("root", "text_hash").alias("group")
    texts = found.groupBy("doc_id", group, "text_hash").agg(F.count("*").alias("n"), F.max(F.col("n_shingles") > 0).alias("filled"))
    chosen = texts.groupBy("doc_id", "group").agg(F.min(F.struct("text_hash", "n", "filled")).alias("x"))
    ids = cut(chosen.select(
        F.col("doc_id").alias(own), F.col("x.text_hash").alias(key), F.col("x.n").alias(rows), F.col("x.filled").alias(filled)
    ))
    keyed = documents.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(ids, (F.col(text) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    single = (F.col(rows) == 1) | F.col(own).isNull() & ~F.col(filled)
    once = joined.filter(single).select(documents.columns)
    return once.union(joined.filter(~single).select(documents.columns).dropDuplicates(["doc_id", "text"]))
