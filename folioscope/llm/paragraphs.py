"""Passages that documents share, by MinHash bands over paragraphs.

A paragraph is a line of at least ``LEAST_LINE`` words. Equal ones are one node.
Bands are tuned: among all splits into bands of a few rows, the one with the
fewest keys that finds a pair at the threshold with the wanted chance. Paragraphs
with a common band key are compared on their full shingle sets, confirmed links
join into components, and a component in several documents is a cluster of
copies. Copies that follow one another in a document are one passage, also over
lines that are too short to count; a passage of at least ``LEAST_PASSAGE`` words
is reported. The first paragraph of a cluster, by document and line, stays and
the others are to be removed.

A passage may also stand inside a longer line. So lines of several sentences are
cut into these, equal sentences of several documents are a cluster, and a run of
them of at least ``LEAST_RUN`` words is reported too: a passage that begins in
the middle of a foreign sentence lacks its first one. Sentences of a few words
aren't looked up and don't break a run. What lines have reported isn't repeated.

A NULL or empty text has no paragraphs. Repeated rows of a document are one
document, so they alone make no cluster, but each has its own rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_slices, written
from .components import connected_components
from .near_dedup import block_pairs, grouped_links, spanning
from .shingles import ODD, mixed, windows, word_hashes

WIDTH, PERCENT, RECALL = 5, 80, 0.999
LEAST_LINE, LEAST_PASSAGE = 8, 45
LEAST_SENTENCE, LEAST_RUN = 6, 24
ENDS = (b".", b"!", b"?")
MOST_KEYS = 24
BUCKET_ROWS = 1_000


def tuned_bands(similarity: float, recall: float) -> tuple[int, int]:
    """Bands and rows: few keys a paragraph, and of those with as many the most selective."""
    fitting = []
    for rows in range(1, 9):
        for bands in range(1, MOST_KEYS + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                # The cost of a key and that of wrongly meeting unlike paragraphs.
                fitting.append((bands + 40 * (1 - (1 - 0.2**rows) ** bands), bands, rows))
                break
    return min(fitting)[1:]


BANDS, ROWS = tuned_bands(PERCENT / 100, RECALL)


def _node(words: list[bytes]) -> int:
    x = xxhash.xxh64_intdigest(b" ".join(words))
    return x if x < 2**63 else x - 2**64


def _lines(text: bytes | None) -> list[tuple[int, list[bytes]]]:
    """Numbers and words of the lines that count."""
    found = []
    for number, line in enumerate((text or b"").lower().split(b"\n")):
        words = line.split()
        if len(words) >= LEAST_LINE:
            found.append((number, words))
    return found


def signed_lines(documents: DataFrame) -> DataFrame:
    """Every paragraph with its place among those of its document, its words, its node and its band keys."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    names = "doc_id bigint, line int, place int, n_words int, node bigint, " + ", ".join(
        f"band{b} bigint" for b in range(BANDS)
    )

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(5)]
        words: list[bytes] = []
        edges: list[int] = []
        for doc, text in zip(*columns):
            for place, (number, own) in enumerate(_lines(text)):
                for to, x in zip(out, (doc, number, place, len(own), _node(own))):
                    to.append(x)
                edges += [len(words), len(words) + len(own) - WIDTH + 1]
                words += own
        if not words:
            return [[] for _ in range(5 + BANDS)]
        runs = windows(word_hashes(words), WIDTH)
        edges = edges[:-1] if edges[-1] >= len(runs) else edges
        lows = np.stack([
            np.minimum.reduceat(runs * f + s, edges)[::2] for f, s in zip(factors, shifts)
        ])
        for band in range(BANDS):
            key = np.full(lows.shape[1], band + 1, np.uint64)
            for row in lows[band * ROWS : (band + 1) * ROWS]:
                key = mixed(key * ODD + row)
            out.append(key.view(np.int64).tolist())
        return out

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return map_slices(rows, work, names)


def _set_links(rows: dict) -> list[tuple[int, int]]:
    sizes = np.array(rows["n"])
    sets = [np.frombuffer(s, "<u8") for s in rows["shingles"]]

    def passes(i: int, others: np.ndarray, common: np.ndarray) -> np.ndarray:
        return 100 * common >= PERCENT * (sizes[i] + sizes[others] - common)

    return spanning(rows["node"], sizes, sets, passes, PERCENT)


def _links(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """Confirmed links between different paragraphs."""
    keys = [f"band{b}" for b in range(BANDS)]
    # One row for each different paragraph, with a document and line that have it.
    nodes = written(signed.groupBy("node").agg(
        F.min(F.struct("doc_id", "line")).alias("at"), *(F.max(k).alias(k) for k in keys)
    ), "paragraphs")
    keyed = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    meeting = cut(keyed.join(shared, "key").select("key", "node", "members"))
    places = nodes.join(meeting.select("node").distinct(), "node").select("node", "at.doc_id", "at.line")
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("lines"))

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for lines, text in zip(*columns):
            nodes_of = {x["line"]: x["node"] for x in lines}
            for number, own in _lines(text):
                # A document may have several rows; only the line that was meant has its node.
                if number in nodes_of and nodes_of[number] == _node(own):
                    s = np.unique(windows(word_hashes(own), WIDTH))
                    for to, x in zip(out, (nodes_of[number], len(s), s.astype("<u8").tobytes())):
                        to.append(x)
        return out

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    joined = texts.join(wanted, "doc_id").select("lines", "text")
    sets = map_slices(joined, work, "node bigint, n bigint, shingles binary")
    blocks = F.ceil(F.col("members") / BUCKET_ROWS)
    dealt = meeting.join(sets, "node").select("key", "node", "n", "shingles", block_pairs("key", blocks).alias("pair"))
    dealt = dealt.select("key", "pair.low", "pair.high", "node", "n", "shingles")
    return grouped_links(dealt, ["key", "low", "high"], _set_links)


def sentences(documents: DataFrame) -> DataFrame:
    """Sentences, with their places among those that count in their document, of lines that have several."""

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for doc, text in zip(*columns):
            place = 0
            for number, words in _lines(text):
                ends = [i for i, w in enumerate(words, 1) if w.endswith(ENDS)]
                if not ends or ends[-1] != len(words):
                    ends.append(len(words))
                start = 0
                for sentence, end in enumerate(ends):
                    if end - start >= LEAST_SENTENCE:
                        # A line of one sentence is a paragraph already, yet it may lie inside a run.
                        for to, x in zip(out, (doc, number, sentence, place, end - start, _node(words[start:end]))):
                            to.append(x)
                        place += 1
                    start = end
        return out

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return map_slices(rows, work, "doc_id bigint, line int, sentence int, place int, n_words int, node bigint")


def _with_passages(found: DataFrame, least: int) -> DataFrame:
    """Rows that follow one another in their document, where they have at least so many words together."""
    own = Window.partitionBy("doc_id")
    runs = found.withColumn("run", F.col("place") - F.dense_rank().over(own.orderBy("place")))
    whole = runs.withColumn("passage_words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
    return whole.filter(F.col("passage_words") >= least)


def _repeated_sentences(documents: DataFrame) -> DataFrame:
    cut_up = written(sentences(documents), "sentences")
    several = cut(cut_up.groupBy("node").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("copies")
    ).filter("low < high").select("node", "copies"))
    found = cut(_with_passages(cut_up.join(several, "node"), LEAST_RUN))
    # The first occurrence is looked for among those that are reported.
    first = found.groupBy("node").agg(F.min(F.struct("doc_id", "line", "sentence")).alias("first"))
    return found.join(cut(first), "node").select(
        "doc_id", "line", "sentence", "n_words", "passage_words", F.col("node").alias("cluster"), "copies",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"),
        (F.struct("doc_id", "line", "sentence") != F.col("first")).alias("removed"),
    )


def repeated_passages(documents: DataFrame) -> DataFrame:
    """Every repeated line or sentence of a shared passage, its cluster, and whether it is to go.

    ``sentence`` is NULL where a whole line is meant.
    """
    lines = cut(repeated_lines(documents))
    inside = _repeated_sentences(documents).join(lines.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_anti")
    whole = lines.withColumn("sentence", F.lit(None).cast("int"))
    return whole.unionByName(inside)


def repeated_lines(documents: DataFrame) -> DataFrame:
    """Every paragraph of a passage of whole lines that several documents share."""
    signed = written(signed_lines(documents), "lines")
    linked = cut(connected_components(_links(documents, signed), "a", "b"))
    lines = signed.select("doc_id", "line", "place", "n_words", "node")
    counts = cut(lines.groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.min(F.struct("doc_id", "line")).alias("first"),
    ))
    rooted = counts.join(linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    clusters = rooted.groupBy("root").agg(
        F.sum("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"),
    ).filter("low < high")
    labels = cut(rooted.select("node", "root").join(clusters, "root").select("node", "root", "copies", "first"))
    found = lines.join(labels, "node")
    return _with_passages(found, LEAST_PASSAGE).select(
        "doc_id", "line", "n_words", "passage_words", F.col("root").alias("cluster"), "copies",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"),
        (F.struct("doc_id", "line") != F.col("first")).alias("removed"),
    )
