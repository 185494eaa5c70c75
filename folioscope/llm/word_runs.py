"""Runs of words that different texts share word for word, however their lines and sentences are set.

A run has at least ``LEAST`` words of one text, counted over line breaks, and
each ``LEAST`` words in a row of it stand in another text too. Found in two steps:

1. Anchors by winnowing: of the hashes of ``GRAM`` words that lie within ``LEAST``
   words the lowest is an anchor. So equal stretches have an equal anchor, wherever
   they stand and whatever surrounds them.
2. Every stretch of ``LEAST`` words belongs to one anchor, its lowest, wherever it stands. Where
   several texts have that, the stretches of each are one row, looked up among those of the same
   anchor; those that follow one another are one run, of full length. Anchors that very many
   texts have are looked up stretch by stretch.

The first text that has a stretch, by document and place, keeps it; runs of
stretches that stay and of those that go are rows of their own. Rows with equal
texts are one text here: all but the one with the smallest id are whole runs.
Words are those between ASCII white space, with A-Z in lower case; Chinese characters
and kana, which have no blanks between them, are a word each. A NULL ``doc_id`` comes last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_slices, written
from .shingles import lower_words, windows, word_hashes

LEAST, GRAM = 50, 12
SPAN = LEAST - GRAM + 1
LAST = 2**63 - 1
#: Places of an anchor that one task looks at together, and words that are hashed together.
MOST_PLACES, WORDS_AT_ONCE = 50_000, 20_000
# U+3000 to U+9FFF in UTF-8.
UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}")


def _words(text: bytes) -> list[bytes]:
    return lower_words(text if text.isascii() else UNSPACED.sub(rb" \g<0> ", text))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The first place of the lowest of each ``width`` values in a row."""
    at, low, span = np.arange(len(values)), values, 1
    while span < width:
        # Two shorter stretches, which may overlap, make a longer one.
        step = min(span, width - span)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        span += step
    return at


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``LEAST`` words in a row the place of their anchor, and the hashes by place."""
    grams = windows(hashes, GRAM)
    return lowest(grams, SPAN), grams


def _rows(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("node"),
        text.cast("binary").alias("text"),
    ).filter("text is not null")


def _anchored(documents: DataFrame) -> DataFrame:
    """Texts that are long enough, with their anchors."""

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(5)]
        held: list[tuple[int, int, int]] = []
        together: list[bytes] = []

        def flush() -> None:
            # Texts are hashed together; what would reach from one into the next isn't looked at.
            if not held:
                return
            own, grams = anchors(word_hashes(together))
            start = 0
            for doc, node, many in held:
                at = own[start : start + many - LEAST + 1]
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                for to, x in zip(out, (doc, node, many, (at - start).astype(np.int32), grams[at].view(np.int64))):
                    to.append(x)
                start += many
            held.clear()
            together.clear()

        for doc, node, text in zip(*columns):
            words = _words(text)
            if len(words) >= LEAST:
                held.append((doc, node, len(words)))
                together.extend(words)
                if len(together) >= WORDS_AT_ONCE:
                    flush()
        flush()
        return out

    return map_slices(_rows(documents), work, "doc bigint, node bigint, n_words int, places array<int>, grams array<bigint>")


def _pieces(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each wanted place of an anchor: its stretches, which follow one another, with their hashes and lines."""

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        held: list[tuple] = []
        together: list[bytes] = []

        def flush() -> None:
            if not held:
                return
            hashes = word_hashes(together)
            (own, grams), stretches = anchors(hashes), windows(hashes, LEAST)
            grams, start = grams.view(np.int64), 0
            for doc, node, rows, places, counts in held:
                line = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                at = own[start : start + len(line) - LEAST + 1]
                heads = np.flatnonzero(np.diff(at, prepend=-1))
                wished = np.flatnonzero(np.isin(at[heads] - start, places))
                for a, b in zip(heads[wished].tolist(), np.append(heads, len(at))[wished + 1].tolist()):
                    made = (int(grams[at[a]]), doc, node, rows, a, stretches[start + a : start + b].tobytes(), line[a:b].tobytes())
                    for to, x in zip(out, made):
                        to.append(x)
                start += len(line)
            held.clear()
            together.clear()

        for doc, node, rows, places, text in zip(*columns):
            lines = [_words(line) for line in text.split(b"\n")]
            held.append((doc, node, rows, places, [len(x) for x in lines]))
            for line in lines:
                together.extend(line)
            if len(together) >= WORDS_AT_ONCE:
                flush()
        flush()
        return out

    own = _rows(documents).join(wanted, ["doc", "node"]).dropDuplicates(["doc", "node"])
    return map_slices(
        own.select("doc", "node", "rows", "places", "text"), work,
        "gram bigint, doc bigint, node bigint, rows bigint, word int, hashes binary, lines binary",
    )


SEGMENT = "doc bigint, node bigint, removed boolean, word int, end int, line int, hash bigint, copies bigint, first_doc bigint, first_line int"


def _segments(pieces: DataFrame) -> DataFrame:
    """Stretches of a piece that other texts have too: those that follow one another and all stay or all go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column(0).to_numpy()
            # The last anchor of a batch may go on in the next one.
            border = int(np.searchsorted(grams, grams[-1]))
            if border or held and held[-1].column(0)[-1].as_py() != grams[0]:
                yield _looked_up([*held, batch.slice(0, border)])
                held = []
            held.append(batch.slice(border))
        if held:
            yield _looked_up(held)

    return pieces.repartition("gram").sortWithinPartitions("gram", "doc", "node", "word").mapInArrow(run, SEGMENT)


def _looked_up(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Segments of whole anchors, whose pieces come by document, text and word."""
    doc, node, rows, word = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (1, 2, 3, 4))
    raw, lines = ([x for h in held for x in h.column(i).to_pylist()] for i in (5, 6))
    many = np.array([len(x) // 8 for x in raw], np.int64)
    hashes, line = np.frombuffer(b"".join(raw), np.int64), np.frombuffer(b"".join(lines), np.int32)
    piece = np.repeat(np.arange(len(many)), many)
    at = word[piece] + np.arange(len(piece)) - (np.cumsum(many) - many)[piece]
    # Equal stretches stay in order, so the first of them is the one that keeps them.
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    sizes = np.diff(heads, append=len(order))
    owners = node[piece[order]]
    known, first, copies = np.empty(len(order), bool), np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    known[order] = np.repeat(np.minimum.reduceat(owners, heads) < np.maximum.reduceat(owners, heads), sizes)
    first[order] = np.repeat(order[heads], sizes)
    copies[order] = np.repeat(np.add.reduceat(rows[piece[order]], heads), sizes)
    removed = first != np.arange(len(order))
    state = piece * 4 + known * 2 + (known & removed)
    begin = np.flatnonzero(np.diff(state, prepend=-1))
    end = np.append(begin[1:], len(order)) - 1
    most = np.maximum.reduceat(copies, begin)
    kept = known[begin]
    begin, end, most = begin[kept], end[kept], most[kept]
    own, other = piece[begin], first[begin]
    found = (
        doc[own], node[own], removed[begin], at[begin].astype(np.int32), at[end].astype(np.int32), line[begin],
        hashes[begin], most, doc[piece[other]], line[other],
    )
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _single_segments(pieces: DataFrame) -> DataFrame:
    """Like :func:`_segments`, a row for each stretch, with nothing of an anchor together in a task."""

    def work(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for doc, node, rows, word, hashes, lines in zip(*columns):
            own = np.frombuffer(hashes, np.int64).tolist()
            for to, x in zip(out, ([doc], [node], [rows])):
                to += x * len(own)
            for to, x in zip(out[3:], (range(word, word + len(own)), np.frombuffer(lines, np.int32).tolist(), own)):
                to += x
        return out

    stretches = written(map_slices(
        pieces.select("doc", "node", "rows", "word", "hashes", "lines"), work,
        "doc bigint, node bigint, rows bigint, word int, line int, hash bigint",
    ), "stretches")
    known = stretches.groupBy("hash").agg(
        F.min("node").alias("low"), F.max("node").alias("most"), F.sum("rows").alias("copies"),
        F.min(F.struct("doc", "node", "word", "line")).alias("first"),
    ).filter("low < most").select("hash", "copies", "first")
    return stretches.join(known, "hash").select(
        "doc", "node", (F.struct("doc", "node", "word", "line") != F.col("first")).alias("removed"), "word",
        F.col("word").alias("end"), "line", "hash", "copies", F.col("first.doc").alias("first_doc"),
        F.col("first.line").alias("first_line"),
    )


def repeated_runs(documents: DataFrame) -> DataFrame:
    """Every shared run with its first line and word, and whether it is to go."""
    texts = written(_anchored(documents), "anchors")
    first = cut(texts.groupBy("node").agg(F.min("doc").alias("doc"), F.max("doc").alias("high"), F.count("*").alias("rows")))
    places = texts.join(first.select("node", "doc", "rows"), ["node", "doc"]).select(
        "node", "doc", "rows", F.explode(F.arrays_zip("places", "grams")).alias("x")
    ).select("node", "doc", "rows", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    shared = cut(places.groupBy("gram").agg(
        F.min("node").alias("low"), F.max("node").alias("most"), F.count("*").alias("places")
    ).filter("low < most").select("gram", "places"))

    def pieces(grams: DataFrame) -> DataFrame:
        wanted = places.join(grams.select("gram"), "gram").groupBy("doc", "node").agg(
            F.max("rows").alias("rows"), F.collect_set("place").alias("places")
        )
        return _pieces(documents, wanted)

    often = shared.filter(F.col("places") > MOST_PLACES)
    found = _segments(pieces(shared.filter(F.col("places") <= MOST_PLACES)))
    if often.take(1):
        found = found.unionByName(_single_segments(pieces(often)))
    found = written(found, "segments")
    own = Window.partitionBy("node", "removed").orderBy("word")
    begins = F.coalesce(F.col("word") != F.lag("end").over(own) + 1, F.lit(True)).cast("int")
    runs = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(own)).groupBy("doc", "node", "removed", "run").agg(
        F.min(F.struct("word", "line", "hash", "first_doc", "first_line")).alias("begin"), F.max("end").alias("end"),
        F.max("copies").alias("copies"),
    )
    inside = runs.select(
        "doc", F.col("begin.line").alias("line"), F.col("begin.word").alias("word"),
        (F.col("end") + LEAST - F.col("begin.word")).cast("int").alias("n_words"), F.col("begin.hash").alias("cluster"),
        "copies", F.col("begin.first_doc").alias("first"), F.col("begin.first_line").alias("first_line"), "removed",
    )
    several = first.filter("doc < high").select("node", F.col("doc").alias("first"), "rows")
    equal = texts.join(several, "node").select(
        "doc", F.lit(0).alias("line"), F.lit(0).alias("word"), "n_words", F.col("node").alias("cluster"),
        F.col("rows").alias("copies"), "first", F.lit(0).alias("first_line"), (F.col("doc") != F.col("first")).alias("removed"),
    )
    id_of = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return inside.unionByName(equal).select(
        id_of("doc").alias("doc_id"), "line", "word", "n_words", F.col("n_words").cast("long").alias("passage_words"),
        "cluster", "copies", id_of("first").alias("first_doc_id"), "first_line", "removed",
    )


def with_runs(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages of whole lines and sentences, and runs; ``word`` is set for runs only."""
    return passages.withColumn("word", F.lit(None).cast("int")).unionByName(
        repeated_runs(documents).withColumn("sentence", F.lit(None).cast("int"))
    )
