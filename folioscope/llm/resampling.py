"""Importance resampling of documents towards a target corpus, over hashed runs of words.

1. Head. Every task counts its words (and pairs, for wider runs) and reports those it met
   often; sums of these reports name at most ``HEAD`` words and pairs. They are broadcast
   with their CRC states and buckets, worked out once.
2. Tail. A feature that isn't in the head takes its CRC directly: from its bytes, or by
   continuing the state of the run it prolongs. Which features are in the head changes
   the time and no bucket. Every document's buckets are stored.
3. Buckets are summed over all documents, and over the target. Their log ratio is a
   bucket's gain, a document's weight is the mean gain of its features.
4. Weights get Gumbel noise from a hash of the document's id, and a share of the documents
   with enough words is drawn from the top. Scores are whole numbers, so a count by score
   tells the lowest score that is drawn, and only documents at or above it are sorted.

A NULL or empty text has no features, weight 0 and is not drawn. A NULL ``doc_id`` hashes as
an empty id and loses ties. Repeated rows are documents of their own: equal ones tie, and each
has a place. Other columns are not read. Empty tables give no rows; an empty target draws by
the documents' own counts alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positioned
from .common import SLICE_ROWS, map_slices, written

#: Words and pairs that are broadcast at most, and the longest of them in bytes.
HEAD, HEAD_BYTES = 20_000, 48
#: Distinct features a task counts at a time; beyond it the rare ones are dropped from the report.
COUNTED = 200_000
# ASCII letters in lower case, digits, and all bytes above ASCII; the rest parts words.
TABLE = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)
) + bytes(range(128, 256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, with A-Z in lower case."""
    return text.translate(TABLE).split() if text else []


def _often(counts: Counter) -> Counter:
    """The commoner half of a counter that has grown too large."""
    kept = Counter(dict(counts.most_common(COUNTED // 2))) if len(counts) > COUNTED else counts
    return kept


def head(texts: DataFrame, width: int, most: int = HEAD) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """Common words, and common pairs of words if runs are wider than one.

    Tasks report their commonest; what is missing in a report is only slower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pairs = Counter(), Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                found = [words_of(t) for t in batch.column(0).slice(start, SLICE_ROWS).to_pylist()]
                single.update(chain.from_iterable(found))
                if width > 1:
                    pairs.update(p for w in found for p in zip(w, w[1:]))
                single, pairs = _often(single), _often(pairs)
        rows = [(w, None, n) for w, n in single.most_common(most) if len(w) <= HEAD_BYTES]
        rows += [(a, b, n) for (a, b), n in pairs.most_common(most) if len(a) + len(b) <= HEAD_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))],
            names=["a", "b", "n"],
        )

    summed = texts.mapInArrow(run, "a binary, b binary, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Two short lists, each of at most ``most`` rows of bounded bytes.
    common = [
        summed.filter(F.col("b").isNull() if one else F.col("b").isNotNull()).orderBy(F.desc("n"), "a", "b").limit(most).collect()
        for one in ((True, False) if width > 1 else (True,))
    ]
    return [bytes(r["a"]) for r in common[0]], [(bytes(r["a"]), bytes(r["b"])) for x in common[1:] for r in x]


class Buckets:
    """Buckets of a text's features: those of the head are known, others are worked out."""

    def __init__(self, single: list[bytes], pairs: list[tuple[bytes, bytes]], width: int, buckets: int):
        self.width, self.buckets = width, buckets
        self.first = {w: zlib.crc32(w) % buckets for w in single}
        # The state behind a word and a blank is where a longer run goes on.
        self.states = {w: zlib.crc32(w + b" ") for w in single}
        self.pairs = {p: zlib.crc32(b" ".join(p)) % buckets for p in pairs}
        self.kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        found = [words_of(t) for t in texts]
        first, states = self.first, self.states
        if tail := set(chain.from_iterable(found)).difference(first):
            first = first | {w: zlib.crc32(w) % self.buckets for w in tail}
            if self.width > 1:
                states = states | {w: zlib.crc32(w + b" ") for w in tail}
        runs = [[first[w] for w in words] for words in found]
        if self.width > 1:
            for run, words in zip(runs, found):
                run.extend(self._wider(words, states))
        return [np.array(run, self.kind) for run in runs]

    def _wider(self, words: list[bytes], states: dict[bytes, int]) -> Iterator[int]:
        """Buckets of all runs of two words and more."""
        for pair in zip(words, words[1:]):
            at = self.pairs.get(pair)
            yield zlib.crc32(pair[1], states[pair[0]]) % self.buckets if at is None else at
        for n in range(3, self.width + 1):
            for start in range(len(words) - n + 1):
                state = states[words[start]]
                for w in words[start + 1 : start + n - 1]:
                    state = zlib.crc32(b" ", zlib.crc32(w, state))
                yield zlib.crc32(words[start + n - 1], state) % self.buckets


def featured(documents: DataFrame, single, pairs, width: int, buckets: int) -> DataFrame:
    """Every document's numbers of words and features and the bucket of each feature."""
    lists = documents.sparkSession.sparkContext.broadcast((single, pairs))
    made: list[Buckets] = []

    def work(columns: list[list]) -> list[list]:
        if not made:
            made.append(Buckets(*lists.value, width, buckets))
        found = made[0].of(columns[1])
        # With runs of one to ``width`` words the number of words is that of the first kind.
        words = [len(words_of(t)) for t in columns[1]] if width > 1 else [len(x) for x in found]
        return [columns[0], words, [len(x) for x in found], [x.tobytes() for x in found]]

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return map_slices(rows, work, "doc_id bigint, n_words bigint, n_features bigint, features binary")


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; a task reports at most one number a bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                raw = b"".join(batch.column(0).slice(start, SLICE_ROWS).to_pylist())
                counts += np.bincount(np.frombuffer(raw, kind), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["bucket", "n"])

    summed = features.select("features").mapInArrow(run, "bucket bigint, n bigint")
    rows = summed.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of smoothed shares, rounded down, for each bucket."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Every document with the mean gain of its features, rounded down."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def work(columns: list[list]) -> list[list]:
        *kept, raw = columns
        weights = [int(shared.value[np.frombuffer(x, kind)].sum()) // n if n else 0 for x, n in zip(raw, kept[2])]
        return [*kept, weights]

    return map_slices(features, work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noisy(weights: DataFrame, seed: int) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise that the id's hash decides."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def drawn(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank``: places by falling score and rising id among the share that is drawn, NULL for others."""
    fit = F.col("n_words") >= least_words
    # Scores are whole numbers in a range of some ten thousands, so this is a short list.
    counts = scores.filter(fit).groupBy("score").count().orderBy(F.desc("score")).toArrow()
    each = counts["count"].to_numpy()
    wanted = percent * int(each.sum()) // 100
    if not wanted:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    lowest = int(counts["score"][int(np.searchsorted(each.cumsum(), wanted))].as_py())
    near = fit & (F.col("score") >= lowest)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    placed = positioned(scores.filter(near), order, "place")
    rank = F.when(F.col("place") <= wanted, F.col("place").cast("long")).alias("rank")
    rest = scores.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(placed.select(*scores.columns, rank))


def resampled(
    documents: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10,
    least_words: int = 20, seed: int = 2024, most: int = HEAD,
) -> DataFrame:
    """Every document with its weight towards the target's texts, its score and, if drawn, its rank."""
    texts = documents.select(F.col("text").cast("string").cast("binary"))
    single, pairs = head(texts, width, most)
    features = written(featured(documents, single, pairs, width, buckets), "features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(totals(features, buckets), totals(featured(wanted, single, pairs, width, buckets), buckets))
    scores = written(noisy(weighted(features, gain), seed), "scores")
    return drawn(scores, percent, least_words)
