"""Toxicity of texts that may hide their words: a noisy channel is decoded before scoring.

1. A character trigram model is counted over all texts.
2. Words that may be disguised become lattices: signs that stand for letters,
   characters between letters that may be left out, repeated letters that may be
   one, and single letters in a row that may be one word. Viterbi search takes
   the path that the channel and the character model together find likeliest.
   An ordinary word has only one path and stays.
3. Restored words give a text's features, words and their beginnings. Those that
   tell the classes apart go into a logistic regression that Spark fits on a
   bounded sample of labelled rows.

Only the text is scored. A NULL or empty text has the score of a text without
features. Labels that are NULL are left out; a document with several labels has
the highest. Without rows of both classes every score is the smoothed share of
the one there is. Repeated documents are scored each.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Recent, append_columns, cut, fresh, map_slices, worker_cache

#: Most labelled rows used to fit, taken by a hash of their id.
FIT_ROWS = 20_000
#: Most features that the classifier sees, and least texts that hold one.
FEATURES, LEAST_TEXTS = 4_096, 5
#: Bytes of features of words that a worker keeps.
BYTES_KEPT = 60_000_000
# Letters with a place of their own in the character model; all others share the last.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
WIDTH = 64
# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
BETWEEN = frozenset(" .-_*~'`,")
# Logarithms of the channel's probabilities.
AS_IS, NO_LETTER, FOR_LETTER, LEFT_OUT, REPEATED = -0.05, -3.0, -2.5, -1.2, -1.6
_HIDING = re.escape("".join(sorted({*SIGNS, *BETWEEN} - {" "})))
# A word with a letter and a sign of the channel at any place, or with a letter three times in a row.
DISGUISED = re.compile(rf"[^\W\d_].*[{_HIDING}]|[{_HIDING}].*[^\W\d_]|([^\W\d_])\1\1", re.S)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
# Signs that stand for letters stay at the ends, but no more than two of them.
_ENDS = "@$!|+€"
EDGE_OF_LETTERS = re.compile(
    rf"^(?:(?![{_ENDS}])[\W_])+|(?:(?![{_ENDS}])[\W_])+$|^[{_ENDS}]{{2,}}(?=[{_ENDS}])|(?<=[{_ENDS}])[{_ENDS}]{{2,}}$"
)
LEAST_RUN = 3
# Longer texts are decoded in windows that overlap by half, so each word is whole in one.
DECODED_AT_ONCE = 400


def _table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for code in range(0x250):
        c = chr(code).lower()
        if c.isalpha():
            table[code] = LETTERS.find(c[0]) + 1 or WIDTH - 1
    return table


def _places(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return table[np.minimum(codes, len(table) - 1)]


def character_counts(texts: DataFrame) -> np.ndarray:
    """How often each three characters follow one another in all texts; 0 stands for what is no letter."""
    table = _table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDTH**3, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                joined = "  ".join(t for t in batch.column(0).slice(start, SLICE_ROWS).to_pylist() if t)
                x = _places(f"  {joined}  ", table).astype(np.int32)
                codes = (x[:-2] * WIDTH + x[1:-1]) * WIDTH + x[2:]
                counts += np.bincount(codes, minlength=WIDTH**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["code", "n"])

    # At most one row for each three of 64 characters reaches the driver.
    summed = texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(WIDTH**3)
    counts[summed["code"].to_numpy()] = summed["n"].to_numpy()
    return counts


def log_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of trigram probabilities, mixed with those of shorter contexts."""
    three = counts.reshape(WIDTH, WIDTH, WIDTH)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.1) / (one + 0.1).sum()
    p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
    p3 = (three + 2 * p2) / (three.sum(2, keepdims=True) + 2)
    return np.log(p3).astype(np.float32)


def restore(text: str, model: np.ndarray) -> str:
    """The likeliest text behind a disguised one, in lower case; words are parted by blanks."""
    # A state is the last two characters' places; each keeps its best score and text.
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in text.lower():
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, AS_IS))
        else:
            options.append((" ", AS_IS if c == " " else NO_LETTER))
            options += [(x, FOR_LETTER) for x in SIGNS.get(c, "")]
            if c in BETWEEN:
                options.append(("", LEFT_OUT))
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (p, q), (score, made) in states.items():
            own = [*options, ("", REPEATED)] if c == before or made.endswith(c) and c != " " else options
            for x, cost in own:
                if x == "":
                    to, value, longer = (p, q), score + cost, made
                elif x == " " and q == 0:
                    to, value, longer = (p, q), score + cost, made
                else:
                    place = 0 if x == " " else LETTERS.find(x) + 1 or WIDTH - 1
                    to, value, longer = (q, place), score + cost + float(model[p, q, place]), made + x
                if to not in reached or value > reached[to][0]:
                    reached[to] = (value, longer)
        states, before = reached, c
    ends = [(s + (float(model[p, q, 0]) if q else 0.0), made) for (p, q), (s, made) in states.items()]
    return max(ends)[1].strip()


def decoded(text: str, model: np.ndarray) -> list[str]:
    """The words behind a disguised text of any length."""
    found: list[str] = []
    half = DECODED_AT_ONCE // 2
    starts = range(0, max(1, len(text) - half), half)
    for start in starts:
        words = restore(text[start : start + DECODED_AT_ONCE], model).split()
        # The first and last word of a window may be cut; the neighbour has them whole.
        cut_off = words[int(start > 0) : len(words) - int(start < starts[-1])]
        found += cut_off or words
    return found


def restored_words(word: str, model: np.ndarray) -> list[str]:
    """A word without signs around it, or the words found behind it."""
    lower = word.lower()
    bare = EDGE.sub("", lower)
    signed = EDGE_OF_LETTERS.sub("", lower)
    if DISGUISED.search(signed):
        return decoded(signed, model)
    return [bare] if bare else []


def runs_of_letters(words: list[str]) -> list[str]:
    """Texts of at least ``LEAST_RUN`` single characters in a row, with blanks between."""
    single = np.fromiter(map(len, words), np.int32, len(words)) == 1
    if np.count_nonzero(single) < LEAST_RUN:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    return [" ".join(words[a:b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LEAST_RUN]


def features_of(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [f"={word}", *(word[:n] for n in (4, 5, 6, 7) if len(word) >= n)]


class Features:
    """What words give, for one character model and one set of wanted features."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None):
        self.model, self.wanted, self.known = model, wanted, Recent(BYTES_KEPT)

    def of_words(self, words: list[str]) -> frozenset:
        found = [f for w in words for f in features_of(w)]
        if self.wanted is None:
            return frozenset(found)
        return frozenset(self.wanted[f] for f in found if f in self.wanted)

    def of_text(self, text: str | None) -> set:
        words = text.split() if text else []
        distinct = set(words)
        for w in self.known.missing(distinct):
            # Most words give nothing that is wanted, and share this one empty set.
            made = self.of_words(restored_words(w, self.model)) or EMPTY
            self.known.add(w, made, 200 + 80 * len(made) if made else 0)
        found = set().union(*filter(None, map(self.known.young.__getitem__, distinct)))
        for run in runs_of_letters(words):
            found |= self.of_words(decoded(run, self.model))
        return found


EMPTY: frozenset = frozenset()


def _worker_features(run: str, model, wanted=None) -> Features:
    """The worker's words for one run's models."""
    cache = worker_cache("toxicity")
    if run not in cache:
        cache.clear()
        cache[run] = Features(model.value, None if wanted is None else wanted.value)
    return cache[run]


def labelled_sample(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``fit_rows`` labelled rows, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double")).dropna()
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, model) -> tuple[dict[str, int], np.ndarray, float]:
    """Wanted features, their weights and the bias."""
    sample, run = labelled_sample(documents, labels), uuid.uuid4().hex

    def words(columns: list[list]) -> list[list]:
        features = _worker_features(run, model)
        return [columns[0], [sorted(features.of_text(t)) for t in columns[1]]]

    rows = cut(map_slices(
        sample.select("toxic", "text"), words, "toxic double, features array<string>"
    ))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if positive in (0, n):
        share = (positive + 1) / (n + 2)
        return {}, np.zeros(0), math.log(share / (1 - share))
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.count("*").alias("all")
    ).filter(F.col("all") >= LEAST_TEXTS)
    # The signed root of chi-squared, for texts of either class that hold the feature.
    a, b = F.col("a"), F.col("all") - F.col("a")
    c, d = F.lit(positive) - a, F.lit(n - positive) - b
    chi = F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * F.lit(float(positive * (n - positive))) + 1)
    best = counts.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    wanted = {r["feature"]: i for i, r in enumerate(best)}
    size, index = max(1, len(wanted)), rows.sparkSession.sparkContext.broadcast(wanted)

    @F.udf(VectorUDT())
    def vector(found):
        at = sorted({index.value[f] for f in found if f in index.value})
        return SparseVector(size, at, [1.0] * len(at))

    ready = rows.select("toxic", vector("features").alias("features")).cache()
    fitted = LogisticRegression(
        labelCol="toxic", regParam=5e-4, elasticNetParam=0.5, standardization=False, maxIter=60
    ).fit(ready)
    ready.unpersist()
    return wanted, fitted.coefficients.toArray(), float(fitted.intercept)


def score(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.3, out: str = "toxicity", flag: str = "is_toxic"
) -> DataFrame:
    """Every document with its score and whether it reaches the threshold; other columns stay."""
    context = documents.sparkSession.sparkContext
    model = context.broadcast(log_model(character_counts(documents.select(F.col("text").cast("string")))))
    wanted, weights, bias = fit(documents, labels, model)
    used = {f: i for f, i in wanted.items() if weights[i]}
    index, run = context.broadcast(used), uuid.uuid4().hex

    def work(columns: list[list]) -> list[list]:
        features, scores = _worker_features(run, model, index), []
        for text in columns[0]:
            z = bias + sum(weights[i] for i in features.of_text(text))
            scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, float(z))))))
        return [scores]

    scored_text = fresh(documents, "_scored_text")
    plain = documents.withColumn(scored_text, F.col("text").cast("string"))
    scored = append_columns(plain, [scored_text], work, f"`{out}` double").drop(scored_text)
    return scored.withColumn(flag, F.col(out) >= threshold)
