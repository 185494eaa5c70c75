"""Quality rules whose cutoffs come from the corpus, by language and source.

Per document some counts are taken from the whole text. Shares of them go into
quantile sketches: counts of values in buckets that grow by two percent. Such
sketches merge by addition, in tasks, across tasks and from sources to
languages to the whole corpus. A group's cutoffs are its quartiles, moved out by
a multiple of their distance and a tolerance; a group of few documents has those
of its language, and a language of few documents those of the corpus. Documents
are joined with their group's cutoffs and filtered.

A NULL or empty text has no words and fails the base rules. NULL languages and
sources are groups of their own. Repeated rows count and are judged each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_slices, written
from .shingles import windows, word_hashes

LEAST_WORDS, MOST_REPEATED = 50, 0.5
GROWTH = 1.02
#: Fewest documents of a group that has cutoffs of its own.
GROUP_DOCS = 200
FENCE = 3.0
# Measures, how far a cutoff lies at least from the quartile, and on which sides it lies.
MEASURES = {
    "mean_word": ("word_chars / n_words", 1.0, ("low", "high")),
    "symbol_share": ("n_symbols / word_chars", 0.02, ("high",)),
    "dup_line_share": ("n_dup_lines / n_lines", 0.35, ("high",)),
    "repeat_share": ("n_repeat_words / n_words", 0.10, ("high",)),
}
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``."""
    raw = text or b""
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0
    bare = raw.translate(None, SPACES)
    # Bytes that continue a character aren't counted.
    word_chars = len(bare.translate(None, CONTINUED))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        _, place, often = np.unique(windows(word_hashes(words), 3), return_inverse=True, return_counts=True)
        covered = np.zeros(len(words), bool)
        again = often[place] > 1
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        repeated = int(np.count_nonzero(covered))
    return (len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines))


def counted(documents: DataFrame) -> DataFrame:
    """Every document's counts, with its language and source."""

    def work(columns: list[list]) -> list[list]:
        made = [counts_of(t) for t in columns[3]]
        return [*columns[:3], *(list(c) for c in zip(*made))] if made else [[] for _ in range(3 + len(COUNTS))]

    rows = documents.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        F.col("text").cast("string").cast("binary"),
    )
    return map_slices(rows, work, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Documents by language, source, measure and bucket of the measure's value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))
    long = measured.select("lang", "source", F.explode(pairs).alias("x")).select("lang", "source", "x.*")
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GROWTH))).otherwise(-10_000)
    return long.groupBy("lang", "source", "measure", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and number of values of each group's merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    value = F.when(F.col("bucket") > -10_000, 2 * F.pow(F.lit(GROWTH), F.col("bucket")) / (GROWTH + 1)).otherwise(0.0)
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("docs"), value))
    return ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row for each language and source with a low and a high cutoff for each measure."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select("lang", "measure", *(F.col(c).alias(f"lang_{c}") for c in ("docs", "q1", "q3")))
    corpus = quartiles(sketch, []).select("measure", *(F.col(c).alias(f"all_{c}") for c in ("q1", "q3")))
    joined = own.join(lang, ["lang", "measure"], "left").join(F.broadcast(corpus), "measure", "left")
    chosen = lambda q: F.when(F.col("docs") >= GROUP_DOCS, F.col(q)).when(
        F.col("lang_docs") >= GROUP_DOCS, F.col(f"lang_{q}")
    ).otherwise(F.col(f"all_{q}"))
    fenced = joined.select("lang", "source", "measure", chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    picks = []
    for m, (_, tolerance, _) in MEASURES.items():
        away = FENCE * (F.col("q3") - F.col("q1")) + tolerance
        picks.append(F.max(F.when(F.col("measure") == m, F.col("q1") - away)).alias(f"{m}_low"))
        picks.append(F.max(F.when(F.col("measure") == m, F.col("q3") + away)).alias(f"{m}_high"))
    return fenced.groupBy("lang", "source").agg(*picks)


def judged(documents: DataFrame) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``."""
    measures = [F.coalesce(F.expr(f"try_divide({x.replace(' / ', ', ')})"), F.lit(0.0)).alias(m) for m, (x, *_) in MEASURES.items()]
    plain = counted(documents).withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("lang", "source")})
    stored = written(plain.select("*", *measures, base_failed().alias("base_failed")), "quality")
    limits = cut(cutoffs(sketches(stored.filter("not base_failed"))))
    fine = F.lit(True)
    for m, (_, _, sides) in MEASURES.items():
        for side in sides:
            limit = F.col(f"{m}_{side}")
            fine = fine & F.coalesce(F.col(m) >= limit if side == "low" else F.col(m) <= limit, F.lit(True))
    joined = stored.join(limits, ["lang", "source"], "left")
    return joined.select(
        "doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & fine).alias("kept"), "n_lines", *MEASURES
    )
