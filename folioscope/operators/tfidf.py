"""TF-IDF as relations: term statistics, vocabulary and normalised weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ngrams, strip_accents, words
from ..session import checkpointed, small_side

# Upper bound of a vocabulary that is broadcast; larger ones are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Documents whose terms are counted at a time.
COUNTED_ROWS = 256


def terms(text: Column | str, low: int = 1, high: int = 1, fold_accents: bool = False) -> Column:
    """Word n-grams of a text, accents folded after lower-casing when asked."""
    source = F.col(text) if isinstance(text, str) else text
    if fold_accents:
        source = strip_accents(F.lower(source))
    return ngrams(words(source), low, high)


def term_statistics(documents: DataFrame, tokens: str) -> DataFrame:
    """Occurrences (``cf``) and documents (``df``) of every term.

    Each document is one row, so its counts are known without a shuffle and
    both totals travel in one exchange of per-task partial sums, which keeps
    frequent terms from piling up.
    """
    return (
        term_counts(documents, None, tokens)
        .groupBy("term")
        .agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    )


def fold_statistics(documents: DataFrame, tokens: str, fold: str) -> DataFrame:
    """Occurrences and documents of every term in every fold, from one pass over the texts.

    Like :func:`term_statistics`, with a row for each term and fold; store it and take each
    training part from it with :func:`training_statistics`.
    """
    return (
        term_counts(documents, fold, tokens)
        .groupBy("term", fold)
        .agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    )


def training_statistics(by_fold: DataFrame, fold: str, held_out: object) -> DataFrame:
    """Statistics of all documents less those of one fold; terms of that fold alone are gone."""
    own = ~F.col(fold).eqNullSafe(F.lit(held_out))
    totals = by_fold.groupBy("term").agg(
        *[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in ("cf", "df")]
    )
    return totals.filter(F.col("df") > 0)


def vocabulary(
    statistics: DataFrame, documents: int, max_features: int | None = None, min_df: int = 1
) -> DataFrame:
    """Terms kept, by corpus frequency then name, with their smoothed idf.

    A top-k alone would send ``max_features`` rows of every task to one. So the
    frequency that the last term kept must have is found first, from the number
    of terms per frequency; what reaches the top-k is the vocabulary and the
    ties at its end. Both branches read the same shuffled statistics.
    """
    kept = statistics.filter(F.col("df") >= min_df)
    if max_features is not None:
        rows = kept.groupBy("cf").agg(F.count(F.lit(1)).alias("_terms"))
        above = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)
        reached = rows.withColumn("_above", F.coalesce(F.sum("_terms").over(above), F.lit(0)))
        least = reached.filter(F.col("_above") < max_features).agg(F.min("cf")).scalar()
        kept = (
            kept.filter(F.col("cf") >= least)
            .orderBy(F.desc("cf"), F.asc("term"))
            .limit(max_features)
        )
    idf = F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0
    return kept.withColumn("idf", idf)


def term_counts(documents: DataFrame, identifier: str | None, tokens: str) -> DataFrame:
    """(id, term, tf) rows of every document, without a shuffle.

    Documents are counted in Arrow batches, a bounded number of them at a time.
    """
    names = [] if identifier is None else [identifier]
    schema = T.StructType(
        [*(documents.schema[n] for n in names), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                held = part.column(part.num_columns - 1)
                coded = pc.list_flatten(held).dictionary_encode(null_encoding="encode")
                terms, places = len(coded.dictionary), pc.list_parent_indices(held).to_numpy().astype(np.int64)
                keys, counts = np.unique(places * max(1, terms) + coded.indices.to_numpy(), return_counts=True)
                rows = pa.array(keys // max(1, terms))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in part.columns[:-1]), coded.dictionary.take(pa.array(keys % max(1, terms))), pa.array(counts, pa.int64())],
                    names=schema.names,
                )

    return documents.select(*names, F.col(tokens).alias("_tokens")).mapInArrow(count, schema)


def tfidf_vectors(
    documents: DataFrame,
    identifier: str,
    tokens: str,
    max_features: int | None = None,
    min_df: int = 1,
) -> DataFrame:
    """(id, term, tf, weight) rows with unit length per document.

    Three steps: count terms, keep the vocabulary, weigh. The vocabulary is
    broadcast where ``max_features`` bounds it or where it turns out to be
    small, so frequent terms aren't shuffled. The weighted rows are shuffled
    once, by document, for the norm.
    """
    vocab = vocabulary(
        term_statistics(documents, tokens), documents.count(), max_features, min_df
    ).select("term", "idf")
    if max_features is not None and max_features <= BROADCAST_TERMS:
        vocab = F.broadcast(vocab)
    else:
        # Stored, so that the texts are counted once for it whatever its size is.
        vocab = small_side(checkpointed(vocab), BROADCAST_TERMS)
    raw = (
        term_counts(documents, identifier, tokens)
        .join(vocab, "term")
        .withColumn("_raw", F.col("tf") * F.col("idf"))
    )
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(identifier)))
    return raw.select(identifier, "term", "tf", (F.col("_raw") / norm).alias("weight"))
