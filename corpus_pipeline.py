"""Training corpus from raw documents: five stages, each written and read again before the next.

Toxic documents go, one document of each group of near duplicates stays, documents
with test items go, personal numbers become pseudonyms, and what is left is packed
into sequences. Each stage sees all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, near_dedup, packing, pseudonyms, tokens, toxicity
from folioscope.llm.common import fresh
from folioscope.session import shared_dir

SEQUENCE_TOKENS = 2048
# Models and similarity joins have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, flag = fresh(docs, "_toxicity"), fresh(docs, "_is_toxic")
    return toxicity.score(docs, labels, out=score, flag=flag).filter(~F.col(flag)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = pseudonyms.pseudonymised(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else hidden


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.vocabulary_path(), SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", hide_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
