"""The operators over whole tables, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    credentials, decontaminate, fixity, html_text, manifest, near_dedup, oracle_sql, packing, paragraphs, pseudonyms, quality,
    resampling, tokens, toxicity, word_runs,
)
from .registry import query

SEQUENCE_TOKENS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_prefix_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokens.vocabulary_path(), SEQUENCE_TOKENS)


@query("op10_configuration_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path(), SEQUENCE_TOKENS)


@query("op8_bottom_k_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 5, 85)


@query("op1_noisy_channel_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
    )


@query("op7_tree_model_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    found = html_text.with_main_text(pages, html_text.fit(pages)).drop("html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op5_feistel_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(documents, "text", count="n_replaced")


@query("op9_adaptive_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op4_block_max_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_paragraph_banding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return word_runs.with_runs(paragraphs.repeated_passages(documents), documents)


# The replica that is audited: a byte of some pages is another one, and some records are lost.
FIXITY_SQL = """
select page_id, case when page_id % 389 = 7 then 'missing' else 'differs' end as status,
       cast(74 + strlen(coalesce(url, '')) + strlen(coalesce(html, '')) + length(cast(strlen(coalesce(html, '')) as varchar)) as bigint) as length
from pages where page_id % 389 = 7 or page_id % 97 = 5 and length(html) > 0 and ascii(html) < 128
"""


@query("op3_merkle_fixity_audit", FIXITY_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixity.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html", "_metadata"))
    flipped = (F.col("page_id") % 97 == 5) & (F.length("html") > 0) & (F.ascii("html") < 128)
    bad = F.concat(F.lit("\x7f"), F.substring("html", 2, 1 << 30))
    body = F.when(flipped, bad).otherwise(F.col("html"))
    damaged = pages.withColumn("record", fixity.response_record(F.col("url"), body))
    # Records that are lost shift those behind them in their file.
    replica = fixity.leaves(damaged.filter("coalesce(page_id % 389 <> 7, true)"), ["page_id"])
    found = fixity.audit(fixity.leaves(pages, ["page_id"]), replica, ["page_id"])
    return found.select("page_id", "status", "length")


@query("op11_credential_linking")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(table(spark, sf_dir, "documents"))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op12_path_copying_manifest", oracle_sql.manifest())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(*MANIFEST_FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = manifest.audited(documents, MANIFEST_FIELDS, tampered, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return found.drop("n_copies", "is_changed")


DRAW = {"buckets": 10_000, "percent": 10, "least_words": 20, "seed": 2024}


@query("op13_head_tail_resampling", oracle_sql.resampling(**DRAW))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 1, **DRAW)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
