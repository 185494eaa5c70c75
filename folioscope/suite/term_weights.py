"""TF-IDF vocabularies and vectors over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tfidf
from ..plans.catalog import texts
from ..session import checkpointed
from .path_columns import KEYWORDS_SQL
from .registry import FILES_SQL, files, query
from .text_columns import words_sql

VOCABULARY_SQL = f"""with t as (select doc_id, unnest({words_sql('text')}) as term from documents),
    s as (select term, count(*) as cf, count(distinct doc_id) as df from t group by term),
    v as (select *, ln((1.0::double + (select count(*) from documents)) / (1.0::double + df)) + 1.0::double as idf
          from s where df >= 2)"""


@query(
    "tfidf_top_terms",
    f"{VOCABULARY_SQL} select term, cf, df, round(idf, 6) as idf from v",
)
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", tfidf.terms("text").alias("terms"))
    kept = tfidf.vocabulary(tfidf.term_statistics(docs, "terms"), docs.count(), None, 2)
    return kept.withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_vectors",
    f"""{VOCABULARY_SQL}, c as (select doc_id, term, count(*) as tf from t group by 1, 2),
    w as (select doc_id, term, tf, tf * idf as raw from c join v using (term))
    select doc_id, term, tf, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from w""",
)
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", tfidf.terms("text").alias("terms"))
    rows = tfidf.tfidf_vectors(docs, "doc_id", "terms", None, 2)
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_path_vectors",
    f"""{FILES_SQL}, w as (
      select file_id, regexp_extract_all(strip_accents({KEYWORDS_SQL.format('path')}), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from files),
    t as (select file_id, unnest(w) as term from w union all
          select file_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from w
          union all select file_id, unnest(list_transform(generate_series(1, len(w) - 2),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
    s as (select term, count(*) as cf, count(distinct file_id) as df from t group by term),
    v as (select *, ln((1.0::double + (select count(*) from files)) / (1.0::double + df)) + 1.0::double as idf
          from s order by cf desc, term limit 20000),
    c as (select file_id, term, count(*) as tf from t group by 1, 2),
    r as (select file_id, term, tf, tf * idf as raw from c join v using (term))
    select file_id, term, tf, round(raw / sqrt(sum(raw * raw) over (partition by file_id)), 6) as weight from r""",
)
def tfidf_path_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import keywords

    rows = files(spark, sf_dir).select(
        "file_id", tfidf.terms(keywords("path"), 1, 3, fold_accents=True).alias("terms")
    )
    weighted = tfidf.tfidf_vectors(rows, "file_id", "terms", 20_000, 1)
    return weighted.withColumn("weight", F.round("weight", 6))


@query(
    "fold_vocabularies",
    f"""with t as (select doc_id, unnest({words_sql('text')}) as term from documents), folds as (select unnest(range(5)) as held_out),
    s as (select held_out, term, count(*) as cf, count(distinct doc_id) as df from folds join t on doc_id % 5 <> held_out group by 1, 2),
    n as (select held_out, count(*) as docs from folds join documents on doc_id % 5 <> held_out group by 1)
    select held_out::int as held_out, term, cf::bigint as cf, df,
      round(ln((1.0::double + docs) / (1.0::double + df)) + 1.0::double, 6) as idf
    from s join n using (held_out) where df >= 2
    qualify row_number() over (partition by held_out order by cf desc, term) <= 200""",
)
def fold_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies of the five training parts, from terms counted once by fold."""
    docs = texts(spark, sf_dir).select((F.col("doc_id") % 5).cast("int").alias("fold"), tfidf.terms("text").alias("terms"))
    by_fold = checkpointed(tfidf.fold_statistics(docs, "terms", "fold"))
    sizes = {r["fold"]: r["count"] for r in docs.groupBy("fold").count().collect()}
    parts = []
    for held_out in range(5):
        rows = sum(n for fold, n in sizes.items() if fold != held_out)
        kept = tfidf.vocabulary(tfidf.training_statistics(by_fold, "fold", held_out), rows, 200, 2)
        parts.append(kept.select(F.lit(held_out).alias("held_out"), "term", "cf", "df", F.round("idf", 6).alias("idf")))
    return reduce(DataFrame.unionByName, parts)
