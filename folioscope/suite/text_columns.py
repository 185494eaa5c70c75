"""Text clean-up, words, numbers and timestamps over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.tfidf import term_statistics, terms
from ..plans.catalog import catalog, table, texts
from .registry import FILES_SQL, files, query

SPACE = text.SPACE


def normal_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '[{SPACE}]+', ' ', 'g'))"


def printable_sql(column: str) -> str:
    spaces = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
    return rf"regexp_replace({column}, '[\p{{C}}\p{{Zl}}\p{{Zp}}{spaces}]', '', 'g')"


def words_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{text.WORD}')"


@query(
    "html_text",
    "select page_id, "
    + normal_sql(
        r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'),"
        r" '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    )
    + " as body from pages",
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id").select("page_id", text.strip_html("html").alias("body"))


@query("text_normalised", f"select doc_id, {normal_sql('text')} as body from documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.normalise("text").alias("body"))


@query(
    "text_printable",
    f"""select doc_id, {printable_sql('text')} as text, {printable_sql('lang')} as lang,
      {printable_sql('source')} as source from documents""",
)
def text_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return text.printable_frame(rows)


@query(
    "text_truncated",
    """select doc_id, left(text, 100000) as reader_text, left(text, 5000) as feature_text,
      left(text, 2000) as preview from documents""",
)
def text_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id",
        text.truncate("text", 100_000).alias("reader_text"),
        text.truncate("text", 5_000).alias("feature_text"),
        text.truncate("text", 2_000).alias("preview"),
    )


@query(
    "word_counts",
    f"""select conv_id, turn, length(text)::int as content_char_len,
      len(regexp_extract_all(text, '[^{SPACE}]+'))::int as content_word_count,
      (length(text) > 0)::int as has_content from conversations
    union all
    select doc_id, -1, length(text)::int, len(regexp_extract_all(text, '[^{SPACE}]+'))::int,
      (length(text) > 0)::int from documents""",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = texts(spark, sf_dir).select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"
    )
    measures = text.content_measures("text")
    return talk.unionByName(docs).withColumns(measures).drop("text")


@query(
    "tokens",
    f"""with t as (select doc_id, unnest({words_sql('text')}) as term from documents)
    select term, count(*) as cf, count(distinct doc_id) as df from t group by term""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select(terms("text").alias("terms"))
    return term_statistics(docs, "terms")


@query(
    "bigrams",
    f"""with w as (select doc_id, {words_sql('text')} as w from documents),
    t as (select doc_id, unnest(w) as term from w union all
          select doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
          from w)
    select term, count(*) as cf, count(distinct doc_id) as df from t group by term""",
)
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select(terms("text", 1, 2).alias("terms"))
    return term_statistics(docs, "terms")


@query(
    "path_trigrams",
    f"""{FILES_SQL}, w as (select file_id, {words_sql('path')} as w from files),
    t as (select file_id, unnest(w) as term from w union all
          select file_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
          from w union all
          select file_id, unnest(list_transform(generate_series(1, len(w) - 2),
                 lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w)
    select term, count(*) as cf, count(distinct file_id) as df from t group by term""",
)
def path_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(terms("path", 1, 3).alias("terms"))
    return term_statistics(rows, "terms")


@query("accent_fold", "select doc_id, strip_accents(text) as body from documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.strip_accents("text").alias("body"))


@query(
    "iso_timestamps",
    f"""{FILES_SQL} select path, case when file_id % 7 = 0 then ''
      else strftime(make_timestamp(modified_epoch * 1000000), '%Y-%m-%dT%H:%M:%S') end as modified_iso
    from files""",
)
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("file_id") % 7 != 0, F.col("modified_epoch"))
    stamp = text.iso_timestamp(text.epoch_timestamp(known))
    return files(spark, sf_dir).select("path", stamp.alias("modified_iso"))


@query(
    "numeric_coerce",
    """with raw as (select event_id, case event_id % 4 when 0 then value::varchar when 1 then 'n/a'
         when 2 then 'nan' else json_extract_string(props, '$.k') end as raw_value from events)
    select event_id, raw_value, case when raw_value = 'nan' then 0
      else coalesce(try_cast(raw_value as double), 0) end::double as number from raw""",
)
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.col("value").cast("string"))
        .when(kind == 1, "n/a")
        .when(kind == 2, "nan")
        .otherwise(F.get_json_object("props", "$.k"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw_value"))
    return rows.withColumn("number", text.to_number("raw_value"))


@query(
    "fill_blank",
    f"""{FILES_SQL} select path, coalesce(modified_by, '') as modified_by,
      coalesce(business_capability, '') as business_capability,
      coalesce(extension, '') as extension, trim(coalesce(modified_by, '  ')) as owner_path from files""",
)
def fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(
        "path", "modified_by", "business_capability", "extension",
        text.safe_path(F.concat(F.lit("  "), "modified_by", F.lit(" "))).alias("owner_path"),
    )
    return text.fill_blank(rows, ["modified_by", "business_capability", "extension"])


@query(
    "joined_text",
    f"""{FILES_SQL} select f.file_id, concat_ws(' ', coalesce(c.content_text, ''), f.path,
      coalesce(f.modified_by, '')) as joined from files f join catalog c using (file_id)""",
)
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    joined = text.join_text(rows, ["content_text", "path", "notes_text", "modified_by"])
    return rows.select("file_id", joined.alias("joined"))
