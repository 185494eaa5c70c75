"""Path and name features over the whole catalog and the page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed_values import (
    EXTENSION_FAMILIES,
    mime_compound_suffixes,
    mime_encodings,
    mime_types,
    with_extension_family,
    with_mime_type,
)
from ..operators.stats import value_counts
from ..plans.catalog import table
from .registry import FILES_SQL, FOLDER_SQL, SUFFIX_SQL, files, query


def _values_sql(pairs: dict[str, str], key: str, value: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(pairs.items()))
    return f"select * from (values {rows}) as t({key}, {value})"


FAMILY_SQL = _values_sql(EXTENSION_FAMILIES, "suffix", "family")
MIME_SQL = _values_sql(mime_types(), "mime_key", "mime")

KEYWORDS_SQL = "trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')))"
PARTS_SQL = "list_filter(string_split({0}, '/'), lambda x: x not in ('', '.'))"
FOLD_SQL = (
    "'/' || array_to_string(list_reduce(" + PARTS_SQL + ", lambda kept, part: "
    "case when part = '..' then kept[:-2] else list_append(kept, part) end, []::varchar[]), '/')"
)
LAST_SQL = r"regexp_extract({0}, '(?s)[^.].*(\.[^.]*)$', 1)"
STEM_SQL = f"left(file_name, length(file_name) - length({SUFFIX_SQL.format('file_name')}))"


@query(
    "path_parts",
    f"""{FILES_SQL} select path, {FOLDER_SQL.format('path')} as folder, string_split(path, '/')[-1] as name,
      {STEM_SQL} as stem, {SUFFIX_SQL.format('file_name')} as suffix, coalesce(extension, '') as extension,
      modified_by as created_by, modified_by
    from files""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumns(paths.owner_columns("modified_by"))
    name = paths.file_name("path")
    return rows.select(
        "path",
        paths.folder("path").alias("folder"),
        name.alias("name"),
        paths.stem(name).alias("stem"),
        paths.suffix(name).alias("suffix"),
        paths.extension_key(name).alias("extension"),
        "created_by",
        "modified_by",
    )


@query(
    "path_keywords",
    f"""{FILES_SQL} select path, {KEYWORDS_SQL.format('path')} as path_keywords,
      {KEYWORDS_SQL.format('file_name')} as name_keywords, {KEYWORDS_SQL.format(STEM_SQL)} as stem_keywords,
      len(regexp_extract_all({KEYWORDS_SQL.format('path')}, '[^ ]+'))::int as path_token_count
    from files""",
)
def path_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(
        "path",
        paths.keywords("path").alias("path_keywords"),
        paths.keywords("file_name").alias("name_keywords"),
        paths.keywords(paths.stem("file_name")).alias("stem_keywords"),
        paths.keyword_count(paths.keywords("path")).alias("path_token_count"),
    )


@query(
    "url_keywords",
    f"""select page_id, {KEYWORDS_SQL.format('url')} as keywords,
      (len({PARTS_SQL.format('url')}))::int as depth,
      array_to_string(list_concat(regexp_extract_all(lower(url), '[a-z0-9]+'),
        case when contains(url, '.') and string_split(url, '.')[-1] <> ''
             then ['ext_' || string_split(lower(url), '.')[-1]] else [] end), ' ') as tokens
    from pages""",
)
def url_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        paths.keywords("url").alias("keywords"),
        paths.depth("url").alias("depth"),
        paths.path_tokens("url").alias("tokens"),
    )


@query(
    "path_depth",
    f"""{FILES_SQL} select path, (len({PARTS_SQL.format('path')}) + 1)::int as depth from files""",
)
def path_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", paths.depth("path").alias("depth"))


@query(
    "path_resolve",
    f"""{FILES_SQL}, raw as (
      select file_id, case when file_id % 3 = 0 then path
                           when file_id % 3 = 1 then concat('./x/../', subfolder, '//', file_name)
                           else concat('../../../../up/', file_name) end as raw_path,
             root_path from files
    ), whole as (select *, case when starts_with(raw_path, '/') then raw_path
                                else concat(root_path, '/', raw_path) end as p from raw)
    select file_id, raw_path, {FOLD_SQL.format('p')} as resolved_path from whole""",
)
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("file_id") % 3
    raw = (
        F.when(kind == 0, F.col("path"))
        .when(kind == 1, F.concat(F.lit("./x/../"), "subfolder", F.lit("//"), "file_name"))
        .otherwise(F.concat(F.lit("../../../../up/"), "file_name"))
    )
    rows = files(spark, sf_dir).select("file_id", "root_path", raw.alias("raw_path"))
    return rows.select("file_id", "raw_path", paths.resolve("raw_path", "root_path").alias("resolved_path"))


@query(
    "path_tokens",
    f"""{FILES_SQL} select path,
      array_to_string(list_concat(regexp_extract_all(lower(path), '[a-z0-9]+'),
        case when contains(path, '.') and string_split(path, '.')[-1] <> ''
             then ['ext_' || string_split(lower(path), '.')[-1]] else [] end), ' ') as tokens
    from files""",
)
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", paths.path_tokens("path").alias("tokens"))


@query(
    "subfolder_relative",
    f"""{FILES_SQL}, parents as (
      select path, root_path, {FOLDER_SQL.format('path')} as parent,
             case when file_id % 4 = 0 then '/elsewhere' else root_path end as base from files)
    select path, base, case when parent = base then '/'
             when starts_with(parent, base || '/') then substr(parent, length(base) + 2)
             else parent end as subfolder from parents""",
)
def subfolder_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("file_id") % 4 == 0, "/elsewhere").otherwise(F.col("root_path"))
    rows = files(spark, sf_dir).select("path", base.alias("base"))
    return rows.withColumn("subfolder", paths.subfolder("base", "path"))


@query(
    "path_stats",
    f"""{FILES_SQL} select path, length(path)::int as path_char_len, length(file_name)::int as name_char_len,
      length(regexp_replace(file_name, '[^0-9]', '', 'g'))::int as name_digit_count
    from files""",
)
def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(
        "path",
        F.length("path").alias("path_char_len"),
        F.length("file_name").alias("name_char_len"),
        paths.digit_count("file_name").alias("name_digit_count"),
    )


@query(
    "extension_family_counts",
    f"""{FILES_SQL}, family as ({FAMILY_SQL})
    select coalesce(family, 'other') as extension_family, count(*) as n
    from files left join family on lower({SUFFIX_SQL.format('file_name')}) = suffix group by 1""",
)
def extension_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(paths.suffix("file_name").alias("suffix"))
    return value_counts(with_extension_family(rows, "suffix"), "extension_family")


def _mime_key_sql(name: str) -> str:
    last = LAST_SQL.format(name)
    before = LAST_SQL.format(f"left({name}, length({name}) - length({last}))")
    encodings = ", ".join(f"'{e}'" for e in mime_encodings())
    compound = " ".join(
        f"when lower({last}) = '{short}' then '{carrier}'"
        for short, carrier in sorted(mime_compound_suffixes().items())
    )
    return f"case when {last} in ({encodings}) then lower({before}) {compound} else lower({last}) end"


@query(
    "mime_counts",
    f"""{FILES_SQL}, mime as ({MIME_SQL})
    select coalesce(mime, '') as mime_type, count(*) as n
    from files left join mime on {_mime_key_sql('file_name')} = mime_key group by 1""",
)
def mime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(paths.mime_key("file_name").alias("key"))
    return value_counts(with_mime_type(rows, "key"), "mime_type")
