"""Counts, shares, directories, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.directories import directory_rollup, files_with_directory
from ..plans.catalog import catalog, table
from .registry import FILES_SQL, FOLDER_SQL, files, labelled, query

LABELLED_SQL = f"{FILES_SQL}, labelled as (select * from files where business_capability is not null)"
PATH_CASE = "case when file_id % 13 = 0 then null when file_id % 17 = 0 then '  ' when file_id % 29 = 0 then root_path else path end"


@query(
    "ingest_stats",
    f"""{FILES_SQL}, listed as (
      select {PATH_CASE} as p, case when file_id % 19 = 0 then '' else content_text end as t,
             case when file_id % 23 = 0 then 'stat_error' end as e from catalog
    ), kept as (select *, coalesce(trim(p), '') <> '' as present from listed)
    select count(*) filter (where present and e is null) as inserted,
      count(*) filter (where present and e is not null) as errors,
      count(*) filter (where present and e is null and coalesce(t, '') = '') as empty_text,
      count(*) filter (where not present) as skipped_missing,
      count(distinct p) filter (where present and e is null) as distinct_files
    from kept""",
)
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select(
        F.expr(PATH_CASE).alias("p"),
        F.when(F.col("file_id") % 19 == 0, "").otherwise(F.col("content_text")).alias("t"),
        F.when(F.col("file_id") % 23 == 0, "stat_error").alias("e"),
    )
    return stats.ingest_stats(rows, "p", "t", "e")


@query(
    "class_counts",
    f"{FILES_SQL} select business_capability, count(*) as n from files group by 1",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(files(spark, sf_dir), "business_capability")


@query(
    "class_shares",
    f"""{LABELLED_SQL} select business_capability,
      round(count(*) / (select count(*) from labelled), 9) as share from labelled group by 1""",
)
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = stats.value_shares(labelled(spark, sf_dir), "business_capability")
    return shares.withColumn("share", F.round("share", 9))


@query(
    "top_extensions",
    f"""{FILES_SQL} select extension, count(*) as n from files group by 1
    order by n desc, extension nulls first limit 20""",
)
def top_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(files(spark, sf_dir), "extension")


@query(
    "majority_class",
    f"""{LABELLED_SQL} select business_capability, count(*) as n from labelled group by 1
    order by n desc, business_capability limit 1""",
)
def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.majority_class(labelled(spark, sf_dir), "business_capability")


@query(
    "column_profile",
    FILES_SQL
    + " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as distinct_values,
        count(*) filter (where trim(coalesce({c}, '')) <> '') as non_blank, count(*) as row_count from files"""
        for c in ("extension", "modified_by", "business_capability", "subfolder", "path")
    ),
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["extension", "modified_by", "business_capability", "subfolder", "path"]
    return stats.column_profile(files(spark, sf_dir), names)


@query(
    "min_class_folds",
    f"""{LABELLED_SQL}, c as (select count(*) as n from labelled group by business_capability)
    select min(n) as min_class_count, greatest(2, least(5, min(n)))::bigint as folds from c""",
)
def min_class_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fold_plan(labelled(spark, sf_dir), "business_capability", 5)


@query(
    "balanced_weights",
    f"""{LABELLED_SQL}, c as (select business_capability, count(*) as n from labelled group by 1)
    select file_id, business_capability,
      round((select sum(n) from c)::double / (select count(*) from c) / n, 9) as weight
    from labelled join c using (business_capability)""",
)
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.with_balanced_weights(labelled(spark, sf_dir), "business_capability")
    return rows.select("file_id", "business_capability", F.round("weight", 9).alias("weight"))


@query(
    "impute_median_mode",
    """with raw as (select l_orderkey, l_linenumber, case when l_partkey % 5 = 0 then null else l_extendedprice end as price,
        case when l_partkey % 4 = 0 then null else l_tax end as tax,
        case when l_suppkey % 3 = 0 then null else l_returnflag end as flag from lineitem),
    flags as (select flag from raw where flag is not null group by flag order by count(*) desc, flag limit 1)
    select l_orderkey, l_linenumber, coalesce(price, (select median(price) from raw)) as price,
      coalesce(tax, (select median(tax) from raw)) as tax,
      coalesce(flag, (select flag from flags)) as flag from raw""",
)
def impute_median_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("flag"),
    )
    return stats.impute(raw, stats.impute_values(raw, ["price", "tax"], ["flag"]))


@query(
    "standard_scale",
    """select l_orderkey, l_linenumber,
      round((l_quantity - avg(l_quantity) over ()) / coalesce(nullif(stddev_pop(l_quantity) over (), 0), 1), 6) as l_quantity_scaled,
      round((l_extendedprice - avg(l_extendedprice) over ()) / coalesce(nullif(stddev_pop(l_extendedprice) over (), 0), 1), 6) as l_extendedprice_scaled
    from lineitem""",
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names)
    done = stats.scaled(rows, stats.fit_scaling(rows, names))
    return done.select(
        "l_orderkey", "l_linenumber", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in names]
    )


@query(
    "scale_without_centre",
    """select doc_id, round(n_chars / coalesce(nullif(stddev_pop(n_chars) over (), 0), 1), 6) as n_chars_scaled
    from documents""",
)
def scale_without_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    done = stats.scaled(rows, stats.fit_scaling(rows, ["n_chars"]), centre=False)
    return done.select("doc_id", F.round("n_chars_scaled", 6).alias("n_chars_scaled"))


ROLLUP_SQL = f"""{FILES_SQL}, folders as (
      select root_path, {FOLDER_SQL.format('path')} as folder, count(*) as own from files group by 1, 2
    ), steps as (select *, string_split(folder, '/') as s, len(string_split(root_path, '/')) as base from folders),
    lineage as (select root_path, own, folder, s, unnest(generate_series(base, len(s))) as k from steps),
    dirs as (
      select root_path, array_to_string(s[1:k], '/') as path,
             sum(case when k = len(s) then own else 0 end)::bigint as num_files
      from lineage group by 1, 2
    ), named as (
      select *, case when path = root_path then null else {FOLDER_SQL.format('path')} end as parent_path from dirs
    ), children as (select parent_path, count(*) as num_subdirs from named where parent_path is not null group by 1)
"""


@query(
    "directory_rollup",
    f"""{ROLLUP_SQL} select n.root_path, n.path, n.parent_path, string_split(n.path, '/')[-1] as name,
      (len(string_split(n.path, '/')) - len(string_split(n.root_path, '/')))::int as depth, n.num_files,
      coalesce(c.num_subdirs, 0) as num_subdirs
    from named n left join children c on c.parent_path = n.path""",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_rollup(files(spark, sf_dir))


@query(
    "files_with_dir",
    f"""{ROLLUP_SQL} select f.path, d.path as folder, d.num_files as dir_num_files
    from files f join dirs d on d.path = {FOLDER_SQL.format('f.path')}""",
)
def with_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("root_path", "path")
    joined = files_with_directory(rows, directory_rollup(rows), ["num_files"])
    return joined.select("path", "folder", "dir_num_files")
