"""Upserts and replacements, the catalog split into a table and a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert as u
from ..plans.catalog import catalog
from .registry import FILES_SQL, files, query

COLUMNS = ["root_path", "path", "file_name", "size_bytes", "modified_by"]

# Two thirds are in the table; two thirds come in the batch, some of them twice.
SPLIT_SQL = f"""{FILES_SQL}, old as (
      select root_path, path, file_name, size_bytes, modified_by from files where file_id % 3 <> 0
    ), batch as (
      select root_path, path, file_name, size_bytes + 1 as size_bytes,
             case when file_id % 4 = 0 then null else modified_by end as modified_by, 1 as seq
      from files where file_id % 3 <> 1
      union all
      select case when file_id % 9 = 0 then '/srv/moved' else root_path end, path, file_name, size_bytes + 2,
             case when file_id % 4 = 2 then 'second' end, 2 from files where file_id % 6 = 0
    ), newest as (
      select * from batch qualify row_number() over (partition by path order by seq desc) = 1
    ), known as (
      select path, max_by(modified_by, seq) filter (where modified_by is not null) as owner
      from batch group by path
    )
"""


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = files(spark, sf_dir)
    number = F.col("file_id")
    first = rows.filter(number % 3 != 1).select(
        "root_path",
        "path",
        "file_name",
        (F.col("size_bytes") + 1).alias("size_bytes"),
        F.when(number % 4 != 0, F.col("modified_by")).alias("modified_by"),
        F.lit(1).alias("seq"),
    )
    second = rows.filter(number % 6 == 0).select(
        F.when(number % 9 == 0, "/srv/moved").otherwise(F.col("root_path")).alias("root_path"),
        "path",
        "file_name",
        (F.col("size_bytes") + 2).alias("size_bytes"),
        F.when(number % 4 == 2, "second").alias("modified_by"),
        F.lit(2).alias("seq"),
    )
    return rows.filter(number % 3 != 0).select(*COLUMNS), first.unionByName(second)


OVERWRITE_SQL = f"""{SPLIT_SQL} select * from old anti join newest using (path)
    union all by name select root_path, path, file_name, size_bytes, modified_by from newest"""


@query("upsert_overwrite", OVERWRITE_SQL)
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = split(spark, sf_dir)
    return u.upsert(old, batch, ["path"], "seq")


@query(
    "upsert_keep_old",
    f"""{SPLIT_SQL} select * from old anti join newest using (path) union all by name
    select n.root_path, n.path, n.file_name, n.size_bytes, coalesce(k.owner, o.modified_by) as modified_by
    from newest n join known k using (path) left join old o using (path)""",
)
def upsert_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = split(spark, sf_dir)
    return u.upsert(old, batch, ["path"], "seq", keep=["modified_by"])


@query(
    "upsert_run_batch",
    f"""{SPLIT_SQL}, per_run as (
      select root_path, path, max_by(file_name, seq) as file_name, max(seq) as last_seq,
             max_by(size_bytes, seq) as size_bytes,
             max_by(modified_by, seq) filter (where modified_by is not null) as owner
      from batch group by 1, 2)
    select * from old anti join per_run using (root_path, path) union all by name
    select p.root_path, p.path, p.file_name, p.size_bytes, coalesce(p.owner, o.modified_by) as modified_by
    from per_run p left join old o using (root_path, path)""",
)
def upsert_run_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = split(spark, sf_dir)
    return u.upsert(old, batch, ["root_path", "path"], "seq", keep=["modified_by"])


@query(
    "move_root",
    f"""with merged as ({OVERWRITE_SQL}) select root_path, count(*) as files,
      count(distinct path) as paths, sum(size_bytes)::bigint as size_bytes from merged group by 1""",
)
def move_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = split(spark, sf_dir)
    merged = u.upsert(old, batch, ["path"], "seq")
    return merged.groupBy("root_path").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct("path").alias("paths"),
        F.sum("size_bytes").alias("size_bytes"),
    )


@query(
    "clear_root",
    f"""{SPLIT_SQL} select * from old where root_path <> '/srv/src1' union all by name
    select root_path, path, file_name, size_bytes, modified_by from newest where root_path = '/srv/src1'""",
)
def clear_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = split(spark, sf_dir)
    scan = u.latest(batch, ["path"], "seq").filter(F.col("root_path") == "/srv/src1")
    return u.replace_root(old, scan, "/srv/src1")


@query(
    "replace_label",
    f"""{FILES_SQL}, labels_old as (
      select file_id, business_capability as business_category from files where business_capability is not null
    ), batch as (
      select file_id, coalesce(extension, '') as business_category, 1 as seq from files where file_id % 4 = 0
      union all select file_id, case when file_id % 16 = 0 then '' else 'relabelled' end, 2 from files where file_id % 8 = 0
    ), newest as (select * from batch qualify row_number() over (partition by file_id order by seq desc) = 1)
    select * from labels_old anti join newest using (file_id)
    union all select file_id, business_category from newest where business_category <> ''""",
)
def replace_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    number = F.col("file_id")
    labels = rows.filter("business_capability is not null").select(
        "file_id", F.col("business_capability").alias("business_category")
    )
    first = rows.filter(number % 4 == 0).select(
        "file_id", F.coalesce("extension", F.lit("")).alias("business_category"), F.lit(1).alias("seq")
    )
    second = rows.filter(number % 8 == 0).select(
        "file_id",
        F.when(number % 16 == 0, "").otherwise("relabelled").alias("business_category"),
        F.lit(2).alias("seq"),
    )
    return u.replace_labels(labels, first.unionByName(second), "seq")


@query(
    "replace_content",
    f"""{FILES_SQL}, batch as (
      select file_id, concat('new: ', content_text) as content_text, 1 as seq from catalog where file_id % 2 = 0
      union all select file_id, '', 2 from catalog where file_id % 10 = 0
    ), newest as (select * from batch qualify row_number() over (partition by file_id order by seq desc) = 1)
    select file_id, content_text from catalog anti join newest using (file_id)
    union all select file_id, content_text from newest""",
)
def replace_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select("file_id", "content_text")
    number = F.col("file_id")
    first = rows.filter(number % 2 == 0).select(
        "file_id", F.concat(F.lit("new: "), "content_text").alias("content_text"), F.lit(1).alias("seq")
    )
    second = rows.filter(number % 10 == 0).select(
        "file_id", F.lit("").alias("content_text"), F.lit(2).alias("seq")
    )
    return u.replace_content(rows, first.unionByName(second), "seq")


@query(
    "unreadable_dropped",
    f"""{FILES_SQL} select path, case when file_id % 5 <> 0 then modified_epoch end as created_epoch,
      case when file_id % 3 <> 0 then modified_epoch end as modified_epoch from files where file_id % 15 <> 0""",
)
def unreadable_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, epoch = F.col("file_id"), F.col("modified_epoch")
    rows = files(spark, sf_dir).select(
        "path",
        F.when(number % 5 != 0, epoch).alias("created_epoch"),
        F.when(number % 3 != 0, epoch).alias("modified_epoch"),
    )
    return u.drop_unreadable(rows, "created_epoch", "modified_epoch")


@query(
    "missing_paths_dropped",
    f"""{FILES_SQL} select file_id, case when file_id % 8 = 3 then null when file_id % 8 = 5 then '   ' else path end as path
    from files where file_id % 8 not in (3, 5) and business_capability is not null""",
)
def missing_paths_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("file_id") % 8
    path = F.when(kind == 3, None).when(kind == 5, "   ").otherwise(F.col("path"))
    rows = files(spark, sf_dir).select("file_id", path.alias("path"), "business_capability")
    kept = u.drop_blank_target(u.drop_missing_paths(rows, "path"), "business_capability")
    return kept.select("file_id", "path")
