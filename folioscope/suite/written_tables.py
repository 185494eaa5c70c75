"""Queries over tables that the sinks wrote: partitioned catalogs and feature CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import query as q
from ..plans.catalog import table
from ..session import shared_dir
from ..sources import sinks, tables
from .catalog_pages import COLUMNS, SELECT
from .registry import FILES_SQL, files, query

# A root whose name needs escaping in a folder name.
ODD_ROOT = "/srv/a&b (ü)=%20"


def _written(spark: SparkSession, rows: DataFrame) -> str:
    path = shared_dir(spark, "catalog")
    sinks.write_catalog(rows, path)
    return path


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(*COLUMNS)
    return spark.read.schema(rows.schema.add("subfolder_lc", "string")).parquet(_written(spark, rows))


@query(
    "written_catalog_page",
    f"""{FILES_SQL} select {SELECT} from files where root_path = '/srv/src3'
      and coalesce(extension, '') in ('', 'csv', 'html', 'pdf') and contains(lower(coalesce(subfolder, '/')), 'reports')
    order by subfolder nulls first, file_name, path limit 50""",
)
def written_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.CatalogFilter({"root_path": "/srv/src3"}, ["", "csv", "html", "pdf"], "Reports")
    return q.page(wanted.apply(_stored(spark, sf_dir)).select(*COLUMNS), q.catalog_order())


@query(
    "written_catalog_count",
    f"""{FILES_SQL} select count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as pages
    from files where root_path <> '/srv/src0' and contains(lower(coalesce(subfolder, '/')), '/q3')""",
)
def written_catalog_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.CatalogFilter(subfolder_contains="/Q3").apply(_stored(spark, sf_dir))
    return q.page_total(wanted.filter(F.col("root_path") != "/srv/src0"))


@query(
    "written_catalog_extensions",
    f"{FILES_SQL} select distinct coalesce(extension, '') as extension from files where root_path = '/srv/src5'",
)
def written_catalog_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.CatalogFilter({"root_path": "/srv/src5"}).apply(_stored(spark, sf_dir))
    return q.distinct_values(rows, "extension", "")


@query(
    "overwritten_root",
    f"""{FILES_SQL} select case when root_path = '/srv/src1' then '{ODD_ROOT}' else root_path end as root_path, path, subfolder
    from files where root_path <> '/srv/src2' and (root_path <> '/srv/src1' or size_bytes % 2 = 0)""",
)
def overwritten_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog in which one root was scanned anew and another one is empty now."""
    odd = F.when(F.col("root_path") == "/srv/src1", F.lit(ODD_ROOT)).otherwise(F.col("root_path"))
    rows = files(spark, sf_dir).select(odd.alias("root_path"), "path", "subfolder", "extension", "size_bytes")
    path = _written(spark, rows)
    sinks.overwrite_root(rows.filter((F.col("root_path") == ODD_ROOT) & (F.col("size_bytes") % 2 == 0)), path, ODD_ROOT)
    sinks.overwrite_root(rows.limit(0), path, "/srv/src2")
    return spark.read.parquet(path).select("root_path", "path", "subfolder")


@query("feature_csv", "select doc_id, text, n_chars::double as n_chars from documents where text <> ''")
def feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks, written as CSV and read back."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text", "n_chars")
    path = shared_dir(spark, "csv")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("n_chars", "double")
    return tables.feature_table(spark, path, schema)
