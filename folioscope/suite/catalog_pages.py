"""Filters, sorts, pages and distinct lists over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed_values import with_extension_family
from ..operators import query as q
from ..operators.joins import file_detail, training_set
from ..operators.upsert import drop_blank_target
from ..plans.catalog import catalog
from ..session import shared_dir
from ..sources.ranked_table import RankedTable
from ..sources.substring_index import SubstringIndex
from .path_columns import FAMILY_SQL
from .registry import FILES_SQL, SUFFIX_SQL, files, query

COLUMNS = ["root_path", "path", "file_name", "subfolder", "extension", "size_bytes", "modified_epoch", "modified_by"]
SELECT = ", ".join(COLUMNS)


@query(
    "catalog_page",
    f"""{FILES_SQL}, family as ({FAMILY_SQL})
    select {SELECT}, coalesce(family, 'other') as extension_family
    from files left join family on lower({SUFFIX_SQL.format('file_name')}) = suffix
    where contains(lower(subfolder), 'q2')
      and coalesce(family, 'other') in ('text', 'tabular', 'pdf', 'excel', 'other')
    order by subfolder nulls first, file_name, path limit 50""",
)
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_extension_family(
        q.CatalogFilter(subfolder_contains="q2")
        .apply(files(spark, sf_dir))
        .select(*COLUMNS, paths.suffix("file_name").alias("_suffix")),
        "_suffix",
    ).drop("_suffix")
    wanted = rows.filter(F.col("extension_family").isin("text", "tabular", "pdf", "excel", "other"))
    return q.page(wanted, q.catalog_order("subfolder", "ASC"), 0)


@query(
    "catalog_page_root",
    f"""{FILES_SQL} select {SELECT} from files where root_path = '/srv/src1'
    order by size_bytes desc nulls last, file_name, path limit 15 offset 15""",
)
def catalog_page_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.CatalogFilter(equals={"root_path": "/srv/src1"}).apply(files(spark, sf_dir))
    return q.page(rows.select(*COLUMNS), q.catalog_order("size_bytes", "desc"), 1, 15)


@query(
    "catalog_page_multikey",
    f"""{FILES_SQL} select {SELECT} from files
    order by extension desc nulls last, modified_by asc nulls first, file_name desc, path
    limit 50 offset 100""",
)
def catalog_page_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = q.audit_order([("extension", "desc"), ("modified_by", "asc"), ("file_name", "down")])
    return q.page(files(spark, sf_dir).select(*COLUMNS), order, 2)


@query(
    "catalog_page_deep",
    f"""{FILES_SQL} select {SELECT} from files
    order by file_name nulls first, path limit 50 offset 150""",
)
def catalog_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.page(files(spark, sf_dir).select(*COLUMNS), q.audit_order([]), 3, deep_after=0)


@query(
    "catalog_page_after",
    f"""{FILES_SQL} select {SELECT} from files
    order by subfolder, file_name, path limit 50 offset 50""",
)
def catalog_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = files(spark, sf_dir).select(*COLUMNS), ["subfolder", "file_name", "path"]
    first = q.page(rows.select(*keys), [F.asc(k) for k in keys], 0).tail(1)[0]
    return q.page_after(rows, keys, list(first))


@query(
    "catalog_page_count",
    f"""{FILES_SQL} select count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as pages
    from files where coalesce(subfolder, '/') = '/' or contains(lower(subfolder), 'q3 rep')""",
)
def catalog_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    wanted = q.CatalogFilter(subfolder_contains="Q3 REP").predicate() | (F.col("subfolder") == "/")
    return q.page_total(rows.filter(wanted))


@query(
    "ext_filter_null_as_blank",
    f"""{FILES_SQL} select {SELECT} from files where coalesce(extension, '') in ('', 'txt', 'gz')""",
)
def ext_filter_null_as_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.CatalogFilter(extensions=["", "txt", "gz"]).apply(files(spark, sf_dir)).select(*COLUMNS)


@query(
    "ext_filter_strict",
    f"""{FILES_SQL} select {SELECT} from files where extension in ('', 'txt', 'gz')""",
)
def ext_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.CatalogFilter(extensions=["", "txt", "gz"], null_as_blank=False)
    return wanted.apply(files(spark, sf_dir)).select(*COLUMNS)


@query(
    "subfolder_like_nocase",
    f"""{FILES_SQL} select {SELECT} from files where lower(subfolder) like '%e%/q_ r%'""",
)
def subfolder_like_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.CatalogFilter(subfolder_contains="E%/q_ R", null_as_blank=False)
    return wanted.apply(files(spark, sf_dir)).select(*COLUMNS)


def _indexed(spark: SparkSession, sf_dir: str) -> SubstringIndex:
    """An index of the catalog by path, its second half added later."""
    rows = files(spark, sf_dir).select(*COLUMNS)
    made = SubstringIndex.create(rows.filter("size_bytes % 2 = 0 or size_bytes is null"), shared_dir(spark, "index"), "path", 500)
    made.add(rows.filter("size_bytes % 2 <> 0"))
    return made


def _ranked(spark: SparkSession, sf_dir: str) -> RankedTable:
    """The catalog in the order of sizes, with counts by root and extension."""
    rows = files(spark, sf_dir).select(*COLUMNS)
    return RankedTable.create(rows, shared_dir(spark, "ranked"), q.catalog_order("size_bytes", "DESC"), ["root_path", "extension"], 200)


@query("ranked_page_deep", f"{FILES_SQL} select {SELECT} from files order by size_bytes desc nulls last, file_name, path limit 20 offset 140")
def ranked_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the stored order, from the blocks that hold it."""
    return _ranked(spark, sf_dir).page(7, 20)


@query(
    "ranked_page_filtered",
    f"""{FILES_SQL} select {SELECT} from files where root_path = '/srv/src0' and extension is null
    order by size_bytes desc nulls last, file_name, path limit 5 offset 5""",
)
def ranked_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).page(1, 5, {"root_path": "/srv/src0", "extension": None})


@query("path_search", f"{FILES_SQL} select {SELECT} from files where contains(lower(path), 'de/q2 reports/doc-1')")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that hold a text, from the blocks whose posting lists allow it."""
    return _indexed(spark, sf_dir).search("DE/Q2 Reports/Doc-1", literal=True)


@query("path_search_wildcards", f"{FILES_SQL} select {SELECT} from files where lower(path) like '%src_/en%doc-%_v2.csv%'")
def path_search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).search("Src_/EN%doc-%_V2.csv")


@query("distinct_roots", f"{FILES_SQL} select distinct root_path from files")
def distinct_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.distinct_values(files(spark, sf_dir), "root_path")


@query("distinct_extensions", f"{FILES_SQL} select distinct coalesce(extension, '') as extension from files")
def distinct_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.distinct_values(files(spark, sf_dir), "extension", "")


@query(
    "distinct_extensions_strict",
    f"{FILES_SQL} select distinct extension from files where root_path = '/srv/src2'",
)
def distinct_extensions_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.CatalogFilter(equals={"root_path": "/srv/src2"}).apply(files(spark, sf_dir))
    return q.distinct_values(rows, "extension")


@query(
    "distinct_subfolders",
    f"{FILES_SQL} select distinct coalesce(nullif(subfolder, '/'), '/') as subfolder from files",
)
def distinct_subfolders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("subfolder", F.nullif(F.col("subfolder"), F.lit("/")))
    return q.distinct_values(rows, "subfolder", "/")


@query(
    "file_lookup",
    f"{FILES_SQL} select {SELECT} from files where root_path = '/srv/src0' and file_name = 'Doc-0_v0.txt'",
)
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.lookup(files(spark, sf_dir), root_path="/srv/src0", file_name="Doc-0_v0.txt")
    return found.select(*COLUMNS)


def reader_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog as separate file, label and content tables."""
    whole = catalog(spark, sf_dir)
    labels = drop_blank_target(whole, "business_capability").select(
        "file_id", F.col("business_capability").alias("business_category")
    )
    return files(spark, sf_dir), labels, whole.select("file_id", "content_text")


@query(
    "training_set",
    f"""{FILES_SQL} select f.file_id,
      array_to_string(list_concat(regexp_extract_all(lower(f.path), '[a-z0-9]+'),
        case when contains(f.path, '.') and string_split(f.path, '.')[-1] <> ''
             then ['ext_' || string_split(lower(f.path), '.')[-1]] else [] end), ' ') as path_tokens,
      coalesce(c.content_text, '') as content_text, coalesce(extension, '') as extension,
      f.business_capability as business_category
    from files f join catalog c using (file_id) where f.business_capability is not null""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_set(*reader_tables(spark, sf_dir))


@query(
    "summary_listing",
    f"""{FILES_SQL} select file_id, file_name, extension, size_bytes,
      coalesce(business_capability, '') as business_category from files""",
)
def summary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels, _ = reader_tables(spark, sf_dir)
    listing = q.summary_listing(rows, labels)
    return listing.select("file_id", "file_name", "extension", "size_bytes", "business_category")


@query(
    "summary_listing_limited",
    f"""{FILES_SQL} select file_id, path, coalesce(business_capability, '') as business_category
    from files order by file_id limit 25""",
)
def summary_listing_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels, _ = reader_tables(spark, sf_dir)
    return q.summary_listing(rows, labels, 25).select("file_id", "path", "business_category")


@query(
    "file_detail",
    f"""{FILES_SQL} select f.file_id, f.path, coalesce(f.business_capability, '') as labels,
      coalesce(c.content_text, '') as content_text
    from files f join catalog c using (file_id)""",
)
def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = file_detail(*reader_tables(spark, sf_dir))
    return found.select("file_id", "path", F.array_join("labels", "|").alias("labels"), "content_text")


@query(
    "peek",
    f"""{FILES_SQL} select f.file_id, f.path, left(c.content_text, 2000) as preview
    from files f join catalog c using (file_id) order by f.file_id limit 30""",
)
def peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, content = reader_tables(spark, sf_dir)
    return q.peek(rows.select("file_id", "path"), content, 30)
