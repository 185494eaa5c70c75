"""Tree scans, extraction and ingest over files made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.catalog import catalog, table, texts
from ..plans.features import feature_frame
from ..plans.ingest import Ingested, ingest
from ..session import shared_dir
from ..sources import crawl, extract, tables, tree
from .path_columns import FAMILY_SQL, FOLD_SQL, KEYWORDS_SQL, MIME_SQL, _mime_key_sql
from .registry import FILES_SQL, SUFFIX_SQL, query
from .text_columns import normal_sql, printable_sql

SPACE_OUT = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"


@query(
    "scan_written_tree",
    """select lang, source, sum(octet_length(encode(text)) + 1)::bigint as size_bytes
    from documents group by lang, source""",
)
def scan_written_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written out as a tree of text files, then listed."""
    folder = shared_dir(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("text").alias("value"))
    docs.write.partitionBy("lang", "source").text(folder)
    listed = tree.scan_tree(spark, folder)
    parts = F.split(paths.folder("path"), "/")
    return (
        listed.select(
            F.regexp_replace(F.element_at(parts, -2), "^lang=", "").alias("lang"),
            F.regexp_replace(F.element_at(parts, -1), "^source=", "").alias("source"),
            "size_bytes",
        )
        .groupBy("lang", "source")
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )


CRAWLED_SQL = """
with leaves as (
  select concat('/lang=', lang, '/source=', source) as path, sum(octet_length(encode(text)) + 1)::bigint as size_bytes
  from documents group by lang, source
), tree as (
  select '' as path, 0 as depth, (select count(distinct lang) from documents)::bigint as num_subdirs, null as size_bytes
  union all select concat('/lang=', lang), 1, count(distinct source), null from documents group by lang
  union all select path, 2, 0, size_bytes from leaves
)
"""


def _tree_of_documents(spark: SparkSession, sf_dir: str) -> str:
    """Documents written out as a tree of text files by language and source."""
    folder = shared_dir(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("text").alias("value"))
    docs.write.partitionBy("lang", "source").text(folder)
    return folder


def _crawled_sizes(crawled: DataFrame) -> DataFrame:
    """Directories below the root with the size of the visible files in them."""
    sizes = crawled.filter("kind = 'file' and not name rlike '^[._]'").groupBy(F.col("parent_path").alias("path")).agg(
        F.sum("size_bytes").alias("size_bytes")
    )
    return crawl.crawled_directories(crawled).join(sizes, "path", "left").select(
        F.expr("replace(path, root_path, '')").alias("path"), "depth", "num_subdirs", "size_bytes"
    )


@query("crawled_tree", f"{CRAWLED_SQL} select path, depth::int as depth, num_subdirs, size_bytes from tree")
def crawled_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory of the written tree, found in several rounds."""
    return _crawled_sizes(crawl.crawl(spark, [_tree_of_documents(spark, sf_dir)], first_budget=2, budget=5))


@query(
    "crawled_directories",
    f"{CRAWLED_SQL} select path, depth::int as depth, num_subdirs, null::bigint as size_bytes from tree where depth <= 1",
)
def crawled_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper directories only; limits on depth and kind reach the walk."""
    return _crawled_sizes(crawl.crawl(spark, [_tree_of_documents(spark, sf_dir)], max_depth=1, directories_only=True))


@query("content_hash", "select doc_id, sha1(text) as sha1 from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return tree.content_hash(docs).select("doc_id", "sha1")


REQUESTED_SQL = f"""{FILES_SQL}, mime as ({MIME_SQL}), asked as (
      select file_id, case when file_id % 6 = 0 then concat(path, '.gone') else path end as path from files),
    named as (select *, string_split(path, '/')[-1] as name from asked)"""


@query(
    "requested_paths_status",
    f"""{REQUESTED_SQL} select a.path, regexp_replace(a.path, '/[^/]*$', '') as folder, a.name as file_name,
      ltrim(lower({SUFFIX_SQL.format('a.name')}), '.') as extension, coalesce(mime, '') as mime_type,
      f.size_bytes, f.path is not null as exists_flag,
      case when f.path is null then concat('stat_error: no such file: ''', a.path, '''') end as read_error
    from named a left join files f on f.path = a.path left join mime on {_mime_key_sql('a.name')} = mime_key""",
)
def requested_paths_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    asked = F.when(F.col("file_id") % 6 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    status = tree.path_status(rows.select(asked.alias("path")), rows.select("path", "size_bytes"))
    return status.select(
        "path", "folder", "file_name", "extension", "mime_type", "size_bytes", "exists_flag", "read_error"
    )


@query(
    "limited_ingest",
    f"""{FILES_SQL} select path, coalesce(business_capability, '') as business_category, file_id
    from files order by file_id limit 40""",
)
def limited_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog(spark, sf_dir).select(
        "file_id",
        F.col("path").alias("file_location"),
        F.coalesce("business_capability", F.lit("")).alias("BusinessCapability"),
    )
    return tables.ingest_list(listed, 40, "file_id")


@query(
    "lifecycle_catalog",
    f"""{FILES_SQL} select file_id, path as original_file_path, concat('./', file_name) as file_path,
      coalesce(business_capability, '') as business_capability, coalesce(modified_by, '') as record_type,
      '' as retention_code, subfolder as notes_text from files""",
)
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lifecycle_catalog(_lifecycle_input(spark, sf_dir), keep=["file_id"])


def _lifecycle_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select(
        "file_id",
        F.concat(F.lit("  "), "path", F.lit(" ")).alias("Original File Path"),
        F.concat(F.lit("./"), "file_name").alias("File Path"),
        F.col("business_capability").alias("Business Capability"),
        F.col("modified_by").alias("Record Type"),
        F.col("subfolder").alias("Notes"),
    )


# A file per document, with an undecodable byte or binary padding where it applies.
KIND_CASE = """case doc_id % 6 when 0 then 'txt' when 1 then 'csv' when 2 then 'twb' when 3 then 'dll'
      when 4 then 'html' else 'xlsx' end"""
FLAT = r"regexp_replace({0}, '[^A-Za-z0-9 ]+', ' ', 'g')"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several formats."""
    docs = texts(spark, sf_dir).select("doc_id", "text", "lang", F.expr(KIND_CASE).alias("extension"))
    flat = F.regexp_replace("text", "[^A-Za-z0-9 ]+", " ")
    utf8 = F.encode("text", "UTF-8")
    body = (
        F.when(F.col("extension") == "csv", F.encode(F.concat(F.lit('lang,,"a, b"\n'), "lang", F.lit(", ,"), flat, F.lit("\n")), "UTF-8"))
        .when(F.col("extension") == "twb", F.encode(F.concat(F.lit('<w><d name="'), "lang", F.lit('" caption="c">'), flat, F.lit("</d></w>")), "UTF-8"))
        .when(F.col("extension") == "dll", F.concat(F.unhex(F.lit("00FF")), F.encode(flat, "UTF-8"), F.unhex(F.lit("004142FF"))))
        .otherwise(F.concat(utf8, F.unhex(F.lit("FF"))))
    )
    return docs.select("doc_id", "extension", body.alias("content"))


@query(
    "extract_text",
    f"""with d as (select doc_id, lang, text, {KIND_CASE} as extension,
        regexp_replace(text, '[^A-Za-z0-9 ]+', ' ', 'g') as flat from documents)
    select doc_id, extension, case extension
        when 'txt' then regexp_replace(text, '\\r\\n?', chr(10), 'g')
        when 'html' then regexp_replace(text, '\\r\\n?', chr(10), 'g')
        when 'csv' then concat('lang, a, b', chr(10), lang, ', , ', trim(flat))
        when 'twb' then concat(case when trim(flat) = '' then '' else trim(flat) || chr(10) end, lang, chr(10), 'c')
        when 'dll' then case when length(flat) >= 4 then flat else '' end
        else '' end as content_text from d""",
)
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.reader_text(document_files(spark, sf_dir)).drop("content")


@query(
    "extract_feature_text",
    f"""with d as (select page_id, html, case when page_id % 3 = 0 then 'html' when page_id % 3 = 1 then 'md' else 'pdf' end as extension from pages),
    s as (select *, {normal_sql(
        "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'),"
        " '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")} as once from d)
    select page_id, extension, case extension when 'md' then {normal_sql('html')} when 'pdf' then ''
      else {normal_sql(
        "regexp_replace(regexp_replace(regexp_replace(once, '(?is)<script.*?>.*?</script>', ' ', 'g'),"
        " '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")} end as content_text from s""",
)
def extract_feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 3
    pages = texts(spark, sf_dir, "pages", "page_id").select(
        "page_id",
        F.when(kind == 0, "html").when(kind == 1, "md").otherwise("pdf").alias("extension"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return extract.feature_text(pages).drop("content")


def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as a listing with content."""
    return catalog(spark, sf_dir, spread_text=True).select(
        "path", "size_bytes", "modified_epoch", F.encode("content_text", "UTF-8").alias("content")
    )


KIND_SQL = f"ltrim(lower({SUFFIX_SQL.format('file_name')}), '.')"
# CSV files hold cells, archives are damaged ones, and all others are the document itself.
BYTES_SQL = f"case when {KIND_SQL} = 'csv' then concat(file_name, ', ,', flat, chr(10)) else content_text end"

INGEST_SQL = f"""{FILES_SQL}, listed as (
      select file_id * 2 as place, case when file_id % 13 = 0 then '  ' when file_id % 6 = 0 then concat(path, '.gone') else path end as path,
             business_capability as label from files
      union all select file_id * 2 + 1, path, '' from files where file_id % 10 = 3
    ), present as (select * from listed where trim(path) <> ''),
    newest as (select * from present qualify row_number() over (partition by path order by place desc) = 1),
    flattened as (select *, {FLAT.format('content_text')} as flat, {KIND_SQL} as kind from catalog),
    bodies as (select *, {BYTES_SQL} as body from flattened),
    texts as (select n.path, n.label, c.path is not null as exists_flag, c.size_bytes,
      case when c.kind in ('txt', 'html') then regexp_replace(coalesce(c.body, ''), '\\r\\n?', chr(10), 'g')
        when c.kind = 'csv' then concat(c.file_name, ', , ', trim(flat))
        when c.kind = 'dll' then array_to_string(regexp_extract_all(c.body, '[ -~]{{4,}}'), chr(10))
        else '' end as content_text,
      c.path is not null and c.kind = 'twbx' as failed,
      case when c.path is not null then sha1(c.body) end as sha1
      from newest n left join bodies c on c.path = n.path)"""


def _ingest(spark: SparkSession, sf_dir: str, materialise: bool = False) -> Ingested:
    rows = catalog(spark, sf_dir)
    number = F.col("file_id")
    path = (
        F.when(number % 13 == 0, "  ")
        .when(number % 6 == 0, F.concat("path", F.lit(".gone")))
        .otherwise(F.col("path"))
    )
    first = rows.select(
        (number * 2).alias("place"), path.alias("file_path"), F.col("business_capability").alias("business_category")
    )
    second = rows.filter(number % 10 == 3).select(
        (number * 2 + 1).alias("place"), F.col("path").alias("file_path"), F.lit("").alias("business_category")
    )
    listing = catalog_files(spark, sf_dir).drop("modified_epoch").withColumn(
        "modified_ts", F.lit(None).cast("timestamp")
    )
    kind, flat = paths.extension_key(paths.file_name("path")), F.regexp_replace(F.decode("content", "UTF-8"), "[^A-Za-z0-9 ]+", " ")
    cells = F.encode(F.concat(paths.file_name("path"), F.lit(", ,"), flat, F.lit("\n")), "UTF-8")
    listing = listing.withColumn("content", F.when(kind == "csv", cells).otherwise(F.col("content")))
    return ingest(first.unionByName(second), listing, "place", materialise=materialise)


@query(
    "ingest_files",
    f"""{INGEST_SQL} select path, string_split(path, '/')[-1] as file_name, size_bytes, exists_flag, sha1 from texts""",
)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir).files.select("path", "file_name", "size_bytes", "exists_flag", "sha1")


@query(
    "ingest_labels",
    f"{INGEST_SQL} select path, label as business_category from texts where label <> ''",
)
def ingest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _ingest(spark, sf_dir, materialise=True)
    return done.labels.join(done.files.select("file_id", "path"), "file_id").select("path", "business_category")


@query(
    "ingest_content",
    f"{INGEST_SQL} select path, content_text from texts",
)
def ingest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _ingest(spark, sf_dir, materialise=True)
    return done.content.join(done.files.select("file_id", "path"), "file_id").select("path", "content_text")


@query(
    "ingest_counters",
    f"""{INGEST_SQL} select count(*) filter (where trim(l.path) <> '' and not failed) as inserted,
      count(*) filter (where failed) as errors,
      count(*) filter (where trim(l.path) <> '' and not failed and t.content_text = '') as empty_text,
      count(*) filter (where trim(l.path) = '') as skipped_missing,
      count(distinct t.path) filter (where not failed) as distinct_files
    from listed l left join texts t on t.path = l.path""",
)
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir).stats


@query(
    "feature_frame",
    f"""{FILES_SQL}, family as ({FAMILY_SQL}), raw as (
      select file_id, path as original_file_path, concat('./', file_name) as file_path,
        coalesce(business_capability, '') as business_capability, subfolder as notes_text,
        case when file_id % 3 = 0 then path else concat(root_path, '/../', 'lost/', file_name) end as p from files
    ), r as (select *, {FOLD_SQL.format('p')} as resolved_path from raw),
    n as (select *, string_split(resolved_path, '/')[-1] as file_name from r),
    j as (select n.*, c.path is not null as found, c.size_bytes, c.modified_epoch,
      case when c.path is null then ''
        when regexp_matches(lower(n.file_name), '.\\.(pdf|docx|pptx|xlsx|msg|sas7bdat)$') then ''
        when lower({SUFFIX_SQL.format('n.file_name')}) = '.html' then {normal_sql("regexp_replace(c.content_text, '<[^>]+>', ' ', 'g')")}
        else {normal_sql('c.content_text')} end as content_text
      from n left join catalog c on c.path = n.resolved_path)
    select file_id, resolved_path, original_file_path, lower({SUFFIX_SQL.format('file_name')}) as extension,
      coalesce(family, 'other') as extension_family, {KEYWORDS_SQL.format('resolved_path')} as path_keywords,
      found::int as file_exists, coalesce(size_bytes, 0) as file_size_bytes,
      coalesce(modified_epoch::double, 0) as modified_time_epoch,
      case when found then strftime(make_timestamp(modified_epoch * 1000000), '%Y-%m-%dT%H:%M:%S') else '' end as modified_time_iso,
      {printable_sql('content_text')} as content_text, length(content_text)::int as content_char_len,
      len(regexp_extract_all(content_text, '[^ ]+'))::int as content_word_count,
      (content_text <> '')::int as has_content, (len(string_split(original_file_path, '/')))::int as original_path_depth,
      len(regexp_extract_all(notes_text, '[^ ]+'))::int as notes_word_count
    from j left join family on lower({SUFFIX_SQL.format('file_name')}) = suffix""",
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    path = F.when(F.col("file_id") % 3 == 0, F.col("path")).otherwise(
        F.concat("root_path", F.lit("/../lost/"), "file_name")
    )
    listed = rows.select(
        "file_id",
        F.col("path").alias("Original File Path"),
        path.alias("File Path"),
        F.col("business_capability").alias("Business Capability"),
        F.col("subfolder").alias("Notes"),
    )
    frame = feature_frame(listed, catalog_files(spark, sf_dir), "/srv", keep=("file_id",))
    return frame.select(
        "file_id", "resolved_path", "original_file_path", "extension", "extension_family", "path_keywords",
        "file_exists", "file_size_bytes", "modified_time_epoch", "modified_time_iso", "content_text",
        "content_char_len", "content_word_count", "has_content", "original_path_depth", "notes_word_count",
    )


@query(
    "flat_training_rows",
    f"""{FILES_SQL}, texts as (select doc_id, text from documents)
    select file_id, business_capability, extension, 'f' || (file_id % 3) as extension_family,
      case file_id % 4 when 0 then 1 when 1 then 0 when 2 then 1 end::bigint as file_exists,
      case when file_id % 5 <> 0 then (file_id % 7)::double end as original_path_depth, size_bytes::double as file_size_bytes,
      case when file_id % 6 <> 0 then (file_id % 900)::double end as content_word_count,
      case when file_id % 8 = 0 then '' else text end as content_text, lower(file_name) as original_path_keywords,
      case when file_id % 9 = 0 then '' else path end as original_file_path
    from files join texts on doc_id = file_id where business_capability is not null""",
)
def flat_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat training file whose columns came as texts, with gaps and misprints."""
    i = F.col("file_id")
    raw = catalog(spark, sf_dir).select(
        "file_id", "business_capability", F.nullif(paths.extension_key("file_name"), F.lit("")).alias("extension"),
        F.concat(F.lit("f"), i % 3).alias("extension_family"),
        F.when(i % 4 == 0, "True").when(i % 4 == 1, "false").when(i % 4 == 2, " 1 ").otherwise("maybe").alias("file_exists"),
        F.when(i % 5 == 0, "deep").otherwise((i % 7).cast("string")).alias("original_path_depth"),
        F.concat(F.lit(" "), F.col("size_bytes").cast("string")).alias("file_size_bytes"),
        F.when(i % 6 == 0, "NaN").otherwise((i % 900).cast("string")).alias("content_word_count"),
        F.when(i % 8 != 0, F.col("content_text")).alias("content_text"), F.lower("file_name").alias("original_path_keywords"),
        F.when(i % 9 != 0, F.col("path")).alias("original_file_path"),
    )
    return tables.flat_training_rows(raw)
