"""Values the results depend on. They are fixed and not computed."""

from __future__ import annotations

import mimetypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffix -> extension family.
EXTENSION_FAMILIES = {
    ".xls": "excel",
    ".xlsx": "excel",
    ".xlsm": "excel",
    ".xlsb": "excel",
    ".csv": "tabular",
    ".tsv": "tabular",
    ".txt": "text",
    ".log": "text",
    ".json": "json",
    ".xml": "markup",
    ".yaml": "markup",
    ".yml": "markup",
    ".ini": "config",
    ".cfg": "config",
    ".conf": "config",
    ".doc": "word",
    ".docx": "word",
    ".pdf": "pdf",
    ".ppt": "presentation",
    ".pptx": "presentation",
    ".msg": "outlook",
    ".html": "html",
    ".htm": "html",
    ".css": "code",
    ".js": "code",
    ".sql": "code",
    ".py": "code",
    ".sas": "sas",
    ".sas7bdat": "sas",
    ".ipynb": "notebook",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".gif": "image",
    ".bmp": "image",
    ".vsd": "visio",
    ".vsdx": "visio",
    ".twb": "tableau",
    ".twbx": "tableau",
}
DEFAULT_FAMILY = "other"

# Column names accepted for an ingest list, first match wins.
PATH_COLUMN = "filepath"
PATH_ALIASES = ("file_location", "file_path", "path")
CATEGORY_COLUMN = "businesscapability"
CATEGORY_ALIASES = ("business_category", "businessCategory", "BusinessCapability")

# Lifecycle catalog headings and their column names.
CATALOG_REQUIRED = {
    "Original File Path": "original_file_path",
    "File Path": "file_path",
    "Business Capability": "business_capability",
}
CATALOG_OPTIONAL = {
    "Record Type": "record_type",
    "Retention Code": "retention_code",
    "Notes": "notes_text",
}

# Columns of the flat training file.
TRAINING_COLUMNS = (
    "business_capability",
    "extension",
    "extension_family",
    "file_exists",
    "original_file_path",
    "original_path_depth",
    "original_path_keywords",
    "file_size_bytes",
    "content_text",
    "content_word_count",
)

# How text is read, by extension without the dot.
READER_TEXT_EXTENSIONS = ("txt", "log", "md", "sas", "html", "htm")
FEATURE_TEXT_EXTENSIONS = (
    "txt", "csv", "tsv", "json", "xml", "yaml", "yml", "ini", "cfg", "conf", "md",
    "rst", "sql", "py", "java", "js", "html", "htm", "css", "log", "sas", "psv",
)
HTML_EXTENSIONS = ("html", "htm")
# Formats that only a user-supplied extractor can read.
CODEC_EXTENSIONS = (
    "pdf", "docx", "pptx", "xlsx", "xlsm", "xls", "xlsb", "sas7bdat", "sasbdat",
    "one", "ppt", "doc", "msg",
)
# Formats that never hold readable text.
UNREADABLE_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "svg", "webp", "heic",
    "ico", "accdb", "mdb", "ai", "psd",
)

# Limits.
FEATURE_TEXT_LIMIT = 5_000
SCAN_BATCH_FILES = 200
PAGE_SIZE = 50
SPLIT_SEED = 42

# Encodings tried in order for a feature table.
TABLE_ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")


def mime_types() -> dict[str, str]:
    """Suffix -> MIME type as the standard library ships it, system files ignored."""
    return dict(mimetypes.MimeTypes(filenames=()).types_map[True])


def mime_encodings() -> tuple[str, ...]:
    """Compression suffixes, case-sensitive, that are looked through."""
    return tuple(mimetypes.MimeTypes(filenames=()).encodings_map)


def mime_compound_suffixes() -> dict[str, str]:
    """Short suffixes such as ``.tgz`` -> the suffix that carries the type."""
    found = {}
    for short, long in mimetypes.MimeTypes(filenames=()).suffix_map.items():
        found[short] = long.rsplit(".", 1)[0]
    return found


def _lookup(spark: SparkSession, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    names, values = zip(*sorted(pairs.items()), strict=True)
    return spark.createDataFrame(pa.table({key: list(names), value: list(values)}))


def with_extension_family(df: DataFrame, suffix: str, out: str = "extension_family") -> DataFrame:
    """Add the family of the dotted ``suffix`` column; the 39-row table is broadcast."""
    table = _lookup(df.sparkSession, EXTENSION_FAMILIES, "_family_key", "_family_value")
    return (
        df.join(F.broadcast(table), F.lower(F.col(suffix)) == F.col("_family_key"), "left")
        .withColumn(out, F.coalesce("_family_value", F.lit(DEFAULT_FAMILY)))
        .drop("_family_key", "_family_value")
    )


def with_mime_type(df: DataFrame, key: str, out: str = "mime_type") -> DataFrame:
    """Add the MIME type of a ``paths.mime_key`` column, '' when unknown."""
    table = _lookup(df.sparkSession, mime_types(), "_mime_key", "_mime_value")
    return (
        df.join(F.broadcast(table), F.col(key) == F.col("_mime_key"), "left")
        .withColumn(out, F.coalesce("_mime_value", F.lit("")))
        .drop("_mime_key", "_mime_value")
    )
