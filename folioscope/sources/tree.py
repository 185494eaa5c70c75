"""File trees: recursive listing, status of requested paths, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed_values import with_mime_type


def scan_tree(
    spark: SparkSession, root: str, with_content: bool = False,
    max_content_bytes: int | None = None, glob: str | None = None,
) -> DataFrame:
    """Path, size and time of every file below ``root``.

    Spark lists large trees on the executors. Content is read only when asked
    for. A file above ``max_content_bytes`` is listed without its content, since
    a file is one value and a value ends at 2 GB. Names that start with '.' or
    '_' are not listed, and owner and creation time are not known; a listing
    table may bring them instead.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root)
    columns = [
        F.regexp_replace("path", "^file:(//)?", "").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_ts"),
    ]
    if not with_content:
        return found.select(*columns)
    if max_content_bytes is None:
        return found.select(*columns, "content")
    small = found.filter(F.col("length") <= max_content_bytes).select(*columns, "content")
    large = found.filter(F.col("length") > max_content_bytes)
    return small.unionByName(large.select(*columns, F.lit(None).cast("binary").alias("content")))


def listing_columns(files: DataFrame, root: str) -> DataFrame:
    """Catalog columns of a listing below ``root``."""
    name = paths.file_name("path")
    return files.withColumns(
        {
            "root_path": F.lit(root),
            "file_name": name,
            "subfolder": paths.subfolder(F.lit(root), "path"),
            "extension": paths.extension_key(name),
        }
    )


def path_status(requested: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Status record of each requested path, whether it is in the listing or not.

    A missing file has no size and no times, ``exists_flag`` false and a
    ``stat_error`` text.
    """
    known = listing.select(
        paths.canonical("path").alias("_listed"), *[c for c in listing.columns if c != "path"]
    )
    name = paths.file_name("path")
    exists = F.col("_listed").isNotNull()
    joined = (
        requested.withColumn("path", paths.canonical(path))
        .join(known, F.col("path") == F.col("_listed"), "left")
        .withColumns(
            {
                "folder": paths.folder("path"),
                "file_name": name,
                "extension": paths.extension_key(name),
                "_mime": paths.mime_key(name),
                "exists_flag": exists,
                "read_error": F.when(
                    ~exists,
                    F.concat(F.lit("stat_error: no such file: '"), "path", F.lit("'")),
                ),
            }
        )
    )
    return with_mime_type(joined, "_mime").drop("_mime", "_listed")


def feature_stats(status: DataFrame) -> DataFrame:
    """Size 0 and no time for missing files, as the features want them."""
    return status.withColumn("file_size_bytes", F.coalesce("size_bytes", F.lit(0)))


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the SHA-1 of the content; ask for it only when needed, it reads the files."""
    return files.withColumn("sha1", F.sha1(content))
