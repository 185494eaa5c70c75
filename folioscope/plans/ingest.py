"""From a list of paths to file, label and content tables with counters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical, extension_key, file_name
from ..functions.text import is_blank
from ..operators.stats import ingest_stats
from ..operators.upsert import replace_content, replace_labels, upsert
from ..session import checkpointed, small_keys
from ..sources.extract import Extractor, reader_text
from ..sources.tables import ingest_list
from ..sources.tree import content_hash, path_status

FILE_COLUMNS = (
    "file_id", "path", "folder", "file_name", "extension", "mime_type", "size_bytes",
    "created_ts", "modified_ts", "sha1", "exists_flag", "read_error",
)


@dataclass(frozen=True)
class Ingested:
    files: DataFrame
    labels: DataFrame
    content: DataFrame
    stats: DataFrame


def file_id(path: str = "path") -> Column:
    """Stable id of a path; the same path keeps its id over all ingests."""
    return F.xxhash64(path)


def ingest(
    listed: DataFrame,
    listing: DataFrame,
    order: str,
    limit: int | None = None,
    compute_hash: bool = True,
    extractors: Mapping[str, Extractor] | None = None,
    tables: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    materialise: bool = True,
) -> Ingested:
    """Ingest a list of paths with the files of a tree scan that has content.

    ``order`` is a unique column of the list; the last row of a path wins. The
    list is reduced to one row per path before it meets any file, so a path that
    is listed very often is read, parsed and joined once. With ``materialise``
    the parsed files are checkpointed, because four results are made of them.
    ``tables`` are the file, label and content tables to update.
    """
    rows = ingest_list(listed, limit, order)
    path = F.when(~is_blank("path"), canonical("path"))
    per_path = rows.groupBy(path.alias("path")).agg(
        F.count(F.lit(1)).alias("times"),
        F.max_by(F.coalesce("business_category", F.lit("")), F.col(order)).alias("business_category"),
    )
    wanted = per_path.filter("path IS NOT NULL")
    # Texts and hashes are made where the files are read; bytes of files are never shuffled.
    found = listing.withColumn("path", canonical("path"))
    few = small_keys(wanted.select("path"))
    if few is not None:
        found = found.join(few, "path", "left_semi")
    named = found.withColumn("_kind", extension_key(file_name("path")))
    read = reader_text(named, extension="_kind", extractors=extractors, error="extract_error")
    hashed = content_hash(read) if compute_hash else read.withColumn("sha1", F.lit(None).cast("string"))
    parsed = path_status(wanted, hashed.drop("content", "_kind"))
    unknown = {
        c: F.lit(None).cast("timestamp") for c in ("created_ts", "modified_ts") if c not in parsed.columns
    }
    parsed = parsed.withColumns(
        {**unknown, "file_id": file_id(), "content_text": F.coalesce("content_text", F.lit(""))}
    )
    if materialise:
        parsed = checkpointed(parsed)
    batches = (
        parsed.select(*FILE_COLUMNS),
        parsed.select("file_id", "business_category"),
        parsed.select("file_id", "content_text"),
    )
    files, labels, content = tables or tuple(batch.limit(0) for batch in batches)
    missing = per_path.filter("path IS NULL").select(
        "path", "times", F.lit("").alias("content_text"), F.lit(None).cast("string").alias("extract_error")
    )
    return Ingested(
        files=upsert(files, batches[0], ["path"], None),
        labels=replace_labels(labels, batches[1], None),
        content=replace_content(content, batches[2], None),
        stats=ingest_stats(
            parsed.select("path", "times", "content_text", "extract_error").unionByName(missing),
            "path", "content_text", error="extract_error", times="times",
        ),
    )
