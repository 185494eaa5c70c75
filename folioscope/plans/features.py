"""The feature frame of a lifecycle catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.fixed_values import with_extension_family
from ..sources.extract import Extractor, feature_text
from ..sources.tables import lifecycle_catalog


def path_features(df: DataFrame, base: str) -> DataFrame:
    """Columns derived from the two paths and the notes of a catalog row."""
    root = F.lit(base)
    resolved = df.withColumns(
        {
            "resolved_path": paths.resolve("file_path", root),
            "original_resolved_path": paths.resolve("original_file_path", root),
        }
    )
    name = paths.file_name("resolved_path")
    named = resolved.withColumns(
        {
            "file_name": name,
            "file_stem": paths.stem(name),
            "extension": F.lower(paths.suffix(name)),
            "path_keywords": paths.keywords("resolved_path"),
            "original_path_keywords": paths.keywords("original_resolved_path"),
        }
    )
    derived: dict[str, Column] = {
        "file_name_keywords": paths.keywords("file_name"),
        "file_stem_keywords": paths.keywords("file_stem"),
        "path_depth": paths.depth("resolved_path"),
        "original_path_depth": paths.depth("original_resolved_path"),
        "path_token_count": paths.keyword_count("path_keywords"),
        "original_path_token_count": paths.keyword_count("original_path_keywords"),
        "path_char_len": F.length("resolved_path"),
        "original_path_char_len": F.length("original_resolved_path"),
        "file_name_char_len": F.length("file_name"),
        "file_name_digit_count": paths.digit_count("file_name"),
        "notes_word_count": text.word_count("notes_text"),
    }
    return with_extension_family(named.withColumns(derived), "extension")


def feature_frame(
    catalog: DataFrame, listing: DataFrame, base: str,
    extractors: Mapping[str, Extractor] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Catalog rows with path, file and content features.

    ``listing`` has ``path``, ``size_bytes``, ``modified_epoch`` and ``content``.
    A file that is not listed has size 0, no time and no text.
    """
    rows = path_features(lifecycle_catalog(catalog, keep), base)
    listed = feature_text(
        listing.withColumn("_kind", paths.extension_key(paths.file_name("path"))),
        extension="_kind", extractors=extractors,
    ).select(
        F.col("path").alias("resolved_path"), "size_bytes", "modified_epoch", "content_text",
        F.lit(1).alias("_listed"),
    )
    joined = rows.join(listed, "resolved_path", "left").withColumns(
        {
            "file_exists": F.coalesce("_listed", F.lit(0)),
            "file_size_bytes": F.coalesce("size_bytes", F.lit(0)),
            "modified_time_epoch": F.coalesce(F.col("modified_epoch").cast("double"), F.lit(0.0)),
            "modified_time_iso": text.iso_timestamp(text.epoch_timestamp("modified_epoch")),
            "content_text": F.coalesce("content_text", F.lit("")),
        }
    )
    measured = joined.withColumns(text.content_measures("content_text"))
    return text.printable_frame(measured.drop("_listed", "size_bytes", "modified_epoch"))
