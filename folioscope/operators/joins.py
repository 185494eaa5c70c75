"""Joins of the file, label and content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_tokens


def training_set(files: DataFrame, labels: DataFrame, content: DataFrame) -> DataFrame:
    """Labelled files with their text and path tokens; unlabelled files are left out."""
    joined = files.join(labels, "file_id").join(content, "file_id", "left")
    return joined.select(
        "file_id",
        path_tokens("path").alias("path_tokens"),
        F.coalesce("content_text", F.lit("")).alias("content_text"),
        F.coalesce("extension", F.lit("")).alias("extension"),
        F.col("business_category").cast("string").alias("business_category"),
    )


def file_detail(files: DataFrame, labels: DataFrame, content: DataFrame) -> DataFrame:
    """Every file with its sorted distinct labels and its text, '' when there is none.

    Filter the files first for a single one. Labels are made distinct before
    they are gathered, so a list is never longer than the label vocabulary.
    """
    lists = (
        labels.select("file_id", "business_category")
        .distinct()
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list("business_category")).alias("labels"))
    )
    return (
        files.join(lists, "file_id", "left")
        .join(content, "file_id", "left")
        .withColumns(
            {
                "labels": F.coalesce("labels", F.array().cast("array<string>")),
                "content_text": F.coalesce("content_text", F.lit("")),
            }
        )
    )
