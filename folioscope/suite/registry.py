"""Where queries are registered, and the frames and SQL they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.catalog import CATALOG_SQL, catalog

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}

SUFFIX_SQL = r"regexp_extract({0}, '(?s).+(\.[^.]+)$', 1)"
FOLDER_SQL = r"regexp_replace({0}, '/[^/]*$', '')"

FILES_SQL = f"""
with catalog as ({CATALOG_SQL}), files as (
  select file_id, root_path, path, file_name, subfolder,
         nullif(ltrim(lower({SUFFIX_SQL.format('file_name')}), '.'), '') as extension,
         size_bytes, modified_epoch, modified_by, business_capability
  from catalog
)
"""


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under a name."""

    def add(build: Builder) -> Builder:
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog without text, with its extension, NULL where there is none."""
    return (
        catalog(spark, sf_dir)
        .drop("content_text")
        .withColumn("extension", F.nullif(paths.extension_key("file_name"), F.lit("")))
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with a business capability."""
    return files(spark, sf_dir).filter(F.col("business_capability").isNotNull())
