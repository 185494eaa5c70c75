"""Tabular inputs: ingest lists, lifecycle catalogs and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    CATALOG_OPTIONAL,
    CATALOG_REQUIRED,
    CATEGORY_ALIASES,
    CATEGORY_COLUMN,
    PATH_ALIASES,
    PATH_COLUMN,
    TABLE_ENCODINGS,
    TRAINING_COLUMNS,
)
from ..functions.text import safe_path


def resolve_column(df: DataFrame, name: str, aliases: Sequence[str] = ()) -> str:
    """The first of ``name`` and its aliases that is a column."""
    for candidate in (name, *aliases):
        if candidate in df.columns:
            return candidate
    raise KeyError(f"no column for {name!r}: tried {list(aliases)}, found {df.columns}")


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself, or an error that lists what is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns in {what}: {missing}")
    return df


def ingest_list(df: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """``path`` and ``business_category`` of an ingest list.

    ``limit`` keeps the first rows in ``order``, which must be given with it,
    because rows of a distributed table have no order of their own. 0 and None
    keep all.
    """
    path = resolve_column(df, PATH_COLUMN, PATH_ALIASES)
    category = resolve_column(df, CATEGORY_COLUMN, CATEGORY_ALIASES)
    if limit:
        if order is None:
            raise ValueError("a row limit needs an order column")
        df = df.orderBy(order).limit(limit)
    extra = [] if order is None else [F.col(order)]
    return df.select(
        F.col(path).cast("string").alias("path"),
        F.col(category).cast("string").alias("business_category"),
        *extra,
    )


def lifecycle_catalog(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Renamed and trimmed catalog columns; absent optional ones are ''."""
    require_columns(df, list(CATALOG_REQUIRED), "catalog")
    columns = [safe_path(F.col(f"`{old}`")).alias(new) for old, new in CATALOG_REQUIRED.items()]
    for old, new in CATALOG_OPTIONAL.items():
        column = safe_path(F.col(f"`{old}`")) if old in df.columns else F.lit("")
        columns.append(column.alias(new))
    return df.select(*keep, *columns)


def flat_training_rows(df: DataFrame) -> DataFrame:
    """Typed rows of the flat training file; rows without a target go.

    Every column must be there. ``file_exists`` becomes 1 or 0, or NULL where it is neither
    true nor false; numbers that aren't any become NULL; missing texts become empty.
    """
    require_columns(df, TRAINING_COLUMNS, "flat training file")
    truth = F.lower(F.trim(F.col("file_exists").cast("string")))
    number = lambda c: F.expr(f"nanvl(try_cast(trim(cast(`{c}` as string)) as double), cast(null as double))").alias(c)
    return df.filter(F.col("business_capability").isNotNull()).select(
        F.col("business_capability").cast("string").alias("business_capability"),
        *(F.col(c).cast("string").alias(c) for c in ("extension", "extension_family")),
        F.when(truth.isin("true", "1", "1.0"), 1).when(truth.isin("false", "0", "0.0"), 0).cast("long").alias("file_exists"),
        *(number(c) for c in ("original_path_depth", "file_size_bytes", "content_word_count")),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("content_text", "original_path_keywords", "original_file_path")),
        *(F.col(f"`{c}`") for c in df.columns if c not in TRAINING_COLUMNS),
    )


def _is_utf8(spark: SparkSession, path: str) -> bool:
    lines = spark.read.text(path)
    return bool(lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0])


def feature_table(
    spark: SparkSession, path: str, schema: T.StructType,
    encodings: Sequence[str] = TABLE_ENCODINGS, line_breaks: bool = True,
) -> DataFrame:
    """CSV with a header in the first encoding that fits; rows with too many fields are skipped.

    Quotes inside quoted fields are doubled. Quoted fields may hold line breaks;
    such a file is read by one task, so large files without them, or cut into
    several, are read with ``line_breaks`` off.

    UTF-8 is checked over the whole file. The single-byte encodings accept any
    bytes, so the first of them ends the search. Short lines keep NULLs.
    """
    utf8 = ("utf-8", "utf-8-sig")
    fitting = [e for e in encodings if e not in utf8 or _is_utf8(spark, path)]
    if not fitting:
        raise ValueError(f"{path} fits none of {list(encodings)}")
    overflow = T.StructType([*schema.fields, T.StructField("_overflow", T.StringType())])
    names = {"latin-1": "ISO-8859-1", "cp1252": "windows-1252"}
    rows = (
        spark.read.schema(overflow)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .option("encoding", names.get(fitting[0], "UTF-8"))
        .csv(path)
    )
    return rows.filter(F.col("_overflow").isNull()).drop("_overflow")
