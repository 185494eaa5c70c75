"""Counts, shares, imputation and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import small_side
from .ranking import exact_medians, mode, modes


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Rows per value, most frequent first; NULL is a value of its own."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias(out))
        .orderBy(F.desc(out), F.asc(column))
    )


def value_shares(df: DataFrame, column: str, out: str = "share") -> DataFrame:
    """Share of each value in all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return counts.select(column, (F.col("_n") / F.lit(float(max(total, 1)))).alias(out)).orderBy(
        F.desc(out), F.asc(column)
    )


def top_values(df: DataFrame, column: str, k: int = 20, out: str = "n") -> DataFrame:
    return value_counts(df, column, out).limit(k)


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class, the first by name of equals."""
    return value_counts(df, label).limit(1)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: distinct values, non-blank values and rows.

    Values are collapsed per column first, so one aggregate serves all columns
    and no distinct set is held in a single task.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    values = (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return values.groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        F.sum(F.when(~is_blank("value"), F.col("_n")).otherwise(0)).alias("non_blank"),
        F.sum("_n").alias("row_count"),
    )


def ingest_stats(
    rows: DataFrame, path: str, text: str, error: str | None = None, times: str | None = None
) -> DataFrame:
    """Counters of one ingest run in a single pass.

    ``inserted`` counts listed rows, so a path listed twice counts twice;
    ``distinct_files`` counts it once. ``times`` names a column that tells how
    many listed rows a row stands for.
    """
    weight = F.lit(1) if times is None else F.col(times)
    present = ~is_blank(path)
    failed = F.lit(False) if error is None else F.col(error).isNotNull()
    kept = present & ~failed
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    cases = {
        "inserted": kept,
        "errors": present & failed,
        "empty_text": kept & empty,
        "skipped_missing": ~present,
    }
    per_path = rows.groupBy(F.when(kept, F.col(path)).alias("_path")).agg(
        *[F.sum(F.when(case, weight).otherwise(0)).alias(name) for name, case in cases.items()]
    )
    return per_path.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in cases],
        F.count("_path").alias("distinct_files"),
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def fold_plan(df: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """Smallest class size and the number of folds it allows, at least two."""
    smallest = F.min("n")
    return class_counts(df, label).agg(
        smallest.alias("min_class_count"),
        F.greatest(F.lit(2), F.least(F.lit(folds), smallest)).cast("long").alias("folds"),
    )


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight of each class: rows / (classes x rows of the class)."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n"), F.count("n")).first()
    factor = float(whole[0] or 0) / max(whole[1], 1)
    return counts.select(label, (F.lit(factor) / F.col("n")).alias(out))


def with_balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return df.join(small_side(balanced_weights(df, label, out)), label)


def impute_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Median of numeric and mode of categorical columns."""
    found: dict[str, object] = dict(exact_medians(df, numeric)) if numeric else {}
    types = dict(df.dtypes)
    strings = [c for c in categorical if types[c] == "string"]
    found.update(modes(df, strings) if strings else {})
    found.update({c: mode(df, c) for c in categorical if c not in strings})
    return found


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULL and NaN with fitted values."""
    filled: dict[str, Column] = {}
    for name, value in values.items():
        if value is None:
            continue
        column = F.col(name)
        if dict(df.dtypes)[name] in ("double", "float"):
            column = F.nanvl(column, F.lit(None).cast("double"))
        filled[name] = F.coalesce(column, F.lit(value))
    return df.withColumns(filled) if filled else df


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation of one column."""

    column: str
    mean: float
    deviation: float

    def apply(self, centre: bool = True) -> Column:
        shifted = F.col(self.column) - F.lit(self.mean) if centre else F.col(self.column)
        return shifted / F.lit(self.deviation)


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> list[Scaling]:
    """Fit all columns in one pass; a constant column is divided by one."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return [Scaling(c, row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns]


def scaled(df: DataFrame, fitted: Sequence[Scaling], centre: bool = True, tail: str = "_scaled") -> DataFrame:
    return df.withColumns({s.column + tail: s.apply(centre) for s in fitted})


def rank_by(df: DataFrame, score: str, name: str) -> DataFrame:
    """Best score first, ties by name."""
    return df.orderBy(F.desc(score), F.asc(name))


def top_per_group(df: DataFrame, group: str, weight: str, name: str, k: int) -> DataFrame:
    """The ``k`` heaviest rows of each group; Spark cuts each task to ``k`` before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(weight), F.asc(name))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
