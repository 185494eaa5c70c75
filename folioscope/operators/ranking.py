"""Global positions, running totals and exact order statistics without one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Hexadecimal digits of a hash that make up a bucket: 16 ** 3 buckets per class.
BUCKET_DIGITS = 3
# Rows whose distinct values may be ranked by one task.
ONE_TASK_VALUES = 1_000_000


def positioned(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add the 1-based position of each row in the order.

    The order should end in a unique column. The sort is range-partitioned; the
    row numbers inside each range are fixed by a checkpoint, and only the sizes
    of the ranges are added up to place them.
    """
    sorted_rows = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    fixed = checkpointed(sorted_rows)
    piece = F.shiftright(F.col("_slot"), 33)
    sizes = fixed.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        fixed.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")  # one row per range of the sort
        .withColumn(out, F.col("_start") + local)
        .drop("_slot", "_piece", "_start")
    )


def running_totals(df: DataFrame, group: str, order: str, values: Sequence[str]) -> DataFrame:
    """Add ``<value>_before``: the sum of ``value`` over smaller ``order`` in the group.

    ``(group, order)`` must be unique, so a hot value is one row. Rows are cut
    into ranges, fixed by a checkpoint; each range is summed in its own task and
    shifted by the total of the ranges before it.
    """
    ranged = df.repartitionByRange(F.col(group), F.col(order)).withColumn(
        "_piece", F.spark_partition_id()
    )
    fixed = checkpointed(ranged)
    totals = fixed.groupBy(group, "_piece").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        group,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(group, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = fixed.withColumns(
        {f"_i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    joined = summed.join(shifts, [group, "_piece"])
    return joined.select(
        *df.columns, *[(F.col(f"_i_{v}") + F.col(f"_s_{v}")).alias(f"{v}_before") for v in values]
    )


def hash_rank_key(seed: int, identifier: Column) -> Column:
    """A seeded pseudo-random sort key for a unique identifier."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def bucket_starts(df: DataFrame, label: str, bucket: str) -> DataFrame:
    """Rows per (label, bucket) and how many rows of the label lie in earlier buckets."""
    sizes = df.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median of a numeric column; NULL and NaN are left out.

    Two order statistics are looked for in a value range that shrinks around an
    approximate median until it holds few distinct values, so neither a sort
    nor a table of all distinct values ends up in one task.
    """
    value = F.col(column).cast("double")
    rows = df.select(value.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    total, low, high = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    first, last = (total - 1) // 2, total // 2
    below, inside = 0, total
    while low < high:
        within = rows.filter(F.col("v").between(low, high))
        if inside <= ONE_TASK_VALUES:
            break
        at = [(first - below) / inside, (last - below) / inside]
        spread = [max(at[0] - 0.001, 0.0), min(at[1] + 0.001, 1.0)]
        cut_low, cut_high = within.agg(F.percentile_approx("v", spread, 10_000)).first()[0]
        counted = within.agg(
            F.count_if(F.col("v") < cut_low), F.count_if(F.col("v").between(cut_low, cut_high))
        ).first()
        missed = below + counted[0] > first or below + counted[0] + counted[1] <= last
        if missed or counted[1] == inside:
            # One value or an odd spread fills the range: fall back to counting values.
            break
        low, high, below, inside = cut_low, cut_high, below + counted[0], counted[1]
    if low == high:
        return float(low)
    counts = rows.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("v").alias("n"))
    if inside > ONE_TASK_VALUES:
        counts = running_totals(counts.withColumn("g", F.lit(0)), "g", "v", ["n"])
    else:
        before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    reach = F.col("n_before") + F.col("n")

    def holding(rank: int) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (reach > rank), F.col("v")))

    lower, upper = counts.agg(holding(first - below), holding(last - below)).first()
    return (lower + upper) / 2


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several numeric columns.

    Columns with few values, as one count shows, share a single aggregate.
    """
    missing = F.lit(None).cast("double")
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), missing).alias(c) for c in columns])
    sizes = clean.agg(*[F.count(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= ONE_TASK_VALUES]
    found = clean.agg(*[F.median(c).alias(c) for c in few]).first().asDict() if few else {}
    return {c: found[c] if c in found else exact_median(df, c) for c in columns}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """:func:`mode` of several string columns in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .filter("p.v IS NOT NULL")
        .groupBy("p.c", "p.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    found = {row["c"]: row["v"] for row in top.collect()}
    return {c: found.get(c) for c in columns}


def mode(df: DataFrame, column: str) -> object | None:
    """Most frequent non-NULL value, the smallest of equals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), F.asc(column)).first()
    return None if top is None else top[column]
