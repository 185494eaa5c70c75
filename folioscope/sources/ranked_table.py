"""Pages of a stored order: rows lie in blocks by rank, and counts by block lead to a page.

A table is written once for an order. Blocks are ranges of it, of a few thousand rows each, and
beside them stands how many rows of every combination of some filter columns a block holds. A
page, however deep, is found by adding up these counts, and only the one or two blocks that
hold its rows are read; nothing else is sorted. Filters on the counted columns don't change that.

The order should end in a unique column; rows that tie in all of it may take any place among
themselves. NULLs are values: they sort as the order says and a filter may ask for them. Pages
count from 0; a page behind the last one and every page of an empty table have no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import PAGE_SIZE

BLOCK_ROWS = 5_000


class RankedTable:
    """Rows of one order under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: Sequence[Column], filters: Sequence[str] = ()):
        self.spark, self.path, self.order, self.filters = spark, path.rstrip("/"), list(order), list(filters)
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        self.counted = T.StructType([
            T.StructField("block", T.LongType()), *(self.schema[c] for c in self.filters), T.StructField("n_rows", T.LongType())
        ])

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, order: Sequence[Column], filters: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
    ) -> RankedTable:
        """Write rows in their order; one range-partitioned sort."""
        table = cls(rows.sparkSession, path, rows.schema, order, filters)
        blocks = max(1, -(-rows.count() // block_rows))
        dealt = rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id().cast("long"))
        dealt.sortWithinPartitions(*order).write.partitionBy("block").parquet(f"{table.path}/rows")
        whole = T.StructType([*table.schema.fields, T.StructField("block", T.LongType())])
        stored = table.spark.read.schema(whole).parquet(f"{table.path}/rows")
        counts = stored.groupBy("block", *table.filters).agg(F.count("*").alias("n_rows"))
        counts.write.parquet(f"{table.path}/counts")
        return table

    def _counts(self, wanted: Mapping[str, object]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks in their order and how many of the wanted rows each has; one line a block comes to the driver."""
        unknown = set(wanted) - set(self.filters)
        if unknown:
            raise ValueError(f"no counts by {sorted(unknown)}")
        counts = self.spark.read.schema(self.counted).parquet(f"{self.path}/counts")
        for column, value in wanted.items():
            counts = counts.filter(F.col(column).eqNullSafe(F.lit(value)))
        found = counts.groupBy("block").agg(F.sum("n_rows").alias("n")).orderBy("block").toArrow()
        return found["block"].to_numpy(), found["n"].to_numpy()

    def total(self, wanted: Mapping[str, object] = {}) -> int:
        """Number of rows, from the counts alone."""
        return int(self._counts(wanted)[1].sum())

    def page(self, number: int, size: int = PAGE_SIZE, wanted: Mapping[str, object] = {}) -> DataFrame:
        """The rows of a page, in order; a negative number means the first."""
        number = max(number, 0)
        blocks, sizes = self._counts(wanted)
        upto = np.cumsum(sizes)
        first, last = number * size, (number + 1) * size
        if size <= 0 or not len(upto) or first >= upto[-1]:
            return self.spark.createDataFrame([], self.schema)
        low = int(np.searchsorted(upto, first, "right"))
        high = min(int(np.searchsorted(upto, last, "left")), len(upto) - 1)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/block={b}" for b in blocks[low : high + 1].tolist()])
        for column, value in wanted.items():
            rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
        before = int(upto[low] - sizes[low])
        return rows.orderBy(*self.order).offset(first - before).limit(size)
