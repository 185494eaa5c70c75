"""Substring search over stored texts by trigrams: which blocks of rows may hold a pattern.

Rows are written in blocks, in the order of the searched text, so like texts share blocks. For
every three characters of the case-folded text a posting list names the blocks that hold them;
lists are sorted, written as differences in one to five bytes each, and cut into segments of
bounded length. A pattern is split at its wildcards into pieces, and every three characters of
a piece must be in a block. Lists are intersected, the one with the fewest blocks first; only
the blocks that are left are read, and there each row is compared with the pattern itself. So
the rows are those of a scan. A pattern without three plain characters in a row reads all blocks.

``add`` writes more blocks with lists of their own; nothing is rewritten. NULL texts never match
and are in no list. The pattern matches as in :func:`contains_nocase`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.query import contains_nocase, fold_case

BLOCK_ROWS, SEGMENT_BLOCKS = 10_000, 65_536
SIZE = 3


def required_trigrams(text: str, literal: bool = False) -> set[str]:
    """What every row that holds the pattern must hold, in folded case."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    pieces = [folded] if literal else re.split("[%_]", folded)
    return {p[i : i + SIZE] for p in pieces for i in range(len(p) - SIZE + 1)}


def packed(blocks: list[int]) -> bytes:
    """A rising list as its differences, seven bits a byte."""
    out, before = bytearray(), -1
    for b in blocks:
        gap, before = b - before, b
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def unpacked(raw: bytes) -> np.ndarray:
    """The list behind :func:`packed`."""
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    if not len(data):
        return data
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.cumsum(np.add.reduceat((data & 127) << shift, starts)) - 1


class SubstringIndex:
    """Blocks of rows and posting lists under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, column: str, block_rows: int = BLOCK_ROWS):
        self.spark, self.path, self.column, self.block_rows = spark, path.rstrip("/"), column, block_rows
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    @classmethod
    def create(cls, rows: DataFrame, path: str, column: str, block_rows: int = BLOCK_ROWS) -> SubstringIndex:
        index = cls(rows.sparkSession, path, rows.schema, column, block_rows)
        index.add(rows)
        return index

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema("folder string, block bigint").parquet(f"{self.path}/blocks")

    def add(self, rows: DataFrame) -> int:
        """Write more rows; how many blocks they took."""
        count = rows.count()
        blocks, name = -(-count // self.block_rows), uuid.uuid4().hex
        first = 0
        if self._exists():
            first = (self._blocks().agg(F.max("block")).first()[0] or 0) + 1
        folder = f"{self.path}/rows/{name}"
        own = rows.select(*self.schema.names)
        if blocks:
            # Equal texts may fill many blocks, so rows with one text are told apart by a hash of the whole row.
            dealt = own.repartitionByRange(blocks, F.col(self.column), F.xxhash64(*[F.col(c).cast("string") for c in own.columns]))
            dealt.withColumn("block", F.spark_partition_id() + first).sortWithinPartitions(self.column).write.partitionBy("block").parquet(folder)
            stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("block", T.LongType())])).parquet(folder)
            self._write_lists(stored, name)
            made = stored.select(F.lit(name).alias("folder"), F.col("block")).distinct()
        else:
            made = self.spark.createDataFrame([], "folder string, block bigint")
        # Written last: only now the rows are part of the table.
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/blocks")
        return blocks

    def _exists(self) -> bool:
        try:
            self._blocks().limit(1).collect()
        except Exception as exc:  # a path that isn't there has no class of its own
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return False
        return True

    def _write_lists(self, stored: DataFrame, name: str) -> None:
        text = fold_case(F.col(self.column).cast("string"))
        places = F.sequence(F.lit(1), F.char_length(text) - (SIZE - 1))
        grams = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE))))
        # Texts that repeat count once for their block.
        texts = stored.select("block", F.col(self.column)).distinct()
        held = texts.filter(F.char_length(text) >= SIZE).select("block", F.explode(grams).alias("gram")).distinct()
        lists = held.groupBy("gram", F.floor(F.col("block") / SEGMENT_BLOCKS).alias("segment")).agg(
            F.sort_array(F.collect_list("block")).alias("blocks"), F.count("*").alias("holders")
        )

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = pa.array([packed(x) for x in batch.column("blocks").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("holders"), made], names=["gram", "holders", "list"])

        # In the order of the characters, so that a search reads few row groups.
        lists.mapInArrow(pack, "gram string, holders bigint, list binary").sort("gram").write.parquet(f"{self.path}/lists/added={name}")

    def candidates(self, text: str, literal: bool = False) -> list[tuple[str, int]]:
        """Folders and numbers of the blocks that may hold the pattern.

        At most one number a block comes to the driver, which has to name the files anyway.
        """
        blocks = [(r.folder, r.block) for r in self._blocks().collect()]
        wanted = required_trigrams(text, literal)
        if not wanted or not blocks:
            return blocks
        known = "gram string, holders bigint, list binary, added string"
        rows = self.spark.read.schema(known).parquet(f"{self.path}/lists").filter(F.col("gram").isin(*sorted(wanted))).collect()
        lists: dict[str, list] = {g: [] for g in wanted}
        for r in rows:
            lists[r.gram].append(r)
        left: np.ndarray | None = None
        for own in sorted(lists.values(), key=lambda x: sum(r.holders for r in x)):
            found = np.sort(np.concatenate([unpacked(r.list) for r in own])) if own else np.zeros(0, np.int64)
            left = found if left is None else np.intersect1d(left, found, assume_unique=True)
            if not len(left):
                break
        kept = set(left.tolist())
        return [b for b in blocks if b[1] in kept]

    def search(self, text: str, literal: bool = False) -> DataFrame:
        """Rows whose text holds the pattern, whatever the case of ASCII letters."""
        found = self.candidates(text, literal)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{folder}/block={n}" for folder, n in sorted(found)])
        return rows.filter(contains_nocase(fold_case(F.col(self.column).cast("string")), text, literal))
