"""What the operators share: batches in workers, a cache that outlives a task, reliable cuts of lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, shared_root

# Rows that are turned into Python objects at a time.
SLICE_ROWS = 256
# ASCII white space, which is what separates words.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so tasks share what they learned.

    Everything kept here is a pure function of its key; a new worker just starts empty.
    """
    holder = sys.modules.get("_folioscope_worker")
    if holder is None:
        holder = sys.modules["_folioscope_worker"] = types.ModuleType("_folioscope_worker")
    kept = holder.__dict__.setdefault("caches", {})
    if name not in kept:
        # A worker goes from one operator to the next; what the last one learned makes room.
        if kept:
            kept.clear()
            give_back_memory()
        kept[name] = {}
    return kept[name]


def give_back_memory() -> None:
    """Hand memory that nothing uses any more back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded(cache: dict, most: int) -> dict:
    """Empty a cache that has outgrown its bound."""
    if len(cache) > most:
        cache.clear()
    return cache


class Recent:
    """What was learned about words, bounded in bytes.

    There are two generations. Once the young one is full it becomes the old one,
    whose words move back as they are met again, so common words are never lost.
    """

    # An entry's place in the table and the heads of its key and value.
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.half, self.size = most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Those of the keys that have to be learned; all others are in ``young`` now."""
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        fresh = keys.difference(self.young)
        if self.old:
            again = fresh & self.old.keys()
            for key in again:
                self.add(key, self.old[key])
            fresh -= again
        return fresh

    def add(self, key: str, value, weight: int = 0) -> None:
        self.young[key] = value
        self.size += self.ENTRY + len(key) + len(value) + weight


def map_slices(df: DataFrame, work: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Apply ``work`` to columns as lists, a bounded number of rows at a time.

    ``work`` gets one list for each input column and returns one for each field of ``schema``.
    """
    names = [x.name for x in _fields(schema)]
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, t in zip(made, kinds)], names=names
                )

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, inputs: list[str], work: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Like ``map_slices``, row by row: every column of ``df`` stays and those of ``schema`` follow.

    A column that has the name of a new one is replaced.
    """
    from pyspark.sql.types import StructType

    df = df.drop(*(f.name for f in _fields(schema) if f.name not in inputs))
    names = [*df.columns, *(x.name for x in _fields(schema))]
    kinds = _arrow(schema)
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = work([part.column(i).to_pylist() for i in places])
                new = [pa.array(v, type=t) for v, t in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *_fields(schema)]))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _fields(schema)]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
