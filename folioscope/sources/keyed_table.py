"""A keyed table on shared storage: batches are appended and merged when read, and folded in now and then.

Rows lie in files by ranges of the key. A manifest lists the files of one version with their
ranges, lowest and highest keys and numbers of rows; beside each file lies a Bloom filter of its
keys. A version's manifest is one file, so it is there whole or not at all: a reader sees the
old version or the new one, and two writers of one version don't both succeed. Files are never
changed, so a reader may stay on its version.

``append`` writes a batch as a delta. ``read`` folds deltas, the latest last. ``compact`` moves
deltas into the ranges: a file is written anew only where its Bloom filter may hold a key that
changes; keys that no file holds become a file of their own in their range. A range of many
files is merged, and a range that has grown is cut into several.

Key columns must not be NULL; such a row is an error. A key has one row. A batch may repeat a
key; ``seq`` orders its rows. ``keep`` columns hold on to their old value when the new one is
NULL. Empty tables and batches are fine.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import latest, upsert
from ..session import checkpointed, small_side

FILE_ROWS, RANGE_FILES, DELTAS = 200_000, 4, 8
BITS_PER_KEY, PROBES = 10, 7


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, by two halves of one hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """A Bloom filter of some keys' hashes."""
    size = max(8, -(-len(hashes) * BITS_PER_KEY // 8))
    bits = np.zeros(size * 8, np.uint8)
    bits[_positions(hashes, size * 8).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for one that is."""
    raw = np.frombuffer(filter_, np.uint8)
    at = _positions(hashes, len(raw) * 8)
    return ((raw[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


class KeyedTable:
    """One table; every method sees the version that is the latest when it is called."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], keep: Sequence[str] = (),
        file_rows: int = FILE_ROWS,
    ):
        self.spark, self.path, self.keys, self.keep, self.file_rows = spark, path.rstrip("/"), list(keys), list(keep), file_rows
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        key = T.StructType([self.schema[k] for k in self.keys])
        self.listed = T.StructType([
            T.StructField("file", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("range_no", T.LongType()),
            T.StructField("range_low", key), T.StructField("low", key), T.StructField("high", key), T.StructField("n_rows", T.LongType()),
        ])

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], keep: Sequence[str] = (), file_rows: int = FILE_ROWS) -> KeyedTable:
        """Write a new table; ``rows`` has one row a key."""
        table = cls(rows.sparkSession, path, rows.schema, keys, keep, file_rows)
        files = table._write(rows.withColumn("range_no", F.lit(0).cast("long")))
        ranges = sorted(files, key=lambda f: tuple(f["low"]))
        table._commit(1, [f | {"batch": None, "range_no": i, "range_low": f["low"] if i else None} for i, f in enumerate(ranges)])
        return table

    # --- versions

    def version(self) -> int:
        """The latest version."""
        found = self.spark.read.schema(T.StructType([*self.listed.fields, T.StructField("version", T.LongType())])).parquet(f"{self.path}/manifest")
        return found.agg(F.max("version")).first()[0]

    def manifest(self, version: int | None = None) -> list[dict]:
        """Files of a version: one for each ``file_rows`` rows or so."""
        version = self.version() if version is None else version
        rows = self.spark.read.schema(self.listed).parquet(f"{self.path}/manifest/version={version}").collect()
        return [r.asDict() for r in rows if r.file is not None]

    def _commit(self, version: int, files: list[dict]) -> None:
        names = self.listed.names
        # A version without files has one empty line, as a folder without any line has no version.
        lines = [tuple(f[n] for n in names) for f in files] or [(None,) * len(names)]
        made = self.spark.createDataFrame(lines, self.listed)
        made.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    # --- files

    def _key(self) -> Column:
        return F.struct(*self.keys)

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _write(self, rows: DataFrame) -> list[dict]:
        """Write rows with their ``range_no``, in files that don't cross ranges; what the manifest says of these."""
        count = rows.count()
        if not count:
            return []
        name = uuid.uuid4().hex
        missing = " or ".join(f"`{k}` is null" for k in self.keys)
        checked = rows.withColumn(self.keys[0], F.expr(f"if({missing}, raise_error('a key column is NULL'), `{self.keys[0]}`)"))
        parts = max(1, -(-count // self.file_rows))
        dealt = checked.repartitionByRange(parts, "range_no", *self.keys).withColumn(
            "_file", F.concat_ws("-", F.col("range_no").cast("string"), F.spark_partition_id().cast("string"))
        ).sortWithinPartitions("range_no", *self.keys)
        folder = f"{self.path}/data/{name}"
        dealt.select(*self.schema.names, "range_no", "_file").write.partitionBy("range_no", "_file").parquet(folder)
        whole = T.StructType([*self.schema.fields, T.StructField("range_no", T.LongType()), T.StructField("_file", T.StringType())])
        stored = self.spark.read.schema(whole).parquet(folder)

        def filters(group: pa.Table) -> pa.Table:
            made = bloom(group["h"].to_numpy())
            return pa.table({"file": pa.array([group["_file"][0].as_py()]), "bloom": pa.array([made], pa.binary())})

        hashed = stored.select("_file", self._hash().alias("h"))
        # A file has a bounded number of rows.
        hashed.groupBy("_file").applyInArrow(filters, "file string, bloom binary").withColumn(
            "file", F.concat(F.lit(f"{name}/"), "file")
        ).write.parquet(f"{self.path}/blooms/{name}")
        stats = stored.groupBy("range_no", "_file").agg(
            F.min(self._key()).alias("low"), F.max(self._key()).alias("high"), F.count("*").alias("n_rows")
        ).collect()
        return [
            {"file": f"{name}/range_no={r.range_no}/_file={r._file}", "batch": None, "range_no": r.range_no, "range_low": None,
             "low": r.low, "high": r.high, "n_rows": r.n_rows} for r in stats
        ]

    def _rows(self, files: list[dict]) -> DataFrame:
        """The rows of some files as they were written."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f['file']}" for f in files])

    def _blooms(self, files: list[dict]) -> DataFrame:
        """Files with their ranges and filters."""
        listed = self.spark.createDataFrame(
            [(f["file"], f["range_no"], f"{f['file'].split('/')[0]}/{f['file'].rsplit('=', 1)[1]}") for f in files],
            "path string, range_no long, file string",
        )
        folders = sorted({f["file"].split("/")[0] for f in files})
        stored = self.spark.read.schema("file string, bloom binary").parquet(*[f"{self.path}/blooms/{n}" for n in folders])
        return listed.join(stored, "file").select("path", "range_no", "bloom")

    def _deltas(self, files: list[dict]) -> DataFrame:
        """Rows of the deltas with the number of their batch."""
        batches = sorted({f["batch"] for f in files})
        parts = [
            self._rows([f for f in files if f["batch"] == b]).withColumn("_order", F.lit(b).cast("long")) for b in batches
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    # --- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows in a version, the latest one by default."""
        files = self.manifest(version)
        deltas = [f for f in files if f["batch"] is not None]
        base = self._rows([f for f in files if f["batch"] is None])
        return upsert(base, self._deltas(deltas), self.keys, "_order", self.keep) if deltas else base

    def append(self, batch: DataFrame, seq: str | None = None, deltas: int = DELTAS) -> int:
        """Insert or update by key as a new version, its number; many deltas are folded in."""
        fresh = batch if seq is None else latest(batch, self.keys, seq, self.keep)
        version = self.version() + 1
        files = self.manifest(version - 1)
        added = self._write(fresh.select(*self.schema.names).withColumn("range_no", F.lit(-1).cast("long")))
        self._commit(version, [*files, *(f | {"batch": version} for f in added)])
        if len({f["batch"] for f in files if f["batch"] is not None} | {version}) >= deltas:
            self.compact()
        return version

    def _placed(self, rows: DataFrame, base: list[dict]) -> DataFrame:
        """Add the number of the range that a key belongs to."""
        starts = sorted({(tuple(f["range_low"]), f["range_no"]) for f in base if f["range_low"] is not None})
        first = next((f["range_no"] for f in base if f["range_low"] is None), 0)
        lows, numbers = [s[0] for s in starts], [first, *(s[1] for s in starts)]
        keys = self.keys

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = zip(*(batch.column(k).to_pylist() for k in keys))
                found = pa.array([numbers[bisect_right(lows, k)] for k in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "range_no"])

        return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("range_no", T.LongType())]))

    def _holding(self, keyed: DataFrame, base: list[dict]) -> set[str]:
        """Files whose filters may hold one of the keys (with ``range_no``)."""
        if not base:
            return set()
        # A range that very many keys fall into is dealt out; its filters go with every part.
        counts = keyed.groupBy("range_no").agg(F.ceil(F.count("*") / self.file_rows).cast("long").alias("parts"))
        counts = small_side(counts)
        hashed = keyed.select("range_no", self._hash().alias("h")).join(counts, "range_no").select(
            "range_no", F.pmod("h", F.col("parts")).alias("part"), "h"
        )
        filters = self._blooms(base).join(counts, "range_no").select(
            "range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "path", "bloom"
        )

        def test(keys: pa.Table, files: pa.Table) -> pa.Table:
            h = keys["h"].to_numpy() if keys.num_rows else np.zeros(0, np.int64)
            hit = [bool(may_hold(f.as_py(), h).any()) for f in files["bloom"]] if files.num_rows else []
            return pa.table({"path": pa.array([p.as_py() for p, yes in zip(files["path"] if hit else [], hit) if yes], pa.string())})

        found = hashed.groupBy("range_no", "part").cogroup(filters.groupBy("range_no", "part")).applyInArrow(test, "path string")
        return {r.path for r in found.distinct().collect()}

    def compact(self, range_files: int = RANGE_FILES) -> dict[str, int]:
        """Fold all deltas into the ranges as a new version; how many files were rewritten, kept and added."""
        version = self.version()
        files = self.manifest(version)
        base, deltas = ([f for f in files if (f["batch"] is None) == own] for own in (True, False))
        if not deltas:
            return {"rewritten": 0, "kept": len(base), "added": 0}
        fresh = checkpointed(self._placed(latest(self._deltas(deltas), self.keys, "_order", self.keep), base))
        hit = self._holding(fresh, base)
        touched = {r.range_no for r in fresh.select("range_no").distinct().collect()}
        many = {n for n in touched if sum(f["range_no"] == n and f["file"] not in hit for f in base) >= range_files}
        old = [f for f in base if f["file"] in hit or f["range_no"] in many]
        kept = [f for f in base if f not in old]
        held = self._rows([])
        held = held.withColumn("range_no", F.lit(None).cast("long"))
        if old:
            ranged = T.StructType([*self.schema.fields, T.StructField("range_no", T.LongType())])
            paths = [f"{self.path}/data/{f['file']}" for f in old]
            held = self._placed(self.spark.read.schema(self.schema).parquet(*paths), base).select(*ranged.names)
        added = self._write(upsert(held, fresh, self.keys, None, self.keep))
        lows = {f["range_no"]: f["range_low"] for f in base}
        still = {f["range_no"] for f in kept}
        number = max([f["range_no"] for f in base], default=-1) + 1
        placed = []
        for n in sorted({f["range_no"] for f in added}):
            own = sorted((f for f in added if f["range_no"] == n), key=lambda f: tuple(f["low"]))
            for i, f in enumerate(own):
                # Pieces of a range that was written whole are ranges of their own.
                if i and n not in still:
                    placed.append(f | {"range_no": number, "range_low": f["low"]})
                    number += 1
                else:
                    placed.append(f | {"range_low": lows.get(n)})
        self._commit(version + 1, [*kept, *placed])
        return {"rewritten": len(old), "kept": len(kept), "added": len(added)}

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of some keys; only files that may hold one of them are read."""
        files = self.manifest()
        base, deltas = ([f for f in files if (f["batch"] is None) == own] for own in (True, False))
        asked = checkpointed(wanted.select(*self.keys).distinct())
        hit = self._holding(self._placed(asked, base), base)
        rows = self._rows([f for f in base if f["file"] in hit])
        if deltas:
            changed = self._deltas(deltas).join(asked, self.keys, "left_semi")
            rows = upsert(rows, changed, self.keys, "_order", self.keep)
        return rows.join(asked, self.keys, "left_semi")
