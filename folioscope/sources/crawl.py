"""Complete crawls of mounted file trees: every name, directories too, with owners, times and errors.

``file_tree`` is a data source with one split for each root. A split lists directories
breadth first and stops after a budget; those it has met and not listed come back as pending
rows. ``crawl`` deals pending directories out anew, round by round, until none is left, so a
deep or lopsided tree is shared out among all tasks and no list of directories passes the driver.

Hidden names and empty directories are listed. Symbolic links are not followed: a link to a
directory is a row of kind ``link``, counts among its parent's sub-directories and has nothing
below it. What can't be listed or has no status stays as a row with an error and without
counts. A root that is missing or no directory is such a row. Names that aren't UTF-8 are shown
with replacement characters. The trees must be mounted under the same path on all executors.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual,
)

from ..functions import paths
from ..session import shared_dir

#: Directories that a split lists before it hands over the rest, in the first round and in later ones.
FIRST_BUDGET, BUDGET = 64, 4_096
BATCH_ROWS = 4_096
SCHEMA = """root_path string, path string, parent_path string, name string, depth int, kind string, size_bytes bigint,
 created_ts timestamp, modified_ts timestamp, owner string, num_files bigint, num_subdirs bigint, error string,
 pending boolean, raw binary"""
_STAMP = pa.timestamp("us", tz="UTC")
ARROW = pa.schema([
    ("root_path", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("name", pa.string()),
    ("depth", pa.int32()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("created_ts", _STAMP), ("modified_ts", _STAMP),
    ("owner", pa.string()), ("num_files", pa.int64()), ("num_subdirs", pa.int64()), ("error", pa.string()),
    ("pending", pa.bool_()), ("raw", pa.binary()),
])


def _shown(path: bytes) -> str:
    return path.decode("utf-8", "replace")


class _Owners:
    """Names of users by number; unknown ones have none."""

    def __init__(self):
        self.known: dict[int, str | None] = {}

    def __getitem__(self, uid: int) -> str | None:
        if uid not in self.known:
            import pwd

            try:
                self.known[uid] = pwd.getpwuid(uid).pw_name
            except KeyError:
                self.known[uid] = None
        return self.known[uid]


def _status(path: bytes, owners: _Owners, follow: bool) -> dict:
    try:
        st = os.stat(path, follow_symlinks=follow)
    except OSError as exc:
        return {"error": f"stat_error: {exc.strerror}"}
    # The time of the last change of status stands for the creation, as no portable call tells it.
    stamp = {"created_ts": int(st.st_ctime * 1e6), "modified_ts": int(st.st_mtime * 1e6)}
    return {"size_bytes": st.st_size, "owner": owners[st.st_uid], **stamp}


def walk(
    starts: Iterable[tuple[str, bytes, int]], budget: int, max_depth: int | None = None, kinds: frozenset | None = None,
) -> Iterator[dict]:
    """Rows of the directories (root, path, depth) and of all below, until ``budget`` directories are listed.

    What is left over comes as pending rows. Directories below ``max_depth`` are not opened,
    and files are not looked at where ``kinds`` leaves them out.
    """
    owners, waiting = _Owners(), deque(starts)
    while waiting:
        root, path, depth = waiting.popleft()
        own = {"root_path": root, "depth": depth, "pending": False}
        own |= {"path": _shown(path), "parent_path": _shown(os.path.dirname(path)) if depth else None}
        own |= {"name": _shown(os.path.basename(path) or path), "kind": "directory"}
        if budget <= 0:
            yield own | {"pending": True, "raw": path}
            continue
        budget -= 1
        status = _status(path, owners, True)
        status.pop("size_bytes", None)
        files = folders = 0
        try:
            with os.scandir(path) as entries:
                for entry in entries:
                    try:
                        folder = entry.is_dir()
                    except OSError:
                        folder = False
                    files, folders = files + (not folder), folders + folder
                    if max_depth is not None and depth >= max_depth:
                        continue
                    link = entry.is_symlink()
                    if folder and not link:
                        waiting.append((root, entry.path, depth + 1))
                        continue
                    kind = "link" if folder else "file"
                    if kinds is None or kind in kinds:
                        yield {
                            "root_path": root, "path": _shown(entry.path), "parent_path": own["path"], "name": _shown(entry.name),
                            "depth": depth + 1, "kind": kind, "pending": False, **_status(entry.path, owners, kind == "file"),
                        }
        except OSError as exc:
            status["error"] = f"walk_error: {exc.strerror}"
            files = folders = None
        if kinds is None or "directory" in kinds:
            yield own | status | {"num_files": files, "num_subdirs": folders}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, ARROW)


class Root(InputPartition):
    """One root to start from."""


class TreeReader(DataSourceReader):
    """Lists roots; limits on depth, kind and root are applied while walking."""

    def __init__(self, roots: list[str], budget: int):
        self.roots, self.budget = roots, budget
        self.max_depth: int | None = None
        self.kinds: frozenset | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("depth",):
                most = f.value - isinstance(f, LessThan)
                self.max_depth = most if self.max_depth is None else min(most, self.max_depth)
                self.roots = self.roots if most >= 0 else []
            elif isinstance(f, EqualTo) and f.attribute == ("root_path",):
                self.roots = [r for r in self.roots if r == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("kind",):
                # Pending rows are of kind directory, so without them all files below would be missing.
                if f.value != "directory":
                    yield f
                    continue
                self.kinds = frozenset([f.value])
            else:
                yield f

    def partitions(self) -> list[Root]:
        return [Root(r) for r in self.roots]

    def read(self, partition: Root) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no root is left
            return iter(())
        return _batches(walk([(partition.value, os.fsencode(partition.value), 0)], self.budget, self.max_depth, self.kinds))


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("roots", '["/srv/a"]')``; without a ``budget`` nothing is left pending."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        roots = json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]
        return TreeReader([_local(r) for r in roots], int(self.options.get("budget", 1 << 62)))


def _local(root: str) -> str:
    """A path as the operating system takes it."""
    plain = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    return os.path.normpath(plain) if plain else plain


def register(spark: SparkSession) -> None:
    """Make ``file_tree`` known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def crawl(
    spark: SparkSession, roots: list[str], max_depth: int | None = None, directories_only: bool = False,
    first_budget: int = FIRST_BUDGET, budget: int = BUDGET,
) -> DataFrame:
    """Everything below the roots, each of which is a directory at depth 0."""
    register(spark)
    found = spark.read.format("file_tree").option("roots", json.dumps([*dict.fromkeys(roots)])).option("budget", first_budget).load()
    if max_depth is not None:
        found = found.filter(F.col("depth") <= max_depth)
    if directories_only:
        found = found.filter(F.col("kind") == "directory")
    kinds = frozenset(["directory"]) if directories_only else None

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One budget for all directories of the task.
        starts = (tuple(r.values()) for b in batches for r in b.to_pylist())
        yield from _batches(walk(starts, budget, max_depth, kinds))

    rounds = []
    while True:
        path = shared_dir(spark, "crawl")
        found.write.parquet(path)
        stored = spark.read.schema(SCHEMA).parquet(path)
        rounds.append(stored.filter("not pending"))
        waiting = stored.filter("pending").select("root_path", "raw", "depth")
        if not waiting.take(1):
            break
        # Dealt out by a hash of the path, so that no task gets one subtree.
        tasks = max(spark.sparkContext.defaultParallelism, waiting.count() // BUDGET + 1)
        found = waiting.repartition(tasks, F.xxhash64("raw")).mapInArrow(again, SCHEMA)
    whole = rounds[0]
    for part in rounds[1:]:
        whole = whole.unionAll(part)
    return whole.drop("pending", "raw")


def crawled_directories(crawled: DataFrame) -> DataFrame:
    """The directories of a crawl, empty ones too, with counts of what is directly in them."""
    return crawled.filter("kind = 'directory'").select(
        "root_path", "path", "parent_path", "name", "depth", "created_ts", "modified_ts", "num_files", "num_subdirs",
        F.col("error").alias("walk_error"),
    )


def crawled_files(crawled: DataFrame) -> DataFrame:
    """The files of a crawl with the columns of a catalog; one without status has an error in their place."""
    files = crawled.filter("kind = 'file'")
    return files.select(
        "root_path", "path", F.col("name").alias("file_name"), paths.subfolder("root_path", "path").alias("subfolder"),
        paths.extension_key("name").alias("extension"), "size_bytes", "created_ts", "modified_ts",
        *(c.alias(n) for n, c in paths.owner_columns("owner").items()), F.col("error").alias("read_error"),
    )


def crawl_summary(crawled: DataFrame) -> DataFrame:
    """Directories, files, bytes and errors by root."""
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("error").isNull())
    return crawled.groupBy("root_path").agg(
        of("directory").alias("directories"), of("file").alias("files"), F.sum(F.when(F.col("kind") == "file", F.col("size_bytes"))).alias("size_bytes"),
        F.count("error").alias("errors"),
    )
