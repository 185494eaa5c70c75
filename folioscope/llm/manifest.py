"""Merkle manifest of a dataset as a persistent tree: a changed leaf makes a version, not a new tree.

Rows of a source are leaves in the order of their ids. Every ``FANOUT`` neighbours hash into
a node until one is left, the source's root, and the sources' roots hash into the dataset's
in the same way.

1. Leaves get their place in their source from one range-partitioned sort.
2. Aligned blocks of ``BLOCK`` leaves, each under one node, are built in one task each and
   stored as a row. Their top nodes are the leaves of the next round of blocks, and so on, so
   neither a large source nor many sources meet in one task. Each round keeps, for every node,
   the path of siblings up to the top of its block; paths are joined from round to round.
3. A changed leaf copies the nodes above it inside its block, reads all others from the block,
   and goes on along the upper path. The last node that it copies is its version's root.

Fields are NULL-safe: a NULL is written as ``-``. A NULL source is a group of its own, before
all others. NULL ids come first in their source, and rows with equal ids are ordered by their
digests, so repeated rows are leaves of their own. Empty texts are fields of length 0. Other
columns are not read. An empty table has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positioned
from ..session import small_side
from .common import written

FANOUT, LEVELS = 3, 6
#: Leaves, or nodes of a later round, that one task holds together.
BLOCK = FANOUT**LEVELS
#: Most rows with paths, of one to two kilobytes each, that are broadcast.
PATH_ROWS = 5_000


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbours can't be mistaken for one another."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def parent(digests: list[str]) -> str:
    """The node above some neighbours, from their digests as text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Tree:
    """Nodes of a block by level, leaves first. A version shares all of them but those it copies."""

    def __init__(self, leaves: list[str], whole: bool):
        """``whole`` is a block that holds all there is; others go on to the height of a full block."""
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 or not whole and len(self.levels) <= LEVELS:
            below = self.levels[-1]
            self.levels.append([parent(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[list[str], list[str]]]:
        """Siblings to the left and right of a leaf and of the nodes above it, level by level."""
        steps = []
        for level in self.levels[:-1]:
            first = at - at % FANOUT
            steps.append((level[first:at], level[at + 1 : first + FANOUT]))
            at //= FANOUT
        return steps


def copied(digest: str, path: list[tuple[list[str], list[str]]]) -> list[str]:
    """A leaf's new digest and the nodes that it makes, up to the root."""
    made = [digest]
    for left, right in path:
        digest = parent([*left, digest, *right])
        made.append(digest)
    return made


def proof(path: list[tuple[list[str], list[str]]]) -> str:
    """All siblings of a path, as text."""
    return "".join("".join(left) + "".join(right) for left, right in path)


PATH = "array<struct<left array<string>, right array<string>>>"


def _steps(raw: list[dict] | None) -> list[tuple[list[str], list[str]]]:
    return [(x["left"], x["right"]) for x in raw or []]


def _in_blocks(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: nodes (tree, idx, n, digest) with block and path inside it, and the blocks' tops."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree = Tree(table["digest"].to_pylist(), table["n"][0].as_py() <= BLOCK)
        paths = [[{"left": a, "right": b} for a, b in tree.path(i)] for i in range(table.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        return table.append_column("path", pa.array(paths, kind)).append_column("top", pa.array([tree.top] * len(paths)))

    shape = f"tree string, idx bigint, n bigint, digest string, block bigint, path {PATH}, top string"
    marked = nodes.select("tree", "idx", "n", "digest", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"))
    inner = written(marked.groupBy("tree", "block").applyInArrow(build, shape), "round")
    tops = inner.filter(F.col("idx") % BLOCK == 0).select(
        "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("digest")
    )
    return inner, tops


def paths(nodes: DataFrame) -> DataFrame:
    """The path of every node to the root of its tree, and that root."""
    inner, tops = _in_blocks(nodes)
    if not tops.filter("n > 1").take(1):
        return inner.select("tree", "idx", "path", F.col("top").alias("root"))
    above = paths(tops).select("tree", F.col("idx").alias("block"), F.col("path").alias("upper"), "root")
    joined = inner.join(small_side(above, PATH_ROWS), ["tree", "block"])
    return joined.select("tree", "idx", F.concat("path", "upper").alias("path"), "root")


def _numbered(rows: DataFrame) -> DataFrame:
    """Leaves with their place in their tree, counted from 0, and the tree's number of leaves."""
    # Rows alike in every column may lie in any order; their split keeps them from meeting in one range.
    apart = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = written(positioned(apart, [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")], "at"), "leaves")
    trees = placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    joined = placed.join(small_side(written(trees, "trees")), "tree")
    return joined.select("tree", "doc_id", "leaf", "changed", (F.col("at") - F.col("first")).alias("idx"), "n")


def _blocks(leaves: DataFrame) -> DataFrame:
    """Blocks of leaves as rows: ids, digests, changed digests and the block's top."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        whole = table["n"][0].as_py() <= BLOCK
        top = Tree(table["leaf"].to_pylist(), whole).top
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        row = (table["tree"][0].as_py(), table["block"][0].as_py(), table["n"][0].as_py(),
               *(table[c].to_pylist() for c in ("doc_id", "leaf", "changed")), top)
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=["tree", "block", "n", "ids", "leaves", "changed", "top"])

    marked = leaves.select("tree", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"), "idx", "n", "doc_id", "leaf", "changed")
    return marked.groupBy("tree", "block").applyInArrow(
        build, "tree string, block bigint, n bigint, ids array<bigint>, leaves array<string>, changed array<string>, top string"
    )


def versions(leaves: DataFrame) -> DataFrame:
    """Every leaf with its roots and proof, and the nodes that its changed digest copies.

    ``leaves`` has ``tree`` (the source; trees are ordered by it), ``doc_id``, ``leaf`` and
    ``changed``, which is NULL for leaves that stay. ``copies`` goes from the changed leaf to
    the root of its version; for a leaf that stays these are itself and its own ancestors.
    """
    stored = written(_blocks(_numbered(leaves)), "blocks")
    tops = stored.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("digest"))
    upper = written(paths(tops), "paths").withColumnsRenamed({"root": "subroot"})
    # Roots of trees are the leaves of one more tree.
    roots = written(upper.filter("idx = 0").select("tree", "subroot"), "roots")
    order = positioned(roots, [F.col("tree")], "at")
    last = paths(order.select(
        F.lit("").alias("tree"), (F.col("at") - 1).alias("idx"), F.lit(roots.count()).cast("long").alias("n"), F.col("subroot").alias("digest")
    ))
    named = order.withColumn("idx", F.col("at") - 1).select("tree", "idx").join(
        last.select("idx", F.col("path").alias("last"), "root"), "idx"
    ).drop("idx")
    whole = upper.join(small_side(named, PATH_ROWS), "tree").select(
        "tree", F.col("idx").alias("block"), F.concat("path", "last").alias("upper"), "subroot", "root"
    )
    kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.bool_()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "copies", "is_changed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree, above = Tree(row["leaves"], row["n"] <= BLOCK), _steps(row["upper"])
                shared, out = proof(above), []
                for at, (doc, leaf, new) in enumerate(zip(row["ids"], row["leaves"], row["changed"])):
                    inside = tree.path(at)
                    seen = hashlib.sha256((proof(inside) + shared).encode()).hexdigest()
                    made = copied(leaf if new is None else new, inside + above)
                    out.append((doc, leaf, row["subroot"], row["root"], seen, made, new is not None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    joined = stored.select("tree", "block", "n", "ids", "leaves", "changed").join(small_side(whole, PATH_ROWS), ["tree", "block"])
    return joined.select("n", "ids", "leaves", "changed", "upper", "subroot", "root").mapInArrow(
        run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, copies array<string>, is_changed boolean"
    )


def dataset_leaves(documents: DataFrame, fields: list[str], changed: Column | None = None) -> DataFrame:
    """Leaves of a table of documents; where ``changed`` isn't NULL it replaces the text."""
    plain = [F.col(f) for f in fields]
    other = [F.col(f) if f != "text" else changed for f in fields]
    new = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_digest(other))
    # NULL sorts before every source, the empty one too.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return documents.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(plain).alias("leaf"), new.alias("changed")
    )


def audited(documents: DataFrame, fields: list[str], tampered: Column, text: Column) -> DataFrame:
    """Every document's place in the manifest, and whether it still verifies after tampering with some texts."""
    # Tampering with a NULL text leaves a NULL, whose leaf is what it was.
    changed = F.when(tampered, F.coalesce(text, F.lit(None).cast("string")))
    found = versions(dataset_leaves(documents, fields, changed))
    folded = F.element_at("copies", -1)
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"),
        folded.eqNullSafe(F.col("root")).alias("verified"), (F.size("copies") - 1).alias("n_copies"), "is_changed",
    )
