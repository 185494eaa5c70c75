"""Connected components of a graph given as a table of links.

Tasks first replace their own links by a forest. Then large-star and small-star
steps alternate until every node points at the smallest node of its component.
All steps are aggregates and joins; no node's links are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK_LINKS = 200_000


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node that isn't the smallest of its component, with that smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _local(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int]] = []
        for batch in batches:
            waiting += zip(*[c.to_pylist() for c in batch.columns])
            if len(waiting) >= CHUNK_LINKS:
                yield _batch(forest(waiting))
                waiting = []
        if waiting:
            yield _batch(forest(waiting))

    return links.mapInArrow(run, "u bigint, v bigint")


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}
    )


def _with_smallest(links: DataFrame) -> DataFrame:
    # The minima are materialised, so that a node with very many links can be split in the join.
    smallest = cut(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(smallest, "u")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with a link.

    Links with a NULL end or from a node to itself say nothing. Repeated and
    reversed links are one. Without links the result is empty.
    """
    # Links come from Python as a rule; kept apart, a task needs one worker at a time and not two.
    pairs = cut(links.select(F.col(a).cast("long"), F.col(b).cast("long")).dropna())
    stars = cut(_local(pairs).distinct())
    while True:
        several = stars.groupBy("u").count().filter("count > 1").limit(1)
        inner = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
        if not several.select("u").union(inner.select("u")).take(1):
            break
        both = stars.union(stars.select(F.col("v"), F.col("u")))
        large = _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _with_smallest(cut(large.distinct()))
        small = small.select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("x")).select("x.*")
        stars = cut(small.filter("u <> v").distinct())
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
