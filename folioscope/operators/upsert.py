"""Keyed writes as DataFrame transformations.

A table is a DataFrame with at most one row per key. A batch may repeat a key;
``seq`` is a column that orders its rows totally within a key. Every function
leaves rows whose key is not in the batch alone: they pass through an anti-join.
When the batch is proven to be small its keys are broadcast, so that it does not
shuffle a large table; otherwise both sides are shuffled by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import small_keys


def latest(batch: DataFrame, keys: Sequence[str], seq: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last row, but the last non-NULL value of ``keep`` columns.

    The aggregate is associative, so repeats of a hot key collapse before the
    shuffle.
    """
    plain = [c for c in batch.columns if c not in (*keys, *keep, seq)]
    picked = [F.max_by(F.struct(*plain), F.col(seq)).alias("_row")] if plain else []
    kept = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep
    ]
    if not picked and not kept:
        return batch.select(*keys).distinct()
    grouped = batch.groupBy(*keys).agg(*picked, *kept)
    columns = [c for c in batch.columns if c != seq]
    return grouped.select(
        *[F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in columns]
    )


def _batch_keys(batch: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the batch for semi- and anti-joins, where repeats do no harm."""
    few = small_keys(batch.select(*keys))
    return fresh.select(*keys) if few is None else few


def upsert(
    table: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    seq: str | None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Insert or update by key.

    Columns in ``keep`` hold on to their old value when the new one is NULL; all
    others are overwritten, also by NULL. Without ``seq`` the batch has one row
    per key already.
    """
    fresh = batch if seq is None else latest(batch, keys, seq, keep)
    fresh_keys = _batch_keys(batch, fresh, keys)
    untouched = table.join(fresh_keys, list(keys), "left_anti")
    if keep:
        old = table.join(fresh_keys, list(keys), "left_semi").select(
            *keys, *[F.col(c).alias(f"_old_{c}") for c in keep]
        )
        merged = fresh.join(old, list(keys), "left")
        fresh = merged.select(
            *[
                F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in keep else F.col(c)
                for c in fresh.columns
            ]
        )
    return untouched.unionByName(fresh).select(*table.columns)


def replace_root(table: DataFrame, scan: DataFrame, root_path: str) -> DataFrame:
    """Drop every row of one root, then add its new scan, which may be empty."""
    return table.filter(F.col("root_path") != root_path).unionByName(scan)


def replace_labels(
    labels: DataFrame, batch: DataFrame, seq: str | None,
    key: str = "file_id", label: str = "business_category",
) -> DataFrame:
    """Files in the batch lose their labels and get the last one given, if any."""
    fresh = batch.select(key, label)
    if seq is not None:
        fresh = latest(batch.select(key, label, seq), [key], seq)
    untouched = labels.join(_batch_keys(batch, fresh, [key]), key, "left_anti")
    return untouched.unionByName(fresh.filter(F.col(label) != "")).select(*labels.columns)


def replace_content(
    content: DataFrame, batch: DataFrame, seq: str | None, key: str = "file_id"
) -> DataFrame:
    """Files in the batch get the last text given."""
    return upsert(content, batch, [key], seq)


def drop_missing_paths(rows: DataFrame, path: str) -> DataFrame:
    """Rows with a path; NULL and white space count as missing."""
    return rows.filter(~is_blank(path))


def drop_blank_target(rows: DataFrame, target: str) -> DataFrame:
    return rows.filter(~is_blank(target))


def drop_unreadable(files: DataFrame, created: str, modified: str) -> DataFrame:
    """Files for which at least one time is known."""
    return files.filter(F.col(created).isNotNull() | F.col(modified).isNotNull())
