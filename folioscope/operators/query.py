"""Filtered, sorted and paged catalog queries."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PAGE_SIZE
from .ranking import positioned

# Columns a user may sort by.
AUDIT_SORT_COLUMNS = (
    "file_name", "subfolder", "created_at", "modified_at", "modified_by", "extension",
)
CATALOG_SORT_COLUMNS = (
    "file_name", "subfolder", "extension", "size_bytes",
    "created_at", "created_by", "modified_at", "modified_by",
)
AUDIT_SORT_KEYS = 3

# Rows a top-k may hold per task before a page is located by position instead.
DEEP_PAGE_ROWS = 100_000


def fold_case(column: Column | str) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def contains_nocase(folded: Column, text: str, literal: bool = False) -> Column:
    """Substring match in a column that went through :func:`fold_case`.

    ``%`` and ``_`` in ``text`` stay wildcards and a backslash is an ordinary
    character, unless ``literal`` is set.
    """
    wanted = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    if literal or not set(wanted) & set("%_"):
        return folded.contains(wanted)
    return folded.like("%" + wanted.replace("\\", "\\\\") + "%")


@dataclass(frozen=True)
class CatalogFilter:
    """Optional predicates, all of which must hold.

    ``equals`` names partition columns such as ``root_path`` or ``run_id``.
    With ``null_as_blank`` a NULL extension counts as '' and a NULL subfolder as
    '/'; without it NULL never matches.
    """

    equals: dict[str, object] = field(default_factory=dict)
    extensions: Sequence[str] = ()
    subfolder_contains: str | None = None
    null_as_blank: bool = True
    literal: bool = False

    def predicate(self, folded: str | None = None) -> Column:
        """All conditions; ``folded`` names a stored case-folded subfolder column.

        NULL is matched beside the plain comparison and not inside a COALESCE,
        so the comparison still reaches the Parquet reader.
        """
        extension, subfolder = F.col("extension"), F.col("subfolder")
        parts = [F.col(name) == value for name, value in self.equals.items()]
        if self.extensions:
            listed = extension.isin(*self.extensions)
            blank = self.null_as_blank and "" in self.extensions
            parts.append(listed | extension.isNull() if blank else listed)
        if self.subfolder_contains:
            target = F.col(folded) if folded else fold_case(subfolder)
            found = contains_nocase(target, self.subfolder_contains, self.literal)
            if self.null_as_blank:
                blank = contains_nocase(F.lit("/"), self.subfolder_contains, self.literal)
                found = found | (target.isNull() & blank)
            parts.append(found)
        return reduce(and_, parts, F.lit(True))

    def apply(self, files: DataFrame) -> DataFrame:
        return files.filter(self.predicate("subfolder_lc" if "subfolder_lc" in files.columns else None))


def audit_order(instructions: Sequence[tuple[str, str]]) -> list[Column]:
    """Up to three ``(column, direction)`` keys, then the path.

    The first three instructions are taken before unknown columns are dropped.
    Every direction but 'asc' means descending.
    """
    keys = [
        F.asc(name) if direction.lower() == "asc" else F.desc(name)
        for name, direction in instructions[:AUDIT_SORT_KEYS]
        if name in AUDIT_SORT_COLUMNS
    ]
    return [*(keys or [F.asc("file_name")]), F.asc("path")]


def catalog_order(column: str = "subfolder", direction: str = "ASC") -> list[Column]:
    """One checked key, then file name, then path. Only 'DESC' means descending."""
    name = column if column in CATALOG_SORT_COLUMNS else "subfolder"
    first = F.desc(name) if direction.upper() == "DESC" else F.asc(name)
    return [first, F.asc("file_name"), F.asc("path")]


def page(
    df: DataFrame, order: Sequence[Column], number: int = 0, size: int = PAGE_SIZE,
    deep_after: int = DEEP_PAGE_ROWS,
) -> DataFrame:
    """Rows of one page; a negative page number means the first.

    Near pages are a single top-k. A page that ends past ``deep_after`` rows
    would make every task keep that many, so it is found by global position.
    """
    offset = max(number, 0) * size
    if offset + size <= deep_after:
        return df.orderBy(*order).offset(offset).limit(size)
    ranked = positioned(df, order, "_position")
    wanted = (F.col("_position") > offset) & (F.col("_position") <= offset + size)
    return ranked.filter(wanted).orderBy("_position").drop("_position")


def page_after(
    df: DataFrame, keys: Sequence[str], last: Sequence[object], size: int = PAGE_SIZE,
    descending: Sequence[str] = (),
) -> DataFrame:
    """Next page by ``keys`` after the ``last`` row seen.

    Keys ascend with NULL first, or descend with NULL last where they are named
    in ``descending``, as Spark orders them.
    """
    later = F.lit(False)
    for name, value in reversed(list(zip(keys, last, strict=True))):
        column = F.col(name)
        if value is None:
            beyond = F.lit(False) if name in descending else column.isNotNull()
            later = beyond | (column.isNull() & later)
        elif name in descending:
            later = (column < value) | column.isNull() | ((column == value) & later)
        else:
            later = (column > value) | ((column == value) & later)
    order = [F.desc(k) if k in descending else F.asc(k) for k in keys]
    return df.filter(later).orderBy(*order).limit(size)


def page_total(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row: number of rows and of pages, which is 0 only for no rows."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.ceil(total / F.lit(size)).cast("long").alias("pages")
    )


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return max(math.ceil(total / size), 1) if total else 0


def distinct_values(files: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """Sorted distinct values of a column, NULL replaced by ``default``."""
    value = F.col(column) if default is None else F.coalesce(F.col(column), F.lit(default))
    return files.select(value.alias(column)).distinct().orderBy(column)


def summary_listing(files: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with their label, one row per label, in id order."""
    listing = (
        files.join(labels, "file_id", "left")
        .withColumn("business_category", F.coalesce("business_category", F.lit("")))
        .orderBy("file_id", "business_category")
    )
    return listing if limit is None else listing.limit(limit)


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal the given keys."""
    return df.filter(reduce(and_, (F.col(name) == value for name, value in keys.items())))


def peek(files: DataFrame, content: DataFrame, limit: int, preview: int = 2_000) -> DataFrame:
    """The first files by id with the beginning of their text."""
    first = files.orderBy("file_id").limit(limit)
    texts = content.select("file_id", F.substring("content_text", 1, preview).alias("preview"))
    return first.join(texts, "file_id", "left").withColumn("preview", F.coalesce("preview", F.lit("")))


def run_order() -> list[Column]:
    """Running, then queued, then the rest; newest activity first."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    activity = F.coalesce("completed_at", "started_at", "queued_at")
    return [rank, activity.desc(), F.asc("root_path")]
