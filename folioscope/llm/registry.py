"""Registered queries of this subpackage, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

MODULES = ("queries",)


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def registered() -> dict[str, Query]:
    """All queries by name."""
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return dict(REGISTRY)
