"""Registered queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

MODULES = (
    "catalog_pages", "path_columns", "text_columns", "statistics", "keyed_writes",
    "run_ledger", "file_sources", "written_tables", "term_weights", "evaluation", "training", "streams",
)


def registered() -> dict[str, Query]:
    """All queries by name."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
