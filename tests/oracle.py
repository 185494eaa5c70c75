"""Compare registered queries with their SQL in DuckDB.

Run as a script for a report: ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_plain(v) for v in row) for row in zip(*columns))


def _types(schema):
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def difference(spark, con, build, sql, sf_dir) -> str | None:
    """Why the results differ, None when they are the same."""
    ours = build(spark, sf_dir).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} != {sorted(theirs.column_names)}"
    left, right = _types(ours.schema), _types(theirs.schema)
    if left != right:
        return f"types { {k: (left[k], right[k]) for k in left if left[k] != right[k]} }"
    (_, a), (_, b) = _rows(ours), _rows(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {x!r:.400} != {y!r:.400}"
    return None


def main() -> int:
    from folioscope.session import get_session
    from folioscope.suite import registered

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = get_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="8g",
        spark__sql__execution__arrow__maxRecordsPerBatch="2000",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, query in registered().items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        started = time.time()
        try:
            if query.sql is None:
                rows = query.build(spark, sf_dir).toArrow().num_rows
                verdict = f"rows only: {rows}"
            else:
                reason = difference(spark, con, query.build, query.sql, sf_dir)
                verdict = "same" if reason is None else f"DIFFERS {reason}"
                failed += reason is not None
        except Exception as exc:  # report and go on with the next query
            verdict, failed = f"FAILED {type(exc).__name__}: {str(exc)[:700]}", failed + 1
        print(f"{name:32s} {time.time() - started:6.2f}s {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
