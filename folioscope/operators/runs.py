"""Scan-run ledger: append-only state changes and the state they add up to.

A change has ``root_path``, ``changed_at``, ``seq``, ``status``, ``total_files``,
``total_errors`` and ``error_message``. ``status`` is 'queued', 'running',
'progress', 'completed' or 'failed'. A queued change starts the run of that root
anew. Only the newest change of each kind matters, so the state is one
aggregate whose partial results are one row per root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side

LEDGER_SCHEMA = (
    "root_path string, changed_at timestamp_ntz, seq long, status string, "
    "total_files long, total_errors long, error_message string"
)


def change(
    root_path: str, changed_at: object, seq: int, status: str,
    total_files: int = 0, total_errors: int = 0, error_message: str | None = None,
) -> tuple:
    """One ledger row in the order of ``LEDGER_SCHEMA``."""
    return (root_path, changed_at, seq, status, total_files, total_errors, error_message)


def finishing_change(
    counters: DataFrame, root_path: str, finished_at: object, seq: int,
    files: str = "inserted", errors: str = "errors", error_message: str | None = None,
) -> DataFrame:
    """Ledger row that ends a run with the totals of its counters."""
    return counters.select(
        F.lit(root_path).alias("root_path"),
        F.lit(finished_at).cast("timestamp_ntz").alias("changed_at"),
        F.lit(seq).cast("long").alias("seq"),
        F.lit("completed" if error_message is None else "failed").alias("status"),
        F.col(files).cast("long").alias("total_files"),
        F.col(errors).cast("long").alias("total_errors"),
        F.lit(error_message).cast("string").alias("error_message"),
    )


def _newest(kinds: tuple[str, ...]) -> Column:
    wanted = F.col("status").isin(*kinds)
    moment = F.struct("changed_at", "seq")
    fields = F.struct(
        "changed_at", "seq", "status", "total_files", "total_errors", "error_message"
    )
    return F.max_by(F.when(wanted, fields), F.when(wanted, moment))


def ledger_aggregates() -> list[Column]:
    """Aggregates for ``groupBy("root_path")``, in batch or in a stream."""
    return [
        _newest(("queued",)).alias("_queued"),
        _newest(("running",)).alias("_started"),
        _newest(("progress", "completed", "failed")).alias("_counted"),
        _newest(("completed", "failed")).alias("_ended"),
        _newest(("queued", "running", "completed", "failed")).alias("_state"),
    ]


def _since_queued(name: str, value: Column, default: Column) -> Column:
    """``value`` of the newest such change unless a later queueing wiped it."""
    moment = F.struct(F.col(f"{name}.changed_at"), F.col(f"{name}.seq"))
    queued = F.struct(F.col("_queued.changed_at"), F.col("_queued.seq"))
    alive = F.col(name).isNotNull() & (F.col("_queued").isNull() | (moment > queued))
    return F.when(alive, value).otherwise(default)


def run_state(aggregated: DataFrame) -> DataFrame:
    """Current run rows from the result of :func:`ledger_aggregates`."""
    null_time = F.lit(None).cast("timestamp_ntz")
    started = _since_queued("_started", F.col("_started.changed_at"), null_time)
    completed = _since_queued("_ended", F.col("_ended.changed_at"), null_time)
    state = aggregated.select(
        "root_path",
        F.col("_queued.changed_at").alias("queued_at"),
        started.alias("started_at"),
        completed.alias("completed_at"),
        F.col("_state.status").alias("status"),
        _since_queued("_counted", F.col("_counted.total_files"), F.lit(0)).alias("total_files"),
        _since_queued("_counted", F.col("_counted.total_errors"), F.lit(0)).alias("total_errors"),
        _since_queued("_ended", F.col("_ended.error_message"), F.lit(None)).alias("error_message"),
    )
    zone_free = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("completed_at", "started_at")]
    seconds = (zone_free[0] - zone_free[1]) / F.lit(1_000_000.0)
    return state.withColumn("duration_seconds", F.when(seconds < 0, 0.0).otherwise(seconds))


def current_runs(ledger: DataFrame) -> DataFrame:
    """The state of every run."""
    return run_state(ledger.groupBy("root_path").agg(*ledger_aggregates()))


def files_of_current_runs(files: DataFrame, ledger: DataFrame, scanned_at: str) -> DataFrame:
    """Files recorded after the run of their root was last queued."""
    queued = (
        ledger.filter(F.col("status") == "queued")
        .groupBy("root_path")
        .agg(F.max("changed_at").alias("_queued_at"))
    )
    current = files.join(small_side(queued), "root_path", "left")
    alive = F.col("_queued_at").isNull() | (F.col(scanned_at) > F.col("_queued_at"))
    return current.filter(alive).drop("_queued_at")
