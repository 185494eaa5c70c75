"""Streams of scanned files and of run states.

Every job writes what changed in a micro-batch under the id of the batch, so a
batch that is run again replaces its own output. The current table is the fold
of these changes (:func:`folioscope.sources.sinks.current_table`); a large table
is never rewritten because a small batch arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.fixed_values import SCAN_BATCH_FILES
from ..operators.runs import ledger_aggregates, run_state
from ..operators.upsert import latest
from ..sources.sinks import append_changes


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType,
    glob: str = "*.parquet", files_per_batch: int = SCAN_BATCH_FILES,
) -> DataFrame:
    """Stream of the Parquet files that appear in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def start_change_log(
    stream: DataFrame, changes: str, checkpoint: str, mode: str = "append", available_now: bool = True,
    interval: str = "1 second",
) -> StreamingQuery:
    """Write each micro-batch to ``changes/batch_id=<n>``."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: append_changes(batch, changes, number))
    )
    timed = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return timed.start()


def scan_progress(stream: DataFrame, run: str, path: str, at: str, seq: str, failed: str) -> DataFrame:
    """Running totals per run: files, errors and the last path seen."""
    return stream.groupBy(run).agg(
        F.count_if(~F.col(failed)).alias("total_files"),
        F.count_if(F.col(failed)).alias("total_errors"),
        F.max_by(path, F.struct(at, seq)).alias("last_path"),
    )


def run_states(ledger: DataFrame) -> DataFrame:
    """Streaming form of the current runs; finish it with :func:`finished_states`."""
    return ledger.groupBy("root_path").agg(*ledger_aggregates())


def finished_states(aggregated: DataFrame) -> DataFrame:
    return run_state(aggregated)


def activity(
    stream: DataFrame, at: str, by: Sequence[str], width: str = "1 hour", late_by: str | None = None
) -> DataFrame:
    """Scans and errors per time bucket.

    All rows count, however late, and the state keeps every bucket. ``late_by``
    bounds the state and leaves out rows that are later.

    A zone-free time column is made a timestamp first, as watermarks need one.
    """
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if late_by:
        timed = timed.withWatermark("_at", late_by)
    grouped = timed.groupBy(F.window("_at", width).alias("_window"), *by).agg(
        F.count(F.lit(1)).alias("changes")
    )
    return grouped.select(
        F.col("_window.start").alias("bucket_start"), F.col("_window.end").alias("bucket_end"), *by, "changes"
    )


def newest(spark: SparkSession, changes: str, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key of an update-mode job."""
    return latest(spark.read.parquet(changes), list(keys), "batch_id")


class ProgressReporter(StreamingQueryListener):
    """Calls ``report(batch_id, rows)`` after every micro-batch."""

    def __init__(self, report: Callable[[int, int], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        self.report(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        return None
