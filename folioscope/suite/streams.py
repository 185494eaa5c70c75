"""Streaming jobs over the event table, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import table
from ..session import shared_dir
from ..sources.keyed_table import KeyedTable
from ..sources.sinks import current_table
from ..streaming import scans, tracked_runs
from .registry import query
from .run_ledger import COLUMNS, LEDGER_SQL, RUNS_SQL, SELECT, ledger_of


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream; the pattern matches a single file and a folder of part files."""
    schema = table(spark, sf_dir, "events").schema
    return scans.read_files(spark, f"{sf_dir}/events.parquet*", schema, "*.parquet", 1)


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> str:
    """Run a stream over all there is and give the folder of its changes."""
    folder = shared_dir(spark, "stream")
    scans.start_change_log(stream, f"{folder}/changes", f"{folder}/state", mode).awaitTermination()
    return f"{folder}/changes"


CHANGED_SQL = """with rows as (select user_id as run_id, concat('/srv/u', user_id, '/', event_type) as path, event_id as seq,
        case when event_id % 3 = 0 then null else ts end as modified_at,
        case when event_id % 4 = 0 then null else concat('user', event_id % 17) end as modified_by, event_type as subfolder
      from events)
    select run_id, path, max_by(subfolder, seq) as subfolder,
      max_by(modified_at, seq) filter (where modified_at is not null) as modified_at,
      max_by(modified_by, seq) filter (where modified_by is not null) as modified_by
    from rows group by run_id, path"""


def _changed_paths(rows: DataFrame) -> DataFrame:
    """Events as changes of files, some without a time or an owner."""
    number = F.col("event_id")
    return rows.select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("/srv/u"), "user_id", F.lit("/"), "event_type").alias("path"),
        F.col("event_type").alias("subfolder"),
        F.when(number % 3 != 0, F.col("ts").cast("timestamp_ntz")).alias("modified_at"),
        F.when(number % 4 != 0, F.concat(F.lit("user"), number % 17)).alias("modified_by"),
        number.alias("seq"),
    )


@query("stream_upsert", CHANGED_SQL)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _run(spark, _changed_paths(_events(spark, sf_dir)), "append")
    return current_table(
        spark, changes, ["run_id", "path"], "seq", keep=["modified_at", "modified_by"]
    )


def _merged(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """The same changes appended in five batches to a table on storage, with a compaction on the way."""
    rows = _changed_paths(table(spark, sf_dir, "events"))
    fifths = rows.select(F.percentile("seq", [0.2, 0.4, 0.6, 0.8])).first()[0] or [0.0] * 4
    made = KeyedTable.create(
        rows.drop("seq").limit(0), shared_dir(spark, "keyed"), ["run_id", "path"], ["modified_at", "modified_by"], 2_000
    )
    for low, high in zip([float("-inf"), *fifths], [*fifths, float("inf")]):
        made.append(rows.filter((F.col("seq") > low) & (F.col("seq") <= high)), "seq", deltas=3)
    return made


@query("merged_table", CHANGED_SQL)
def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base files and the deltas that came after the last compaction, folded when read."""
    return _merged(spark, sf_dir).read()


@query("merged_lookup", f"select * from ({CHANGED_SQL}) where run_id % 50 = 0 and subfolder = 'click'")
def merged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some keys, from the files that may hold them."""
    asked = _changed_paths(table(spark, sf_dir, "events")).filter("run_id % 50 = 0 and subfolder = 'click'")
    return _merged(spark, sf_dir).lookup(asked)


@query(
    "stream_progress",
    f"""{LEDGER_SQL}, rows as (select *, concat(root_path, '/f', seq) as path from ledger)
    select root_path, count(*) filter (where status <> 'failed') as total_files,
      count(*) filter (where status = 'failed') as total_errors,
      arg_max(path, (changed_at, seq)) as last_path from rows group by root_path""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_of(_events(spark, sf_dir)).withColumns(
        {
            "path": F.concat("root_path", F.lit("/f"), "seq"),
            "failed": F.col("status") == "failed",
        }
    )
    totals = scans.scan_progress(rows, "root_path", "path", "changed_at", "seq", "failed")
    return scans.newest(spark, _run(spark, totals, "update"), ["root_path"])


@query("stream_state", f"{RUNS_SQL} select {SELECT} from runs")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = scans.run_states(ledger_of(_events(spark, sf_dir)))
    final = scans.newest(spark, _run(spark, states, "update"), ["root_path"])
    return scans.finished_states(final).select(*COLUMNS)


@query("stream_tracked_runs", f"{RUNS_SQL} select {SELECT}, false as stalled from runs")
def stream_tracked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs held as keyed state with timers; no run stands still for six hours while the query runs."""
    folder = shared_dir(spark, "stream")
    ledger = ledger_of(_events(spark, sf_dir))
    tracked_runs.start_tracking(ledger, f"{folder}/changes", f"{folder}/state").awaitTermination()
    return tracked_runs.tracked_runs(spark, f"{folder}/changes").select(*COLUMNS, "stalled")


@query(
    "stream_buckets",
    """select epoch(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'))::bigint as bucket_start,
      event_type, count(*) as changes from events group by 1, 2""",
)
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = scans.activity(_events(spark, sf_dir), "ts", ["event_type"], "6 hours")
    final = scans.newest(spark, _run(spark, buckets, "update"), ["bucket_start", "bucket_end", "event_type"])
    return final.select(F.unix_seconds("bucket_start").alias("bucket_start"), "event_type", "changes")
