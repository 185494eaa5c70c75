"""Scan runs, with the event table read as a ledger of state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..operators.query import lookup, run_order
from ..operators.ranking import positioned
from ..plans.catalog import table
from .registry import query

STATUS_CASE = """case event_type when 'signup' then 'queued' when 'view' then 'running'
      when 'click' then 'progress' when 'purchase' then 'completed' else 'failed' end"""

LEDGER_SQL = f"""with ledger as (
      select concat('/srv/u', user_id) as root_path, ts as changed_at, event_id as seq,
             {STATUS_CASE} as status, cast(floor(value) as bigint) as total_files,
             event_id % 5 as total_errors,
             case when event_type = 'error' then concat('stat_error: ', props) end as error_message
      from events
    )"""


def _newest_sql(name: str, kinds: str) -> str:
    return f"""{name} as (select * from ledger where status in ({kinds})
      qualify row_number() over (partition by root_path order by changed_at desc, seq desc) = 1)"""


RUNS_SQL = f"""{LEDGER_SQL}, {_newest_sql('q', "'queued'")}, {_newest_sql('s', "'running'")},
    {_newest_sql('c', "'progress', 'completed', 'failed'")}, {_newest_sql('e', "'completed', 'failed'")},
    {_newest_sql('t', "'queued', 'running', 'completed', 'failed'")},
    roots as (select distinct root_path from ledger),
    runs as (
      select r.root_path, q.changed_at as queued_at, s2.changed_at as started_at, e2.changed_at as completed_at,
        t.status, coalesce(c2.total_files, 0) as total_files, coalesce(c2.total_errors, 0) as total_errors,
        e2.error_message,
        greatest((epoch_us(e2.changed_at) - epoch_us(s2.changed_at)) / 1000000.0::double, 0.0::double) as duration_seconds
      from roots r left join q using (root_path) left join t using (root_path)
      left join s s2 on s2.root_path = r.root_path and (q.seq is null or (s2.changed_at, s2.seq) > (q.changed_at, q.seq))
      left join c c2 on c2.root_path = r.root_path and (q.seq is null or (c2.changed_at, c2.seq) > (q.changed_at, q.seq))
      left join e e2 on e2.root_path = r.root_path and (q.seq is null or (e2.changed_at, e2.seq) > (q.changed_at, q.seq))
    )"""

COLUMNS = [
    "root_path", "queued_at", "started_at", "completed_at", "status", "total_files",
    "total_errors", "error_message", "duration_seconds",
]
# NULL when either time is missing; greatest() alone would hide it.
SELECT = ", ".join(COLUMNS[:-1]) + """,
      case when started_at is not null and completed_at is not null then duration_seconds end as duration_seconds"""


def ledger_of(events: DataFrame) -> DataFrame:
    """Event rows as ledger rows."""
    return events.select(
        F.concat(F.lit("/srv/u"), "user_id").alias("root_path"),
        F.col("ts").cast("timestamp_ntz").alias("changed_at"),
        F.col("event_id").alias("seq"),
        F.expr(STATUS_CASE).alias("status"),
        F.floor("value").cast("long").alias("total_files"),
        (F.col("event_id") % 5).alias("total_errors"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("stat_error: "), "props")).alias("error_message"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_of(table(spark, sf_dir, "events"))


@query("run_latest_state", f"{RUNS_SQL} select {SELECT} from runs")
def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.current_runs(ledger(spark, sf_dir)).select(*COLUMNS)


@query(
    "run_listing",
    f"""{RUNS_SQL} select root_path, status,
      row_number() over (order by case status when 'running' then 0 when 'queued' then 1 else 2 end,
        coalesce(completed_at, started_at, queued_at) desc nulls last, root_path) as place from runs""",
)
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = runs.current_runs(ledger(spark, sf_dir))
    return positioned(current, run_order(), "place").select("root_path", "status", "place")


@query("run_lookup", f"{RUNS_SQL} select {SELECT} from runs where root_path = '/srv/u7'")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(runs.current_runs(ledger(spark, sf_dir)), root_path="/srv/u7").select(*COLUMNS)


@query(
    "run_reset",
    f"""{LEDGER_SQL}, queued as (
      select root_path, max(changed_at) as queued_at from ledger where status = 'queued' group by 1),
    found as (select root_path, concat(root_path, '/f', seq) as path, changed_at as scanned_at
              from ledger where status = 'progress')
    select f.* from found f left join queued using (root_path)
    where queued_at is null or scanned_at > queued_at""",
)
def run_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = ledger(spark, sf_dir)
    found = changes.filter("status = 'progress'").select(
        "root_path",
        F.concat("root_path", F.lit("/f"), "seq").alias("path"),
        F.col("changed_at").alias("scanned_at"),
    )
    return runs.files_of_current_runs(found, changes, "scanned_at")
