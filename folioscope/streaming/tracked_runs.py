"""Runs as keyed state with timers: what is known of every root's run, kept up to date event by event.

State is a map from the kind of a change (queued, started, counted, ended, last) to the newest
change of that kind, so late, repeated and disordered events give the same state as in order.
A run that stays queued or running without a change gets a timer; when it fires the run is
reported as stalled until its next change. Ended runs are forgotten after a while: every
report says what the state held, and the fold of all reports keeps the newest change of each
kind, so a change that comes after its run was forgotten is still counted right.

Each micro-batch's reports are written under its id (:func:`start_change_log`), and state and
timers live in the checkpoint, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.runs import run_state
from .scans import start_change_log

# Kinds of changes in the order of the columns; a status counts for all that list it.
KINDS = {
    "queued": ("queued",), "started": ("running",), "counted": ("progress", "completed", "failed"),
    "ended": ("completed", "failed"), "state": ("queued", "running", "completed", "failed"),
}
CHANGE = "changed_at bigint, seq bigint, status string, total_files bigint, total_errors bigint, error_message string"
FIELDS = [c.split()[0] for c in CHANGE.split(", ")]
WHOLE = {c.split()[0] for c in CHANGE.split(", ") if c.endswith(" bigint")}
NAMES = ["root_path", "stalled", "forgotten", *(f"{kind}_{column}" for kind in KINDS for column in FIELDS)]
REPORT = "root_path string, stalled boolean, forgotten boolean, " + ", ".join(
    f"{kind}_{column}" for kind in KINDS for column in CHANGE.split(", ")
)
STALE_MS, FORGET_MS = 6 * 3_600_000, 7 * 24 * 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunTracker(StatefulProcessor):
    """State of one root's run."""

    def __init__(self, stale_ms: int, forget_ms: int):
        self.stale_ms, self.forget_ms = stale_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", "kind string", CHANGE)

    def _held(self) -> dict[str, tuple]:
        return {key[0]: tuple(value) for key, value in self.newest.iterator()}

    def _report(self, root: str, held: dict[str, tuple], stalled: bool, forgotten: bool = False) -> pd.DataFrame:
        row = [root, stalled, forgotten]
        for kind in KINDS:
            row += held.get(kind, (None,) * len(FIELDS))
        # One block of plain values: a frame is made for every run, and typed columns would take most of its time.
        return pd.DataFrame([row], columns=NAMES, dtype=object)

    def _set_timer(self, held: dict[str, tuple], now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        status = held["state"][2] if "state" in held else "queued"
        self.handle.registerTimer(now + (self.stale_ms if status in ("queued", "running") else self.forget_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, changed = self._held(), set()
        for batch in rows:
            for change in zip(*(batch[c].tolist() for c in FIELDS)):
                plain = tuple(None if v is None or v != v else int(v) if c in WHOLE else v for c, v in zip(FIELDS, change))
                for kind, statuses in KINDS.items():
                    if plain[2] in statuses and (kind not in held or plain[:2] > held[kind][:2]):
                        held[kind] = plain
                        changed.add(kind)
        for kind in sorted(changed):
            self.newest.updateValue((kind,), held[kind])
        self._set_timer(held, timerValues.getCurrentProcessingTimeInMs())
        yield self._report(key[0], held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        status = held["state"][2] if "state" in held else "queued"
        if status in ("queued", "running"):
            yield self._report(key[0], held, True)
        else:
            self.newest.clear()
            yield self._report(key[0], held, False, True)

    def close(self) -> None:
        return None


def tracked(ledger: DataFrame, stale_ms: int = STALE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """Reports of a stream of ledger rows; a NULL root is a run of its own, unknown statuses change nothing."""
    ledger.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = ledger.withColumn("changed_at", F.unix_micros(F.col("changed_at").cast("timestamp"))).select("root_path", *FIELDS)
    return rows.groupBy("root_path").transformWithStateInPandas(
        statefulProcessor=RunTracker(stale_ms, forget_ms), outputStructType=REPORT, outputMode="Update", timeMode="ProcessingTime"
    )


def start_tracking(
    ledger: DataFrame, changes: str, checkpoint: str, available_now: bool = True,
    stale_ms: int = STALE_MS, forget_ms: int = FORGET_MS,
) -> StreamingQuery:
    """Track a stream of ledger rows; reports go to ``changes/batch_id=<n>``.

    A job that ends once all is read fires timers only with batches that have rows: batches
    without any would follow one another for as long as a timer is set.
    """
    ledger.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not available_now).lower())
    return start_change_log(tracked(ledger, stale_ms, forget_ms), changes, checkpoint, "update", available_now)


def tracked_runs(spark: SparkSession, changes: str) -> DataFrame:
    """Current runs from all reports, and whether their last report says that they stand still."""
    log = spark.read.parquet(changes)
    known = []
    for kind in KINDS:
        moment = F.struct(F.col(f"{kind}_changed_at"), F.col(f"{kind}_seq"))
        stamp = F.timestamp_micros(F.col(f"{kind}_changed_at")).cast("timestamp_ntz").alias("changed_at")
        fields = F.struct(stamp, *(F.col(f"{kind}_{c}").alias(c) for c in FIELDS[1:]))
        there = F.col(f"{kind}_seq").isNotNull()
        known.append(F.max_by(F.when(there, fields), F.when(there, moment)).alias(f"_{kind}"))
    folded = log.groupBy("root_path").agg(*known, F.max_by("stalled", "batch_id").alias("stalled"))
    return run_state(folded).join(folded.select("root_path", "stalled"), "root_path")
