"""Tracked runs equal the batch result after restarts, with late and repeated changes, stalls and forgetting."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from folioscope.operators import runs
from folioscope.streaming import tracked_runs

START = dt.datetime(2024, 5, 1)


def changes(seed, n):
    rng = random.Random(seed)
    kinds = ["queued", "running", "progress", "progress", "completed", "failed", "unknown"]
    return [
        runs.change(f"/r{rng.randrange(6)}", START + dt.timedelta(seconds=rng.randrange(5_000)), i, rng.choice(kinds), rng.randrange(99),
                    rng.choice([None, 0, 3]), rng.choice([None, "x"])) for i in range(n)
    ]


def advance(spark, folder, rows, **settings):
    """Add files of changes and run the stream until it has read them."""
    for k in range(2):
        part = rows[k::2]
        spark.createDataFrame(part, runs.LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(runs.LEDGER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    tracked_runs.start_tracking(stream, f"{folder}/changes", f"{folder}/state", **settings).awaitTermination()


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_restarts_late_and_repeated_changes(spark, tmp_path):
    folder, seen = str(tmp_path), []
    rows = changes(1, 60)
    # Later parts hold changes that are older than what is known, and some that were there before.
    for part in (rows[20:], rows[:20] + rows[30:40]):
        seen += part
        advance(spark, folder, part)
        want = runs.current_runs(spark.createDataFrame(seen, runs.LEDGER_SCHEMA))
        got = tracked_runs.tracked_runs(spark, f"{folder}/changes")
        assert rows_of(got.drop("stalled")) == rows_of(want) and not got.filter("stalled").count()


def test_stalls_and_forgotten_runs(spark, tmp_path):
    folder = str(tmp_path)
    at = lambda s: START + dt.timedelta(seconds=s)
    first = [runs.change("/a", at(1), 1, "running"), runs.change("/b", at(2), 2, "queued"), runs.change("/b", at(3), 3, "running"),
             runs.change("/b", at(9), 4, "completed", 5)]
    advance(spark, folder, first, stale_ms=1, forget_ms=1)
    time.sleep(0.1)
    # Timers fire with the next batch: /a stands still, /b is forgotten; then both change again, /b by a late row.
    second = [runs.change("/c", at(20), 5, "failed", 0, 1, "x"), runs.change("/c", at(19), 6, "running")]
    advance(spark, folder, second, stale_ms=1, forget_ms=1)
    log = spark.read.parquet(f"{folder}/changes")
    assert log.filter("root_path = '/a' and stalled").count() and log.filter("root_path = '/b' and forgotten").count()
    assert {r.root_path for r in tracked_runs.tracked_runs(spark, f"{folder}/changes").filter("stalled").collect()} == {"/a"}
    third = [runs.change("/a", at(30), 7, "completed", 9), runs.change("/b", at(4), 8, "progress", 1)]
    advance(spark, folder, third, stale_ms=600_000, forget_ms=600_000)
    got = tracked_runs.tracked_runs(spark, f"{folder}/changes")
    want = runs.current_runs(spark.createDataFrame(first + second + third, runs.LEDGER_SCHEMA))
    assert rows_of(got.drop("stalled")) == rows_of(want)
    assert not got.filter("stalled").count() and got.filter("root_path = '/b'").select(F.col("total_files")).first()[0] == 5
