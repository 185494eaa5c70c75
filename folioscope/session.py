"""Session set-up and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Most rows a lookup side may have before it is broadcast explicitly.
SMALL_SIDE_ROWS = 50_000


def get_session(app_name: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the library is tested with.

    ``conf`` uses double underscores for dots, as in
    ``spark__sql__shuffle__partitions="64"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    defaults.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset,
    which is the case in local tests, a temporary folder is made and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="folioscope-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs nothing."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out an input that has fewer splits than there are cores.

    One file with heavy text work would keep a single core busy. An input with
    enough splits, as any large one has, is returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def gathered(df: DataFrame, rows: int, task_rows: int) -> DataFrame:
    """Put a known number of rows into no more tasks than they fill; a large input is returned untouched."""
    tasks = max(1, -(-rows // task_rows))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


def evenly(df: DataFrame, rows: int, task_rows: int) -> DataFrame:
    """Like :func:`gathered`, and a large input is dealt out so that no task gets more than about ``task_rows``."""
    tasks = max(1, -(-rows // task_rows))
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else gathered(df, rows, task_rows)


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven to have at most ``max_rows`` rows.

    The proof fetches no more than ``max_rows + 1`` rows, and those rows become
    the broadcast table, so the aggregate behind them runs once. A larger side
    is returned untouched and joined by shuffle, where AQE splits hot keys.
    """
    from pyspark.sql import functions as F

    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, schema=df.schema))


def small_keys(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame | None:
    """The rows of ``df`` as a broadcast table, None when there are more than ``max_rows``.

    Rows are taken split by split, so a large input is left after its first
    splits and only a small one is read to its end.
    """
    from pyspark.sql import functions as F

    taken = df.take(max_rows + 1)
    if len(taken) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(taken, df.schema))
