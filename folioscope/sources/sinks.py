"""Where results are written."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import fold_case
from ..operators.upsert import upsert


def write_features(df: DataFrame, folder: str, csv: bool = False) -> None:
    """Feature table as Parquet and, on request, as CSV beside it."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_split(df: DataFrame, folder: str, split: str = "split") -> None:
    """Train and test rows in one pass, one directory each."""
    df.write.mode("overwrite").partitionBy(split).parquet(folder)


def write_report(df: DataFrame, folder: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(folder)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """Catalog by root, ordered inside files so that their statistics prune.

    Rows go to as many tasks per root as Spark has; a large root is not forced
    into one file. ``subfolder_lc`` is stored for case-blind filters.
    """
    ready = df.withColumn("subfolder_lc", fold_case("subfolder"))
    order = [c for c in ("root_path", "extension", "subfolder") if c in ready.columns]
    ready.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("root_path").parquet(path)


def overwrite_root(scan: DataFrame, path: str, root: str) -> None:
    """Replace one root of a catalog; an empty scan empties it.

    Spark itself names the folder of the root, also for an empty scan, which
    takes it from the files that hold the root now.
    """
    spark = scan.sparkSession
    ready = scan.withColumn("subfolder_lc", fold_case("subfolder")).withColumn("root_path", F.lit(root))
    if ready.isEmpty():
        held = spark.read.parquet(path).filter(F.col("root_path") == root).select(F.input_file_name().alias("file"))
        folders = held.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().take(1)
        if folders:
            names = [c for c in ready.columns if c != "root_path"]
            folder = unquote(folders[0].folder)
            ready.select(*names).write.mode("overwrite").parquet(folder)
        return
    order = [c for c in ("extension", "subfolder") if c in ready.columns]
    (ready.sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("root_path").parquet(path))


def append_changes(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of changes under its id; writing it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def current_table(
    spark: SparkSession, changes: str, keys: list[str], seq: str,
    keep: list[str] = [], snapshot: DataFrame | None = None, schema=None,
) -> DataFrame:
    """State of a table: its snapshot with all changes since folded in.

    A later batch wins over an earlier one, and ``seq`` orders rows of a batch.
    Nothing is rewritten when a batch arrives; write the result out now and then
    as the next snapshot.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    log = reader.parquet(changes)
    order = F.struct(F.col("batch_id"), F.col(seq))
    ordered = log.withColumn("_order", order).drop("batch_id", seq)
    base = snapshot if snapshot is not None else ordered.drop("_order").limit(0)
    return upsert(base, ordered, keys, "_order", keep)
