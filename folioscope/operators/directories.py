"""Directories derived from a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder, parent_directory, relative_depth
from ..session import small_side


def directory_rollup(files: DataFrame, root: str = "root_path", path: str = "path") -> DataFrame:
    """One row per directory: parent, name, depth, own files and sub-directories.

    Files are counted per folder before any ancestor is produced, so the
    expansion is over distinct folders and not over files. Directories without
    any file below them are not in a file listing.
    """
    folders = files.groupBy(F.col(root).alias("root_path"), folder(path).alias("folder")).agg(
        F.count(F.lit(1)).alias("own")
    )
    levels = relative_depth("root_path", "folder")
    steps = F.split(F.col("folder"), "/")
    keep = F.sequence(F.size(steps) - levels, F.size(steps))
    lineage = folders.select(
        "root_path", "folder", "own", F.explode(keep).alias("length"), steps.alias("steps")
    ).select(
        "root_path",
        F.array_join(F.slice("steps", F.lit(1), F.col("length")), "/").alias("path"),
        F.when(F.col("length") == F.size("steps"), F.col("own")).otherwise(0).alias("own"),
    )
    directories = lineage.groupBy("root_path", "path").agg(F.sum("own").alias("num_files"))
    named = directories.withColumn("parent_path", parent_directory("root_path", "path"))
    children = (
        named.filter(F.col("parent_path").isNotNull())
        .groupBy("root_path", F.col("parent_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("num_subdirs"))
    )
    return named.join(children, ["root_path", "path"], "left").select(
        "root_path",
        "path",
        "parent_path",
        file_name("path").alias("name"),
        relative_depth("root_path", "path").alias("depth"),
        "num_files",
        F.coalesce("num_subdirs", F.lit(0)).alias("num_subdirs"),
    )


def files_with_directory(files: DataFrame, directories: DataFrame, columns: list[str]) -> DataFrame:
    """Files joined to the directory that holds them, with prefixed ``columns`` of it.

    A folder may hold a large share of all files. Few directories are broadcast;
    many are joined by shuffle, where AQE can split a large folder because
    directory rows are unique per key.
    """
    parents = directories.select(
        "root_path",
        F.col("path").alias("folder"),
        *[F.col(c).alias(f"dir_{c}") for c in columns],
    )
    return files.withColumn("folder", folder("path")).join(
        small_side(parents), ["root_path", "folder"]
    )
