"""Scan of a library's folder: only files that are new or changed are opened; what else is known comes from a table beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.sources.shared import removed, stored


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of the files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scanned(spark: SparkSession, folder: str, sidecar: str, read: Callable[[DataFrame], DataFrame], pattern: str = "*") -> DataFrame:
    """The library as read() gives it (path and columns of its own, at most a row for each file), with size and modified.

    read() gets the binaryFile rows of files whose path, size or time the sidecar does not have; rows of the others are taken
    over, those of files that are gone are left out. The new state is complete before the sidecar is replaced, so a run that breaks off
    leaves the old sidecar or none, never a wrong one. A file that read() gives no row for is known as having none; empty files
    are not listed.
    """
    now = listing(spark, folder, pattern)
    exists = spark._jvm.org.apache.hadoop.fs.Path(f"{sidecar}/_SUCCESS")
    known = spark.read.parquet(sidecar) if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists) else None
    if known is None:
        fresh = now
    else:
        fresh = now.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")
    fresh = stored(fresh, "scan-fresh")
    contents = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    opened = read(contents.join(fresh.select("path"), "path", "left_semi"))
    rows = fresh.join(opened, "path", "left")
    if known is not None:
        rows = now.join(known.drop("size", "modified").withColumnRenamed("path", "_p"), F.col("path") == F.col("_p")).drop("_p").join(fresh.select("path"), "path", "left_anti").unionByName(rows, allowMissingColumns=True)
    rows = stored(rows, "scan-rows")
    removed(spark, sidecar)
    rows.write.parquet(sidecar)
    return spark.read.parquet(sidecar)
