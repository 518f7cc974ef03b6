"""Session settings of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere; adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    build = SparkSession.builder.master(master).appName("lectern").config(map=SETTINGS)
    session = build.config(map={
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
