"""Readings of more than a minute, as larger events tables hold them: the queries count them as their SQL does."""

import shutil

import pytest
from pyspark.sql import functions as F

from lectern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import TABLES, expected, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "events":
            (made / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value") + 601).otherwise(F.col("value")))
    events.coalesce(1).write.parquet(str(made / "parts"))
    shutil.copy(next((made / "parts").glob("*.parquet")), made / "events.parquet")
    return str(made)


@pytest.mark.parametrize("name", [
    "event_validation_counts", "clear_visible_events", "book_started_last", "daily_reading", "daily_reading_by_book", "distribution_all", "distribution_month", "distribution_week",
    "distribution_year", "longest_reading", "range_total", "reading_days", "reading_history"])
def test_long_readings_count(spark, folder, name):
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(expected(ORACLE_SQL[name], folder))
