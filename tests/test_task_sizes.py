"""Tasks grow in number with pages and rules, not in size; the rows stay those of the SQL."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import html_blocks as hb, structure as sr
from lectern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import expected, rows

SF = "/root/testdata/sf0.001"


def test_tokens_of_more_pages_take_more_tasks(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("<p>" + "word " * 500 + "</p>").alias("html"))
    assert hb.tokens(pages.union(pages)).rdd.getNumPartitions() == 8 and hb.tokens(pages.where("page_id < 400")).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["html_tables", "nested_tables", "html_notes", "style_cascade"])
def test_same_rows_over_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(hb, "TASK_CHARS", 2_000)
    monkeypatch.setattr(sr, "TASK_RULES", 40)
    got = QUERIES[name](spark, SF)
    assert rows(got.toPandas()) == rows(expected(ORACLE_SQL[name], SF))


@pytest.mark.parametrize("name", ["nested_tables", "style_cascade"])
def test_results_of_more_rows_come_from_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(hb, "TASK_CHARS", 2_000, raising=False)
    monkeypatch.setattr(sr, "TASK_RULES", 40, raising=False)
    # 200 parts give 25,000 characters of pages, or 400 elements and rules
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 10
