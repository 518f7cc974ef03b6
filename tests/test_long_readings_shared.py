"""The other queries that read the same events: readings of more than a minute count there, too."""

import pytest

from lectern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import expected, rows
from tests.test_long_readings import folder  # noqa: F401


@pytest.mark.parametrize("name", [
    "book_progress", "book_status", "month_shards", "period_overview", "qualified_sessions", "reading_union_all", "reading_union_by_book", "reading_union_by_device", "today_and_week"])
def test_long_readings_count_in_the_others(spark, folder, name):  # noqa: F811
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(expected(ORACLE_SQL[name], folder))
