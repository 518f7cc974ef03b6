"""Golden cases of reading statistics, and properties of unions."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.operators import events as ev, intervals as iv, periods as pr

S = "book string, start long, end long, offset int"


def reading(i, book, start, end, session="s", at=None, **more):
    return {"id": i, "device": "d", "book": book, "at": at or end, "kind": {"Reading": {"start": start, "end": end, "offset": 0, "session": session, "from": 0.0, "to": 0.5} | more}}


def other(i, book, at, kind):
    return {"id": i, "device": "d", "book": book, "at": at, "kind": kind}


def decoded(spark, records):
    return ev.decode(spark.createDataFrame([(json.dumps(r),) for r in records], "json string"))


def duration(spark, records):
    rd = ev.readings(ev.visible(decoded(spark, records)))
    return rd, {r["book"]: r["ms"] for r in iv.covered(rd, "book").collect()}


def test_overlaps(spark):
    rows = [("a", 1000, 41000, 0), ("a", 21000, 61000, 0), ("b", 31000, 71000, 0)]
    df = spark.createDataFrame(rows, S)
    assert {r["book"]: r["ms"] for r in iv.covered(df, "book").collect()} == {"a": 60000, "b": 40000}
    assert iv.covered(df).first()["ms"] == 70000


def test_midnight(spark):
    m = int(dt.datetime(2026, 9, 8, 16, tzinfo=dt.timezone.utc).timestamp() * 1000)
    df = spark.createDataFrame([("a", m - 10000, m + 20000, 28800)], S)
    assert {str(r["day"]): r["ms"] for r in iv.daily(df, "book").collect()} == {"2026-09-08": 10000, "2026-09-09": 20000}
    ends = spark.createDataFrame([("a", m - 10000, m, 28800)], S)
    assert [str(r["day"]) for r in iv.daily(ends, "book").collect()] == ["2026-09-08"]


def test_sessions(spark):
    rd, ms = duration(spark, [reading("1", "a", 1000, 16000)])
    assert ms == {"a": 15000} and rd.where("qualified").count() == 0
    rd, ms = duration(spark, [reading("1", "a", 1000, 16000), reading("2", "a", 16000, 31000)])
    assert rd.where("qualified").count() == 2


def test_clear_and_reimport(spark):
    records = [reading("1", "a", 1000, 16000, at=10), other("2", "a", 20, {"Metadata": {"title": "T", "authors": "", "added": 5}}), other("3", "a", 30, "Clear"), reading("1", "a", 1000, 16000, at=10)]
    _, ms = duration(spark, records)
    assert ms == {}
    folded = ev.fold(ev.visible(decoded(spark, records))).first()
    assert folded["title"] == "T" and folded["status"] == "NotStarted"
    _, ms = duration(spark, [*records, reading("4", "a", 43000, 58000, at=43000)])
    assert ms == {"a": 15000}


def test_tied_status_and_added(spark):
    records = [other("a", "x", 1000, {"Status": {"status": "Reading", "finished": None}}), other("b", "x", 1000, {"Status": {"status": "Finished", "finished": "2026-09-01"}}),
               *[other(f"m{k}", "x", 2000 + k, {"Metadata": {"title": "T", "authors": "", "added": a}}) for k, a in enumerate((3, 0, 9, 7))]]
    row = ev.fold(decoded(spark, records)).first()
    assert (row["status"], row["finished"], row["added"]) == ("Finished", "2026-09-01", 7)


@pytest.mark.parametrize("record", [
    reading("", "a", 0, 1), reading("1" * 129, "a", 0, 1), reading("1", "a", 5, 4), reading("1", "a", 0, 60001), reading("1", "a", 0, 1, offset=86401), reading("1", "a", 0, 1, to=None),
    other("1", "a", -1, "Clear"), other("1", "a", 1, "Other"), other("1", "a", 1, {"Status": {"status": "Lost", "finished": None}}), other("1", "a", 1, {"Status": {"status": "Finished", "finished": "2026-2-3"}}),
    other("1", "a", 1, {"Metadata": {"title": "T", "authors": "A"}}), other("1", "a", 1, {"Clear": {}, "Status": {}})])
def test_invalid(spark, record):
    assert decoded(spark, [record]).first()["valid"] is False


def test_broken_json(spark):
    df = ev.decode(spark.createDataFrame([("{",), ("",), (None,), ("[]",)], "json string"))
    assert [r["valid"] for r in df.collect()] == [False] * 4


@pytest.mark.parametrize("period, today, first, last, n", [("week", "2026-01-01", "2025-12-29", "2026-01-04", 7), ("month", "2024-02-10", "2024-02-01", "2024-02-29", 29), ("month", "2025-02-10", "2025-02-01", "2025-02-28", 28), ("year", "2026-09-12", "2026-01-01", "2026-12-31", 12)])
def test_periods(spark, period, today, first, last, n):
    day = dt.date.fromisoformat(today)
    a, z = spark.range(1).select(*pr.bounds(period, F.lit(day).cast("date"))).first()
    daily = spark.createDataFrame([(day, 60)], "day date, ms long")
    bins = pr.distribution(daily, period, day).collect()
    assert (str(a), str(z), len(bins), sum(r["ms"] for r in bins)) == (first, last, n, 60)


def test_years(spark):
    daily = spark.createDataFrame([(dt.date(y, 5, 1), m) for y, m in ((2023, 60), (2025, 120), (2026, 420), (2027, 9))], "day date, ms long")
    bins = pr.distribution(daily, "all", dt.date(2026, 9, 12)).orderBy("bin").collect()
    assert [(r["bin"].year, r["ms"]) for r in bins] == [(2023, 60), (2024, 0), (2025, 120), (2026, 420)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2 * 10**8), st.integers(0, 60000)), max_size=12))
def test_union_agrees_with_points(spark, spans):
    rows = [("a", s, s + n, 3600) for s, n in spans]
    df = spark.createDataFrame(rows, S)
    want, reach = 0, 0
    for s, e in sorted((s, s + n) for s, n in spans):
        want += max(0, e - max(s, reach))
        reach = max(reach, e)
    got = iv.covered(df, "book").collect()
    parts = iv.union(df, "book")
    assert (got[0]["ms"] if got else 0) == want
    assert (iv.daily(df, "book").agg(F.sum("ms")).first()[0] or 0) == want
    again = iv.union(parts, "book").agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    assert again == want
