"""Calendar periods: ranges, dense bins, rankings, and the labels of charts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Tick steps in minutes, then factors of powers of ten hours.
STEPS = (1, 2, 5, 10, 15, 30, 60, 120, 180, 300, 600, 1200)
FACTORS = (1, 2, 5, 10)
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
PERIODS = ("week", "month", "year", "all")


def bounds(period: str, today: Column, offset: int | Column = 0) -> tuple[Column, Column]:
    """First and last day of the period that lies `offset` periods from today's; "all" has no first day."""
    n = F.lit(offset) if isinstance(offset, int) else offset
    if period == "all":
        return F.lit(None).cast("date"), today
    if period == "week":
        start = F.date_add(F.trunc(today, "week"), (n * 7).cast("int"))
        return start, F.date_add(start, 6)
    start = F.add_months(F.trunc(today, period), (n * (12 if period == "year" else 1)).cast("int"))
    return start, F.date_sub(F.add_months(start, 12 if period == "year" else 1), 1)


def within(day: Column, first: Column, last: Column) -> Column:
    """Inclusive range; no first day leaves the start open."""
    return (day <= last) & (first.isNull() | (day >= first))


def distribution(daily: DataFrame, period: str, today: dt.date, offset: int = 0, *keys: str) -> DataFrame:
    """Dense bins of daily totals (day, ms): days of a week or month, months of a year, years up to today.

    Columns bin (first day) and ms. The spine is built from the range; only years need the
    earliest day of the data.
    """
    day = F.lit(today).cast("date")
    first, last = bounds(period, day, offset)
    unit = {"week": "day", "month": "day", "year": "month", "all": "year"}[period]
    mine = daily.where(within(F.col("day"), first, last)).withColumn("bin", F.trunc("day", unit) if unit != "day" else F.col("day"))
    totals = mine.groupBy("bin").agg(F.sum("ms").alias("ms"))
    if period == "all":
        begin = totals.agg(F.coalesce(F.min("bin"), F.trunc(day, "year")).alias("first"))
        spine = begin.select(F.explode(F.sequence("first", F.trunc(day, "year"), F.expr("interval 1 year"))).alias("bin"))
    else:
        step = "interval 1 month" if period == "year" else "interval 1 day"
        spine = daily.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(step))).alias("bin"))
    return F.broadcast(spine).join(totals, "bin", "left").select("bin", F.coalesce("ms", F.lit(0)).cast("long").alias("ms"))


def total(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    return daily.agg(F.coalesce(F.sum(F.when(within(F.col("day"), first, last), F.col("ms"))), F.lit(0)).cast("long").alias("ms"))


def longest(daily_by_book: DataFrame, titles: DataFrame, first: Column, last: Column) -> DataFrame:
    """Books by time read in the range: duration descending, then title, then id; books without time go."""
    sums = daily_by_book.where(within(F.col("day"), first, last)).groupBy("book").agg(F.sum("ms").alias("ms")).where("ms > 0")
    return sums.join(titles.select("book", "title"), "book", "left").orderBy(F.col("ms").desc(), F.coalesce("title", F.lit("")), "book")


def tick_step(most_ms: Column) -> Column:
    """Distance of three chart ticks for a largest value, with 8 % headroom, in milliseconds."""
    minutes = most_ms / 60000 * 1.08 / 3
    hours = minutes / 60
    power = F.pow(F.lit(10.0), F.floor(F.log10(hours)))
    out = None
    for s in STEPS:
        out = out.when(minutes <= s, F.lit(s * 60000.0)) if out is not None else F.when(minutes <= s, F.lit(s * 60000.0))
    for f in FACTORS:
        out = out.when(power * f >= hours, power * f * 3600000)
    return out


def tick_label(ms: Column, step: Column) -> Column:
    """Hours or minutes with at most two decimals, trailing zeros dropped."""
    value = ms / F.when(step >= 3600000, 3600000).otherwise(60000)
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(ms == 0, "0").otherwise(F.concat(text, F.when(step >= 3600000, "h").otherwise("min")))


def duration_label(ms: Column) -> Column:
    minutes = F.floor(ms / 60000)
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min"))
    return F.when((ms > 0) & (ms < 60000), "<1 min").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def time_label(ms: Column) -> Column:
    """As duration_label, but whole hours go without minutes."""
    return F.regexp_replace(duration_label(ms), "^([0-9]+ h) 0 min$", "$1")


def axis_label(period: str, day: Column) -> Column:
    if period == "week":
        return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(day) + 1)
    if period == "month":
        return F.when((F.day(day) == 1) | (F.day(day) % 5 == 0), F.day(day).cast("string")).otherwise("")
    return (F.month(day) if period == "year" else F.year(day)).cast("string")


def range_label(period: str, first: Column, last: Column, this_year: Column) -> Column:
    short = lambda d: F.date_format(d, "MM/dd")
    full = lambda d: F.date_format(d, "yyyy/MM/dd")
    if period == "all":
        return F.lit("")
    if period == "month":
        return F.date_format(first, "yyyy/MM")
    if period == "year":
        return F.year(first).cast("string")
    left = F.when(F.year(first) == this_year, short(first)).otherwise(full(first))
    return F.concat(left, F.lit(" – "), F.when(F.year(first) == F.year(last), short(last)).otherwise(full(last)))
