"""Reading intervals: union and split by local day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def union(intervals: DataFrame, *keys: str) -> DataFrame:
    """Parts of each interval (start, end, offset) that earlier ones of the group do not cover, in order of
    (start, end, offset); a clipped part keeps its own offset.

    Groups stay whole here: give keys that bound them (or use `covered` for totals of large groups).
    """
    line = W.partitionBy(*keys).orderBy("start", "end", "offset").rowsBetween(W.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("end").over(line), F.lit(0)))
    return intervals.withColumn("_begin", begin).where("end > _begin").withColumn("start", F.col("_begin")).drop("_begin")


def covered(intervals: DataFrame, *keys: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """Milliseconds that the union of each group's intervals covers, column ms.

    Intervals are cut at multiples of bucket_ms first; unions of different buckets cannot
    overlap, so their lengths add up and no group is ordered as a whole.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("start") / bucket_ms), F.floor((F.greatest("end", F.col("start") + 1) - 1) / bucket_ms)))
    cut = intervals.where("end > start").withColumn("_bucket", bucket).withColumns({
        "start": F.greatest("start", F.col("_bucket") * bucket_ms), "end": F.least("end", (F.col("_bucket") + 1) * bucket_ms)})
    parts = union(cut, *keys, "_bucket").groupBy(*keys, "_bucket").agg(F.sum(F.col("end") - F.col("start")).alias("ms"))
    return parts.groupBy(*keys).agg(F.sum("ms").alias("ms"))


def by_local_day(parts: DataFrame) -> DataFrame:
    """Each part cut at the midnights of its own offset: adds day, sets start and end. An end at midnight opens no day."""
    local = lambda ms: F.floor((ms + F.col("offset") * 1000) / DAY_MS)
    df = parts.where("end > start").withColumn("_d", F.explode(F.sequence(local(F.col("start")), local(F.col("end") - 1))))
    begin = F.col("_d") * DAY_MS - F.col("offset") * 1000
    return df.withColumns({
        "start": F.greatest("start", begin).cast("long"), "end": F.least("end", begin + DAY_MS).cast("long"),
        "day": F.date_from_unix_date(F.col("_d").cast("int"))}).drop("_d")


def union_in_buckets(intervals: DataFrame, *keys: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """The parts that `union` gives, cut at multiples of bucket_ms: no group is ordered as a whole.

    Inside a bucket the intervals keep the order of their own start, end and offset, so each
    moment belongs to the same interval, and has the same offset, as without the cut.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("start") / bucket_ms), F.floor((F.col("end") - 1) / bucket_ms)))
    cut = intervals.where("end > start").withColumns({"_start": F.col("start"), "_end": F.col("end")}).withColumn("_bucket", bucket)
    cut = cut.withColumns({"start": F.greatest("start", F.col("_bucket") * bucket_ms), "end": F.least("end", (F.col("_bucket") + 1) * bucket_ms)})
    line = W.partitionBy(*keys, "_bucket").orderBy("_start", "_end", "offset").rowsBetween(W.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("end").over(line), F.lit(0)))
    return cut.withColumn("_begin", begin).where("end > _begin").withColumn("start", F.col("_begin")).drop("_begin", "_bucket", "_start", "_end")


def daily(intervals: DataFrame, *keys: str) -> DataFrame:
    """Milliseconds per group and local day of the union: keys, day, ms."""
    return by_local_day(union_in_buckets(intervals, *keys)).groupBy(*keys, "day").agg(F.sum(F.col("end") - F.col("start")).alias("ms"))
