"""Budgets over ordered items: prefixes, batches that reset, picks that skip, islands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

SECTION_BUDGET, TRANSLATION_BUDGET, GLOSSARY_BUDGET, GLOSSARY_MOST = 5000, 2000, 4000, 40


def newest_within(rows: DataFrame, key: str, order: str, size: Column, most_rows: int, budget: int) -> DataFrame:
    """The newest rows of each key, at most most_rows of them, as long as the sum of sizes stays within the budget."""
    line = W.partitionBy(key).orderBy(F.col(order).desc())
    df = rows.withColumns({"_n": F.row_number().over(line), "_sum": F.sum(size).over(line.rowsBetween(W.unboundedPreceding, 0))})
    return df.where((F.col("_n") <= most_rows) & (F.col("_sum") <= budget)).drop("_n", "_sum")


def greedy(items: DataFrame, key: str, order: str, size: str, budget: int, section: str | None = None) -> DataFrame:
    """items with batch: a number per key that rises when the next item would exceed the budget or a section begins.

    The first item of a batch is always taken. The rule depends on where the last batch
    began, so rows are partitioned and sorted by key and scanned once, group after group.
    """
    names = [key, order, size] + ([section] if section else [])
    out = items.select(*names).repartition(key).sortWithinPartitions(key, order)
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"key": object(), "section": None, "sum": 0, "batch": 0}
        for pdf in frames:
            batch = []
            parts = pdf[section] if section else [None] * len(pdf)
            for k, n, s in zip(pdf[key], pdf[size], parts, strict=True):
                if k != state["key"]:
                    state = {"key": k, "section": s, "sum": 0, "batch": 0}
                elif s != state["section"] or state["sum"] + n > budget:
                    state |= {"section": s, "sum": 0, "batch": state["batch"] + 1}
                state["sum"] += n
                batch.append(state["batch"])
            yield pdf.assign(batch=pd.Series(batch, index=pdf.index, dtype="int32"))

    return out.mapInPandas(scan, schema)


def pick_skipping(items: Column, size, budget: int, most: int) -> Column:
    """Items of an ordered array that fit: one that exceeds what is left is skipped, later smaller ones may follow."""
    kind = F.slice(items, 1, 0)
    start = F.struct(F.lit(budget).alias("left"), kind.alias("out"))

    def add(s: Column, x: Column) -> Column:
        fits = (size(x) <= s["left"]) & (F.size(s["out"]) < most)
        return F.struct(F.when(fits, s["left"] - size(x)).otherwise(s["left"]).alias("left"), F.when(fits, F.array_append(s["out"], x)).otherwise(s["out"]).alias("out"))

    return F.aggregate(items, start, add, lambda s: s["out"])


def sections(blocks: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """blocks with section: 0 for the first, one more at each block that starts one."""
    line = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    return blocks.withColumn("section", F.sum(F.when(starts & ~first, 1).otherwise(0)).over(line))


def islands(rows: DataFrame, key: str, order: str, member: Column) -> DataFrame:
    """rows with island: neighbouring rows that are all members share one, every other row is on its own."""
    line = W.partitionBy(key).orderBy(order)
    df = rows.withColumn("_in", F.coalesce(member, F.lit(False)))
    starts = ~(F.col("_in") & F.coalesce(F.lag("_in").over(line), F.lit(False)))
    return df.withColumn("_s", starts.cast("int")).withColumn("island", F.sum("_s").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_in", "_s")


def sequences(markers: DataFrame, key: str, order: str, value: str, least: int = 2) -> DataFrame:
    """Runs in which each value is one more than the one before: markers with run and run_size, shorter ones left out."""
    line = W.partitionBy(key).orderBy(order)
    df = markers.withColumn("_d", F.col(value) - F.lag(value).over(line)).withColumn("run", F.sum(F.when(F.col("_d") == 1, 0).otherwise(1)).over(line.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("run_size", F.count("*").over(W.partitionBy(key, "run"))).where(F.col("run_size") >= least).drop("_d")


def list_ordinals(items: DataFrame, key: str, order: str, start: str = "start", value: str = "value") -> DataFrame:
    """items with ordinal: explicit values restart the count, which otherwise goes on from the list's start."""
    line = W.partitionBy(key).orderBy(order)
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(line)
    df = items.withColumns({"_n": n, "_at": F.last(F.when(F.col(value).isNotNull(), n), ignorenulls=True).over(upto), "_v": F.last(value, ignorenulls=True).over(upto)})
    return df.withColumn("ordinal", F.coalesce(F.col("_v") + F.col("_n") - F.col("_at"), F.coalesce(start, F.lit(1)) + F.col("_n") - 1)).drop("_n", "_at", "_v")


def note_numbers(links: DataFrame, scope: str, order: str, target: str) -> DataFrame:
    """links with number: runs of one target in a row share it, numbers count up within the scope."""
    line = W.partitionBy(scope).orderBy(order)
    new = F.when(F.col(target).eqNullSafe(F.lag(target).over(line)), 0).otherwise(1)
    return links.withColumn("_new", new).withColumn("number", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def page_ranges(chapters: DataFrame, key: str, start: str, pages: str) -> DataFrame:
    """Chapters with end: the next one's start, or the number of pages."""
    return chapters.withColumn("end", F.lead(start).over(W.partitionBy(key).orderBy(start))).withColumn("end", F.coalesce("end", pages))


def region_flag(blocks: DataFrame, key: str, order: str, heading: Column, opens: Column) -> DataFrame:
    """blocks with in_region: from a heading that opens the region until the next heading."""
    line = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("in_region", F.coalesce(F.last(F.when(heading, opens), ignorenulls=True).over(line), F.lit(False)))


def nearest(rows: DataFrame, key: str, distance: Column, order: str, n: int = 8) -> DataFrame:
    """The n rows of each key nearest by distance, back in order."""
    line = W.partitionBy(key).orderBy(distance, order)
    return rows.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n).drop("_r").orderBy(key, order)


def demanded(batches: DataFrame, key: str, section: str, order: str, active: Column) -> DataFrame:
    """Batches of sections that hold an active one: active ones first, then the rest in order."""
    some = F.max(active.cast("int")).over(W.partitionBy(key, section)) == 1
    return batches.withColumns({"active": active, "_some": some}).where("_some").drop("_some").orderBy(key, F.col("active").desc(), order)
