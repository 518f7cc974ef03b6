"""Places of rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.sources.shared import stored


def placed(rows: DataFrame, *order: Column, group: str | None = None, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in a total order, or in their group's part of it.

    Ranges of the order are sorted apart and written; the rows of the ranges before are added up, one number for each range. A
    group's first place is the smallest of its rows', so a group that fills many ranges is no task of its own. Null is a group.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + list(order)
    held = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_at", 33)
    sums = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = held.join(F.broadcast(sums), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")
    if group is None:
        return out
    first = out.groupBy(F.col(group).alias("_g")).agg(F.min(name).alias("_first"))
    return out.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_g", "_first")
