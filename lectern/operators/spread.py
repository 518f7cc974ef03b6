"""Rows dealt by key to a number of tasks that grows with them, so that what a task sorts and holds does not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def parts(df: DataFrame, weight: Column, most: int) -> int:
    """How many partitions hold about `most` of the sum of weight each; at least one for each core. One pass over df."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return max(math.ceil(total / most), df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, weight: Column, most: int, *keys: str) -> DataFrame:
    """df by hash of the keys in so many partitions; windows and groups of the keys, and of more columns, stay in them."""
    return df.repartition(parts(df, weight, most), *keys)
