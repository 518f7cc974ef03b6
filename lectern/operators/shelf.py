"""Library, progress and shelf: joins, set operations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def shelf(books: DataFrame, activity: DataFrame) -> DataFrame:
    """Books with their activity (0 if none), most recently used or added first, then added, then id."""
    df = books.join(activity, "book", "left").withColumn("activity", F.coalesce("activity", F.lit(0)))
    return df.orderBy(F.greatest("activity", "added").desc(), F.col("added").desc(), "book")


def most_recent(books: DataFrame, activity: DataFrame) -> DataFrame:
    """The one book read last, if any was read: book, activity."""
    df = books.join(activity.where("activity > 0"), "book")
    best = F.max(F.struct("activity", "book"))
    return df.agg(best.alias("b")).where("b is not null").select("b.book", "b.activity")


def remote_only(remote: DataFrame, local: DataFrame, removed: DataFrame, key: str = "book") -> DataFrame:
    """Remote records without a local copy that were not removed here (removed: key, present)."""
    gone = removed.where("present = false").select(key)
    return remote.join(local.select(key), key, "left_anti").join(gone, key, "left_anti")


def known_ids(*tables: DataFrame, key: str = "book") -> DataFrame:
    """Every id that occurs in any of the tables, once."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def metadata_choice(books: DataFrame) -> DataFrame:
    """Title and authors by precedence: derived, preferred, package, then the file's base name."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    base = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"(?i)(\.fb2\.zip|\.[A-Za-z0-9]+)$", "")
    return books.withColumn("title", F.coalesce(filled("derived_title"), filled("preferred_title"), filled("package_title"), base))


def trimmed_distinct(values: str):
    """Non-empty trimmed strings of an array, each once, first places kept."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def kept_within(entries: DataFrame, most_bytes: int, most_rows: int, *keys: str) -> DataFrame:
    """Newest entries (columns used, bytes, id) whose running size and number stay within limits: a cache's survivors."""
    line = W.partitionBy(*keys).orderBy(F.col("used").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    df = entries.withColumns({"_sum": F.sum("bytes").over(line), "_n": F.count("*").over(line)})
    return df.where((F.col("_sum") <= most_bytes) & (F.col("_n") <= most_rows)).drop("_sum", "_n")


def newest_version(releases: DataFrame, tag: str = "tag") -> DataFrame:
    """The release of the highest dotted version."""
    parts = F.transform(F.split(F.regexp_extract(tag, r"([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: x.cast("int"))
    return releases.agg(F.max_by(F.struct("*"), parts).alias("r")).select("r.*")
