"""Mixing sources to target weights with distributed prefix sums.

Every document gets a hash-random key of its id and text; rows with both alike are one entry
that stands for all of them, so no key holds many entries. Within each source entries are
dealt, in key order, to range buckets of bounded size; sums of the buckets, added up in order,
give each bucket its offset and a running sum inside the bucket gives each entry its place.
The source's budget is cut exactly: whole epochs first, then documents in key order, the one
at the edge in part.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its
own, last in order; equal rows are taken one after the other and differ in nothing else; a
source of size 0 has target 0; an empty table gives no rows; extra columns are ignored by
`mix` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.llm.common import stored

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (3, 1, 2)
#: Words to take over all, as a share of all words.
SHARE = 1.5
#: A source gives at most this many times its own words.
MOST = 2.0
#: Entries that share a range of keys, on average.
BUCKET_ROWS = 2_000


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (one row per source: source, source_size, rows) with target: sizes share out by weight, and what a
    source cannot give is shared by the others until nobody is above its limit.

    Sorted by limit per unit of weight, the sources at their limit come first; the others
    share what is left. The windows run over one row per source, not over documents.
    """
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, n) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    df = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST).withColumn("ratio", F.col("limit") / F.col("weight"))
    df = df.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left") / F.col("weights"))
    shared = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    df = df.withColumn("shared", shared)
    return df.withColumn("target", F.when(F.col("shared").isNull() | (F.col("ratio") < F.col("shared")), F.col("limit")).otherwise(F.col("shared") * F.col("weight")))


def entry_key(id_: Column, text: Column) -> Column:
    """Hash-random key of a document."""
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def shares(documents: DataFrame, id_col: str, text_col: str, source_col: str, bucket_rows: int) -> DataFrame:
    """Entries: doc_id, source, size, key, n (rows), source_size, target, epochs (whole ones), cut (words of the budget left when they begin)."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), entry_key(F.col(id_col), F.col(text_col)).alias("key"))
    docs = stored(docs.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n")), "mix-sizes")
    whole = F.col("size") * F.col("n")
    sources = targets(docs.groupBy("source").agg(F.sum(whole).alias("source_size"), F.count("*").alias("entries")))
    sources = stored(sources.select("source", "source_size", "target", "entries"), "mix-sources")
    same = docs["source"].eqNullSafe(sources["source"])
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = docs.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, same).select(
        docs["*"], "source_size", "target", F.floor(place * F.ceil(F.col("entries") / bucket_rows)).alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum(whole).alias("sum"))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("sum").over(W.partitionBy("source").orderBy("bucket")) - F.col("sum")).alias("offset"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("before", F.sum(whole).over(inside) - whole)
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    cut = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    return rows.select("doc_id", "source", "size", "key", "n", "source_size", "target", epochs.alias("epochs"), cut.alias("cut"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted), source."""
    rows = shares(documents, id_col, text_col, source_col, bucket_rows).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    mine = F.least(F.greatest(F.col("cut") - (F.col("nth") - 1) * F.col("size"), F.lit(0).cast("long")), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + mine).alias("taken"), "source")


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix as documents: each row as often as its words are taken, to the nearest whole copy (what lies at the edge
    of the budget stays whole if at least half of it is taken). Rows with id, text and source alike share their copies
    in turn. Documents without words go."""
    whole = F.col("size") * F.col("n")
    taken = F.col("epochs") * whole + F.least(F.greatest(F.col("cut"), F.lit(0).cast("long")), whole)
    named = lambda key, source: F.concat(key, F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")))  # noqa: E731  one column, so that the window finds the join's partitions
    part = shares(documents, id_col, text_col, source_col, bucket_rows).select(
        named(F.col("key"), F.col("source")).alias("_mix_key"), F.col("n").alias("_mix_rows"), F.floor(F.try_divide(taken, F.col("size")) + 0.5).alias("_mix_n")).where("_mix_n > 0")
    keys = documents.withColumn("_mix_of", named(entry_key(F.col(id_col), F.col(text_col)), F.col(source_col)))
    met = keys.join(part, F.col("_mix_of") == F.col("_mix_key"))
    nth = F.row_number().over(W.partitionBy("_mix_of").orderBy("_mix_rows"))
    times = met.withColumn("_mix_times", F.floor((F.col("_mix_n") + F.col("_mix_rows") - nth) / F.col("_mix_rows"))).where("_mix_times > 0")
    return times.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times")))).select(*[F.col(f"`{c}`") for c in documents.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, source_size * 2.0 AS cap, source_size * 2.0 / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, ratio) AS shared FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN shared IS NULL OR ratio < shared THEN cap ELSE shared * weight END AS target FROM l LEFT JOIN m ON true),
o AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM e
"""
