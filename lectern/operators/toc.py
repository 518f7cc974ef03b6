"""Tables of contents as flat rows, and joins by position: as-of, nearest, first match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def levels(entries: DataFrame, depth: str = "depth") -> int:
    """Depths that can have rows below them: two at least, as greatest takes two columns."""
    return max(2, entries.agg(F.max(depth)).first()[0] or 0)


def parents(entries: DataFrame, key: str = "book", order: str = "ord", depth: str = "depth") -> DataFrame:
    """Rows in reading order with depths, plus parent: the order of the last earlier row of smaller depth (null at the top)."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    most = levels(entries, depth)
    last = [F.max(F.when(F.col(depth) == d, F.col(order))).over(before) for d in range(most)]
    above = [F.when(F.col(depth) > d, last[d]) for d in range(most)]
    return entries.withColumn("parent", F.greatest(*above))


def ancestors(entries: DataFrame, key: str = "book") -> DataFrame:
    """entries (key, ord, depth) with parent and ancestors, outermost first.

    The ancestor at each depth is the last earlier row of that depth that is not closed by
    a shallower one, so one window per depth is enough and no recursion runs.
    """
    df, most = parents(entries, key), levels(entries)
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    for d in range(most):
        df = df.withColumn(f"_a{d}", F.max(F.when(F.col("depth") == d, F.col("ord"))).over(before))
    out = []
    for d in range(most):
        shallower = [F.coalesce(F.col(f"_a{s}"), F.lit(-1)) for s in range(d)] + [F.lit(-1), F.lit(-1)]
        out.append(F.when((F.col("depth") > d) & (F.col(f"_a{d}") > F.greatest(*shallower)), F.col(f"_a{d}")))
    return df.withColumn("ancestors", F.array_compact(F.array(*out))).drop(*[f"_a{d}" for d in range(most)])


def visible(rows: DataFrame, expanded: Column) -> DataFrame:
    """Rows all of whose ancestors are in the array expanded."""
    return rows.where(F.forall("ancestors", lambda a: F.array_contains(expanded, a)))


def promoted(rows: DataFrame, key: str = "book") -> DataFrame:
    """A single root with children gives way to them: depths fall by one and the root goes."""
    roots = F.sum((F.col("depth") == 0).cast("int")).over(W.partitionBy(key))
    sole = (roots == 1) & (F.count("*").over(W.partitionBy(key)) > 1)
    return rows.withColumn("_sole", sole).where(~(F.col("_sole") & (F.col("depth") == 0))).withColumn("depth", F.when(F.col("_sole"), F.col("depth") - 1).otherwise(F.col("depth"))).drop("_sole")


def heading_hints(rows: DataFrame) -> DataFrame:
    """path, fragment, label and level (1 to 6) of entries that point somewhere."""
    return rows.where("href is not null").select("*", F.substring_index("href", "#", 1).alias("path"), F.nullif(F.regexp_extract("href", "#(.*)$", 1), F.lit("")).alias("fragment"),
                                                 F.least(F.greatest(F.col("depth") + 1, F.lit(1)), F.lit(6)).alias("level"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the right row's value at the greatest place not after its own; null if there is none.

    Both sides go into one ordered pass per key: a union and a window, instead of a join on a range.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    line = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True).over(line)["_value"]
    return both.withColumn(value, found).where("_side = 1").drop("_side", "_value")


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, value: str, reach: int = 12) -> DataFrame:
    """left (id, key, at) with the value of the right row nearest by place within the reach; ties to the earlier place.

    Places fall into buckets as wide as the reach, and only a bucket and its neighbours meet.
    """
    r = right.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(value)).withColumn("_bucket", F.floor(F.col("_at") / reach))
    each = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(at) / reach) + d for d in (-1, 0, 1)])))
    met = each.join(r.withColumnRenamed("_bucket", "_b"), (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(at) - F.col("_at")) <= reach))
    best = met.groupBy(*left.columns).agg(F.min_by(value, F.struct(F.abs(F.col(at) - F.col("_at")), F.col("_at"))).alias(value))
    return left.join(best, left.columns, "left")


def first_match(left: DataFrame, right: DataFrame, on: str, order: str, value: str) -> DataFrame:
    """left with the value of the first right row of equal key."""
    first = right.groupBy(on).agg(F.min_by(value, order).alias(value))
    return left.join(first, on, "left")


def with_fallback(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """left with the right value by the first of its keys that is found."""
    df, found = left, []
    for n, k in enumerate(keys):
        df = df.join(right.select(F.col("key").alias(f"_k{n}"), F.col(value).alias(f"_v{n}")), F.col(k) == F.col(f"_k{n}"), "left")
        found.append(F.col(f"_v{n}"))
    return df.withColumn(value, F.coalesce(*found)).drop(*[f"_{c}{n}" for n in range(len(keys)) for c in "kv"])


def unique_only(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur once."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n = 1").drop("_n")


def reciprocal(links: DataFrame) -> DataFrame:
    """Pairs of links (scope, ord, own, target, marker) that point at each other with equal marks: reference before note."""
    a, b = links.alias("a"), links.alias("b")
    on = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.own") == F.col("b.target")) & (F.col("a.target") == F.col("b.own")) & (F.col("a.marker") == F.col("b.marker")) & (F.col("a.ord") < F.col("b.ord"))
    return a.join(b, on).select("a.scope", F.col("a.ord").alias("reference"), F.col("b.ord").alias("note"), "a.marker")


def local_then_global(references: DataFrame, captions: DataFrame) -> DataFrame:
    """references (scope, key) with the captioned block: the only one of the scope, else the only one anywhere."""
    local = unique_only(captions, "scope", "key").select("scope", "key", F.col("block").alias("_local"))
    everywhere = unique_only(captions, "key").select("key", F.col("block").alias("_global"))
    return references.join(local, ["scope", "key"], "left").join(everywhere, "key", "left").withColumn("block", F.coalesce("_local", "_global")).drop("_local", "_global")


def without_overlaps(spans: DataFrame, key: str, protected: DataFrame | None = None) -> DataFrame:
    """Spans (start, end) that touch no protected one of their key; without those, spans that touch no other span.

    In order of start, a span overlaps an earlier one if it starts before the furthest end
    so far, and a later one if it ends after the next start: two windows replace the join
    of all pairs.
    """
    if protected is None:
        line = W.partitionBy(key).orderBy("start", "end")
        reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
        ahead = F.min("start").over(line.rowsBetween(1, W.unboundedFollowing))
        free = (reach.isNull() | (reach <= F.col("start"))) & (ahead.isNull() | (ahead >= F.col("end")))
        return spans.withColumn("_free", free).where("_free").drop("_free")
    both = spans.withColumn("_p", F.lit(0)).unionByName(protected.select(key, "start", "end").withColumn("_p", F.lit(1)), allowMissingColumns=True)
    line = W.partitionBy(key).orderBy("start", "_p")
    p = lambda c: F.when(F.col("_p") == 1, F.col(c))
    reach = F.max(p("end")).over(W.partitionBy(key).orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    ahead = F.min(p("start")).over(line.rowsBetween(0, W.unboundedFollowing))
    free = (reach.isNull() | (reach <= F.col("start"))) & (ahead.isNull() | (ahead >= F.col("end")))
    return both.withColumn("_free", free).where("_p = 0 and _free").drop("_p", "_free")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def pages_of_anchors(anchors: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """anchors (key, node, offset, progression, ...) with page: of the pages (key, node, offset, page, progression) that begin in
    the anchor's node at or before it, the last; of those that begin at one place, the one whose progression is nearest, then the
    smallest. Null where none does.

    One ordered pass per node finds the place, an equality join the pages there.
    """
    starts = pages.select(key, "node", "offset", F.lit(0).alias("_k")).distinct()
    both = starts.unionByName(anchors.select(key, "node", "offset", F.lit(1).alias("_k")).distinct())
    line = W.partitionBy(key, "node").orderBy("offset", "_k").rowsBetween(W.unboundedPreceding, 0)
    at = both.withColumn("_at", F.last(F.when(F.col("_k") == 0, F.col("offset")), ignorenulls=True).over(line)).where("_k = 1 and _at is not null").select(F.col(key).alias("_key"), F.col("node").alias("_node"), "_at", F.col("offset").alias("_o"))
    p = pages.select(key, "node", F.col("offset").alias("_at"), "page", F.col("progression").alias("_p"))
    # the progression travels with the place, so that equal anchors need no second key
    wanted = anchors.select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("offset").alias("_o"), F.coalesce("progression", F.lit(0.0)).alias("_want")).distinct()
    met = at.join(wanted, ["_key", "_node", "_o"]).join(p, (F.col("_key") == F.col(key)) & (F.col("_node") == F.col("node")) & (p["_at"] == at["_at"]))
    best = met.groupBy("_key", "_node", "_o", "_want").agg(F.min(F.struct(F.abs(F.col("_p") - F.col("_want")).alias("d"), "page"))["page"].alias("page"))
    out = anchors.withColumn("_w", F.coalesce("progression", F.lit(0.0)))
    return out.join(best, (F.col(key) == F.col("_key")) & (F.col("node") == F.col("_node")) & (F.col("offset") == F.col("_o")) & (F.col("_w") == F.col("_want")), "left").select(*anchors.columns, "page")
