"""Shelf, sets of ids, replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import replica as rp, shelf as sh
from lectern.plans.registry import query
from lectern.sources.tables import event_keys, table

BOOKS_SQL = "b AS (SELECT 'c' || c_custkey AS book, c_name AS title, CAST(1700000000000 + c_custkey * 1000 AS BIGINT) AS added FROM customer), a AS (SELECT 'c' || o_custkey AS book, CAST(max(epoch_us(o_orderdate) // 1000) AS BIGINT) AS activity FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)"


def books(spark, folder):
    return table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("book"), F.col("c_name").alias("title"), (F.lit(1700000000000) + F.col("c_custkey") * 1000).alias("added"))


def activity(spark, folder):
    o = table(spark, folder, "orders").where("o_orderkey % 2 = 0")
    return o.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("book")).agg(F.max(F.expr("unix_millis(cast(o_orderdate as timestamp))")).alias("activity"))


@query(f"WITH {BOOKS_SQL} SELECT book, title, added, coalesce(activity, 0) AS activity FROM b LEFT JOIN a USING (book)")
def shelf_order(spark, folder):
    return sh.shelf(books(spark, folder), activity(spark, folder)).select("book", "title", "added", "activity")


@query(f"WITH {BOOKS_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY greatest(coalesce(activity, 0), added) DESC, added DESC, book) AS n FROM b LEFT JOIN a USING (book)) SELECT n, book FROM s WHERE n <= 50")
def shelf_top(spark, folder):
    """The first 50 of the shelf with their places: a report of fixed length, numbered after the limit."""
    from pyspark.sql import Window as W

    top = sh.shelf(books(spark, folder), activity(spark, folder)).limit(50)
    order = W.orderBy(F.greatest("activity", "added").desc(), F.col("added").desc(), "book")
    return top.select(F.row_number().over(order).cast("long").alias("n"), "book")


@query(f"WITH {BOOKS_SQL} SELECT book, activity FROM b JOIN a USING (book) WHERE activity > 0 ORDER BY activity DESC, book DESC LIMIT 1")
def recent_book(spark, folder):
    return sh.most_recent(books(spark, folder), activity(spark, folder))


@query("SELECT c_custkey, lower(c_name) AS title FROM customer")
def library_by_title(spark, folder):
    return table(spark, folder, "customer").orderBy(F.lower("c_name")).select("c_custkey", F.lower("c_name").alias("title"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 7 <> 0")
def remote_minus_local(spark, folder):
    remote, local = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels")
    removed = remote.select("doc_id", (F.col("doc_id") % 7 != 0).alias("present"))
    return sh.remote_only(remote, local, removed, "doc_id")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT page_id FROM pages")
def reading_ids_union(spark, folder):
    return sh.known_ids(table(spark, folder, "documents"), table(spark, folder, "labels"), table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id"), key="doc_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 4 <> 0")
def pending_upload(spark, folder):
    local = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    published = local.where("doc_id % 4 = 0").select("doc_id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    return rp.pending(local, published, "doc_id").select("doc_id", "digest")


CLOCK_SQL = "r AS (SELECT 'b' || regexp_extract(props, '([0-9]+)', 1) AS book, user_id, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS wall, value FROM events)"


def progress_rows(spark, folder):
    e = event_keys(table(spark, folder, "events"))
    return e.select("book", F.col("ms").alias("wall"), F.col("event_id").alias("counter"), "device", "value")


@query(f"WITH {CLOCK_SQL} SELECT book, arg_max(value, {{'w': wall, 'c': event_id}}) AS value, arg_max(event_id, {{'w': wall, 'c': event_id}}) AS counter FROM r GROUP BY book")
def lww_progress(spark, folder):
    return rp.last_writer(progress_rows(spark, folder), "book").select("book", "value", "counter")


@query(f"WITH {CLOCK_SQL}, p AS (SELECT *, event_id % 2 AS side FROM r) SELECT book, arg_max(value, {{'w': wall, 'c': event_id}}) AS value FROM p GROUP BY book")
def progress_upsert(spark, folder):
    rows = progress_rows(spark, folder)
    local = rp.last_writer(rows.where("counter % 2 = 0"), "book")
    return rp.upsert(local, rows.where("counter % 2 = 1"), "book").select("book", "value")


@query("""WITH m AS (SELECT 'b' || regexp_extract(props, '([0-9]+)', 1) AS book, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS wall, event_type IN ('view', 'click') AS present FROM events),
c AS (SELECT book, arg_max(present, {'w': wall, 'c': event_id}) AS present, max({'w': wall, 'c': event_id}) AS k FROM m WHERE event_id % 2 = 0 GROUP BY book),
d AS (SELECT m.book, m.present, {'w': m.wall, 'c': m.event_id} AS k FROM m LEFT JOIN c USING (book) WHERE event_id % 2 = 1 AND (c.book IS NULL OR c.present <> m.present)),
u AS (SELECT book, present, k FROM c UNION ALL SELECT book, present, k FROM d) SELECT book, arg_max(present, k) AS present FROM u GROUP BY book""")
def membership(spark, folder):
    e = event_keys(table(spark, folder, "events")).select("book", F.col("event_type").isin("view", "click").alias("present"), F.col("ms").alias("wall"), F.col("event_id").alias("counter"), "device")
    current = rp.last_writer(e.where("counter % 2 = 0"), "book")
    return rp.set_membership(current, e.where("counter % 2 = 1")).select("book", "present")


@query("""WITH e AS (SELECT event_id, user_id % 5 AS d, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
v AS (SELECT event_id, k % 3 AS a1, k % 4 AS b1, d AS a2, k % 2 AS b2 FROM e)
SELECT event_id, CASE WHEN (a1 > a2 OR b1 > b2) AND (a1 < a2 OR b1 < b2) THEN 'concurrent' WHEN a1 > a2 OR b1 > b2 THEN 'after' WHEN a1 < a2 OR b1 < b2 THEN 'before' ELSE 'equal' END AS clock_order FROM v""")
def vector_clock_order(spark, folder):
    e = event_keys(table(spark, folder, "events"))
    n = lambda c: c.cast("long")
    left = F.create_map(F.lit("a"), n(F.col("k") % 3), F.lit("b"), n(F.col("k") % 4))
    right = F.create_map(F.lit("b"), n(F.col("k") % 2), F.lit("a"), n(F.col("user_id") % 5))
    return e.select("event_id", rp.compare_clocks(left, right).alias("clock_order"))


@query("""WITH e AS (SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS now, CAST(1705000000000 AS BIGINT) AS wall, CAST(event_id % 9 AS BIGINT) AS c FROM events)
SELECT event_id, greatest(now, wall) AS wall, CASE WHEN now > wall THEN 0 ELSE c + 1 END AS counter FROM e""")
def hybrid_ticks(spark, folder):
    e = event_keys(table(spark, folder, "events"))
    last = F.struct(F.lit(1705000000000).alias("wall"), (F.col("event_id") % 9).alias("counter"))
    return e.select("event_id", rp.ticked(last, F.col("ms")).alias("t")).select("event_id", "t.wall", "t.counter")


@query()
def annotation_merge(spark, folder):
    """Versions of annotations made from events: causal replacement, conflict copies."""
    e = event_keys(table(spark, folder, "events"))
    rows = e.select(F.concat("book", F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("id"),
                    F.create_map("device", (F.col("event_id") % 6).cast("long"), F.lit("base"), F.col("k").cast("long")).alias("clock"), F.col("ms").alias("wall"),
                    F.col("event_id").alias("counter"), "device", (F.col("event_type") == "error").alias("deleted"), F.lit(None).cast("string").alias("conflict_of"), F.col("props").alias("payload"))
    return rp.merge_annotations(rows)


@query("WITH t AS (SELECT *, sum(n_chars) OVER w AS s, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT source, doc_id FROM t WHERE s <= 60000 AND n <= 20")
def cache_survivors(spark, folder):
    d = table(spark, folder, "documents").select("source", F.col("doc_id").alias("used"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("id"))
    return sh.kept_within(d, 60_000, 20, "source").select("source", F.col("id").alias("doc_id"))


@query("SELECT DISTINCT lower(p_type) AS model FROM part")
def model_list(spark, folder):
    return table(spark, folder, "part").select(F.lower("p_type").alias("model")).distinct().orderBy("model")
