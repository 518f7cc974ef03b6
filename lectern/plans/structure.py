"""Order inside sections, and functions of style and offsets; turns, parts and events stand in for blocks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lectern.functions import text as tx
from lectern.operators import batching as bt, focus as fc, json_links as jl, language as lg, periods as pr, proposals as pp, replica as rp, shelf as sh, structure as sr, toc as tc
from lectern.plans.reading import ALL_DAYS, TODAY, read
from lectern.operators import intervals as iv
from lectern.plans.registry import query
from lectern.plans.text import NODES_SQL, nodes
from lectern.sources.tables import event_keys, table


@query("""WITH b AS (SELECT user_id, event_id, event_type = 'signup' OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS s, event_type IN ('view', 'click') AS content FROM events),
p AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM b), c AS (SELECT user_id, part, bool_or(content) AS some FROM p GROUP BY 1, 2),
k AS (SELECT p.user_id, p.event_id, s AND (p.part = 1 OR q.some) AS starts FROM p LEFT JOIN c q ON q.user_id = p.user_id AND q.part = p.part - 1)
SELECT user_id, event_id, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS unit FROM k""")
def reading_units(spark, folder):
    e = table(spark, folder, "events")
    return sr.reading_units(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type").isin("view", "click")).select("user_id", "event_id", "unit")


@query("""WITH b AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'signup' THEN 'caption' ELSE 'text' END AS kind FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS g, lag(kind) OVER w AS b4, lead(kind) OVER w AS af FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, kind = 'image' AND bool_or(coalesce(b4, '') = 'caption' OR coalesce(af, '') = 'caption') OVER (PARTITION BY user_id, kind, g) AS protected FROM r""")
def captioned_images(spark, folder):
    """Pictures that belong to a captioned run, and so are neither moved nor read as formulas."""
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "signup", "caption").otherwise("text")
    return sr.captioned_runs(table(spark, folder, "events").withColumn("kind", kind), "user_id", "event_id").select("user_id", "event_id", "protected")


@query("""WITH b AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'signup' THEN 'caption' ELSE 'text' END AS kind FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS g, lag(kind) OVER w AS b4, lead(kind) OVER w AS af FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, bool_or(coalesce(b4, '') = 'caption' OR coalesce(af, '') = 'caption') OVER (PARTITION BY user_id, kind, g) AS protected FROM r) SELECT user_id, event_id FROM p WHERE kind = 'image' AND NOT protected""")
def formula_images(spark, folder):
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "signup", "caption").otherwise("text")
    blocks = sr.captioned_runs(table(spark, folder, "events").withColumn("kind", kind), "user_id", "event_id")
    return blocks.where("kind = 'image' and not protected").select("user_id", "event_id")


@query("WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber) FILTER (l_partkey % 4 > 0)) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, ids = range(ids[1], ids[-1] + 1) AS contiguous FROM g WHERE ids IS NOT NULL")
def consecutive_ids(spark, folder):
    ids = table(spark, folder, "lineitem").where("l_partkey % 4 > 0").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return ids.select("l_orderkey", sr.contiguous(F.col("ids")).alias("contiguous"))


@query("""WITH d AS (SELECT l_orderkey, 's' || (l_partkey % 50) AS source, l_linenumber AS position FROM lineitem), g AS (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS grp, 's' || (l_partkey % 50) AS source FROM lineitem WHERE l_linenumber < 5
UNION SELECT l_orderkey, 9, 'none' FROM lineitem WHERE l_linenumber = 1), m AS (SELECT g.l_orderkey, grp, position FROM g LEFT JOIN d USING (l_orderkey, source))
SELECT l_orderkey, CAST(grp AS BIGINT) AS "group", min(position) AS first, max(position) AS last FROM m GROUP BY 1, 2 HAVING count(*) = count(position) AND count(position) = count(DISTINCT position) AND max(position) - min(position) + 1 = count(position)""")
def composed_groups(spark, folder):
    i = table(spark, folder, "lineitem")
    source = F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("source")
    displayed = i.select("l_orderkey", source, F.col("l_linenumber").alias("position"))
    groups = i.where("l_linenumber < 5").select("l_orderkey", (F.col("l_suppkey") % 2).cast("long").alias("group"), source).distinct()
    absent = i.where("l_linenumber = 1").select("l_orderkey", F.lit(9).cast("long").alias("group"), F.lit("none").alias("source"))
    return sr.composed_groups(groups.unionByName(absent), displayed, "l_orderkey")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT user_id, round(value / 8, 1) AS v FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v) AS n FROM v),
g AS (SELECT user_id, n, v, v AS head, 0 AS bin FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.v, CASE WHEN o.v - head > 4 THEN o.v ELSE head END, CASE WHEN o.v - head > 4 THEN bin + 1 ELSE bin END FROM g JOIN o ON o.user_id = g.user_id AND o.n = g.n + 1)
SELECT event_id, bin FROM events JOIN g ON g.user_id = events.user_id AND g.v = round(value / 8, 1)""")
def indent_bins(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", F.round(F.col("value") / 8, 1).alias("indent"))
    return sr.indent_bins(e, "user_id", "indent").select("event_id", "bin")


@query()
def list_depths(spark, folder):
    """Depth of the items of orders from their quantities as indents."""
    i = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("items"))
    depths = sr.list_depths(F.transform("items", lambda x: x["l_quantity"]))
    return i.select("l_orderkey", F.posexplode(depths).alias("at", "depth"))


HEAD_SQL = r"""b AS (SELECT conv_id, turn, text, lower(regexp_replace(text, '[\s:.\-\x{2010}-\x{2014}]', '', 'g')) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS spot FROM conversations),
h AS (SELECT conv_id, turn AS hint, key AS label, CASE WHEN turn % 2 = 0 THEN turn END AS anchor, spot FROM b),
m AS (SELECT h.conv_id, h.hint, b.turn FROM h JOIN b ON b.conv_id = h.conv_id AND b.key = h.label AND CASE WHEN h.anchor IS NOT NULL THEN abs(b.spot - h.spot) <= 1 ELSE b.spot < 8 END)"""


@query(f"WITH {HEAD_SQL} SELECT conv_id, min(turn) AS turn, hint FROM m GROUP BY conv_id, hint HAVING count(*) = 1")
def promoted_headings(spark, folder):
    c = table(spark, folder, "conversations")
    blocks = c.select("conv_id", F.col("turn").alias("ord"), "text")
    hints = c.select("conv_id", F.col("turn").alias("hint"), F.concat(F.lit(" : "), "text").alias("label"), F.lit(1).alias("level"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("anchor"))
    return sr.promoted_headings(blocks, hints, "conv_id").select("conv_id", F.col("ord").alias("turn"), "hint")


CASCADE_SQL = """el AS (SELECT p_partkey AS element, p_brand || p_partkey // 64 AS tag, 'i' || p_partkey AS id, ['c' || p_partkey // 8, string_split(p_type, ' ')[2]] AS classes FROM part),
ru AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_partkey // 64 END AS tag, CASE WHEN p_partkey % 5 = 0 THEN 'i' || (p_partkey + 1) END AS id,
 CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 OR p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN ['c' || p_partkey // 8] ELSE [] END AS classes, 'p' || (p_size % 3) AS property, 'v' || p_partkey AS value FROM part),
m AS (SELECT element, property, value, CASE WHEN ru.id IS NOT NULL THEN 100 ELSE 0 END + len(ru.classes) * 10 + CASE WHEN ru.tag IS NOT NULL THEN 1 ELSE 0 END AS s, ord FROM el, ru
 WHERE (ru.tag IS NULL OR ru.tag = el.tag) AND (ru.id IS NULL OR ru.id = el.id) AND list_has_all(el.classes, ru.classes))"""


@query(f"WITH {CASCADE_SQL} SELECT element, property, arg_max(value, {{'s': s, 'o': ord}}) AS value FROM m GROUP BY 1, 2")
def style_cascade(spark, folder):
    p = table(spark, folder, "part")
    word = lambda n: F.try_element_at(F.split("p_type", " "), F.lit(n))
    k = F.col("p_partkey")
    tag, own = F.concat("p_brand", F.floor(k / 64).cast("string")), F.concat(F.lit("c"), F.floor(k / 8).cast("string"))
    elements = p.select(k.alias("element"), tag.alias("tag"), F.concat(F.lit("i"), k.cast("string")).alias("id"), F.array(own, word(2)).alias("classes"))
    classes = F.when(((k % 3 == 0) & (k % 2 == 0)) | ((k % 3 > 0) & (k % 5 > 0)), F.array(own)).otherwise(F.array().cast("array<string>"))
    rules = p.select(F.when(k % 3 == 0, tag).alias("tag"), F.when(k % 5 == 0, F.concat(F.lit("i"), (k + 1).cast("string"))).alias("id"), classes.alias("classes"), k.alias("order"),
                                              F.concat(F.lit("p"), (F.col("p_size") % 3).cast("string")).alias("property"), F.concat(F.lit("v"), k.cast("string")).alias("value"))
    return sr.cascaded(elements, rules)


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 6)) AS a, list_sort(list(DISTINCT l_partkey % 6)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS missing, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS extra, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS both FROM g""")
def field_sets(spark, folder):
    """Fields that a record lacks, has too many, and has as it should."""
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 6)).alias("a"), F.sort_array(F.collect_set(F.col("l_partkey") % 6)).alias("b"))
    text = lambda c: F.array_join(F.sort_array(c).cast("array<string>"), ",")
    return g.select("l_orderkey", text(F.array_except("a", "b")).alias("missing"), text(F.array_except("b", "a")).alias("extra"), text(F.array_intersect("a", "b")).alias("both"))


EMOJI_SQL = "t AS (SELECT doc_id, replace(substr(text, 1, 60), 'e', '😀') AS t FROM documents)"


@query(f"""WITH {EMOJI_SQL}, c AS (SELECT doc_id, t, length(t) AS n, length(t) - length(replace(t, '😀', '')) AS wide, length(substr(t, 1, 7)) - length(replace(substr(t, 1, 7), '😀', '')) AS w7 FROM t)
SELECT doc_id, CASE WHEN n >= 7 THEN CAST(7 + w7 AS INTEGER) END AS units, CASE WHEN n >= 7 THEN 7 END AS back, CAST(n + wide + 1 AS INTEGER) AS offsets,
CAST(list_sum(flatten(list_transform(range(1, n + 1), lambda i: CASE WHEN t[i] = '😀' THEN [i - 1, i] ELSE [i] END))) AS BIGINT) AS total FROM c WHERE n > 0""")
def offset_maps(spark, folder):
    t = table(spark, folder, "documents").select("doc_id", F.replace(F.substring("text", 1, 60), F.lit("e"), F.lit("😀")).alias("t")).where("length(t) > 0")
    units, each = tx.utf16_offset(F.col("t"), F.lit(7)), tx.display_to_source(F.col("t"))
    return t.select("doc_id", units.alias("units"), tx.scalar_offset(F.col("t"), units).alias("back"), F.size(each).alias("offsets"), F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(html, '(?i)<!DOCTYPE[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&', '&amp;'), '&amp;amp;', '&amp;'), '&amp;(lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);', '&\1;', 'g') AS html FROM pages""")
def tolerant_markup(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.sanitized_xml(F.col("html")).alias("html"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'size' WHEN p_partkey % 7 = 0 THEN 'command' WHEN p_size % 40 > 32 THEN 'deep' WHEN p_size % 40 <> p_size % 37 THEN 'braces' END AS error FROM part""")
def formula_errors(spark, folder):
    k, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(F.repeat(F.lit("{"), (size % 40).cast("int")), F.when(k % 7 == 0, r"\input x").otherwise(r"\frac\{12"), F.repeat(F.lit("}"), (size % 37).cast("int")))
    return table(spark, folder, "part").select("p_partkey", tx.formula_error(F.when(k % 9 == 0, "  ").otherwise(body)).alias("error"))


@query("SELECT l_orderkey, l_linenumber, least(greatest((l_linenumber + l_discount * 10 - 2) / 5, 0.0), 1.0) AS total FROM lineitem")
def total_progression(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", tx.total_progression(F.col("l_linenumber"), F.col("l_discount") * 10 - 2, F.lit(5)).alias("total"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity - 20 AS d, CAST(l_suppkey % 30 AS DOUBLE) AS st, CAST(l_partkey % 40 AS DOUBLE) AS sh, l_linenumber % 3 AS gaps, l_linenumber = 7 AS last FROM lineitem),
r AS (SELECT *, CASE WHEN last AND d >= 0 THEN 0 WHEN d = 0 THEN 0 WHEN d < 0 THEN CASE WHEN sh > 0 THEN d / sh END WHEN st > 0 THEN CASE WHEN d / st <= 1 OR gaps = 0 THEN d / st ELSE 1 + (d - st) / gaps / 5.0 END WHEN gaps > 0 THEN 1 + d / gaps / 5.0 END AS ratio FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN ratio >= -1 THEN round(100 * pow(abs(ratio), 3), 4) END AS cost FROM r""")
def line_badness(spark, folder):
    i = table(spark, folder, "lineitem")
    n = F.col("l_linenumber")
    cost = tx.line_badness(F.col("l_quantity") - 20, (F.col("l_suppkey") % 30).cast("double"), (F.col("l_partkey") % 40).cast("double"), n % 3, F.lit(10.0), n == 7)
    return i.select("l_orderkey", "l_linenumber", F.round(cost["cost"], 4).alias("cost"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'figure/' || p_size WHEN 1 THEN 'table/' || p_size || '-2' WHEN 2 THEN 'figure/12' WHEN 3 THEN NULL WHEN 4 THEN 'figure/a.' || p_size || 'b' ELSE 'table/' || p_size END AS key,
p_partkey % 6 = 5 AS alone, p_partkey % 6 IN (0, 2) AS cites FROM part""")
def caption_keys(spark, folder):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (F.when(k == 0, F.concat(F.lit("Fig. "), size, F.lit(" shows it"))).when(k == 1, F.concat(F.lit(" 表"), size, F.lit("–2 说明"))).when(k == 2, F.lit("图十二 说明")).when(k == 3, F.lit("The table 5 stands inside"))
            .when(k == 4, F.concat(F.lit("Figures A."), size, F.lit("B and on"))).otherwise(F.concat(F.lit("Table "), size, F.lit(":"))))
    cited = (F.when(k == 0, F.concat(F.lit("(see Figs "), size, F.lit(", 3 and 4; Table 2)"))).when(k == 2, F.lit("（见图十二）")).when(k == 1, F.lit("(Fig. 1 shows it)")).when(k == 3, F.lit("Fig. 1")).when(k == 4, F.lit("(none)")).otherwise(F.lit("[table]")))
    return table(spark, folder, "part").select("p_partkey", lg.caption_key(text).alias("key"), tx.standalone_table_label(text).alias("alone"), lg.is_media_citation(cited).alias("cites"))


@query("""WITH e AS (SELECT user_id, CAST(floor(value / 50) AS BIGINT) AS section, event_id, event_type = 'signup' AS active FROM events), s AS (SELECT *, bool_or(active) OVER (PARTITION BY user_id, section) AS wanted FROM e)
SELECT user_id, event_id, active FROM s WHERE wanted""")
def demanded_batches(spark, folder):
    e = table(spark, folder, "events").withColumn("section", F.floor(F.col("value") / 50))
    return bt.demanded(e, "user_id", "section", "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "active")


@query("SELECT doc_id, CASE WHEN length(text) >= 25 THEN substr(text, 6, 20) END AS part FROM documents")
def text_slices(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.slice_of(F.col("text"), F.lit(5), F.lit(25)).alias("part"))


@query("""WITH c AS (SELECT conv_id, turn, role, text AS t, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'x' ELSE role END AS role, text FROM conversations)),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS g FROM c) SELECT conv_id, CAST(g AS INTEGER) AS run, string_agg(t, '' ORDER BY turn) AS text, min(role) AS style FROM g GROUP BY conv_id, g""")
def coalesced_runs(spark, folder):
    c = table(spark, folder, "conversations").withColumn("style", F.when(F.col("turn") % 3 == 0, "x").otherwise(F.col("role")))
    runs = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "style"))).alias("runs"))
    joined = tx.coalesced(F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["style"].alias("style"))))
    return runs.select("conv_id", F.posexplode(joined).alias("run", "r")).select("conv_id", "run", "r.text", "r.style")


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages")
def stripped_tags(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a b.fb2.zip' WHEN 1 THEN '\c.EPUB' ELSE '/d' END AS path FROM pages), b AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a b.fb2.zip' WHEN 1 THEN 'c.EPUB' ELSE 'd' END AS name FROM p)
SELECT page_id, name, CASE page_id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'c' ELSE 'd' END AS title FROM b""")
def path_titles(spark, folder):
    end = F.when(F.col("page_id") % 3 == 0, "/a b.fb2.zip").when(F.col("page_id") % 3 == 1, "\\c.EPUB").otherwise("/d")
    path = F.concat("url", end)
    return table(spark, folder, "pages").select("page_id", tx.base_name(path).alias("name"), tx.title_of_path(path).alias("title"))


@query(f"WITH {NODES_SQL} SELECT doc_id, ord, 'book://' || doc_id || '/' || node AS link FROM nodes")
def citation_links(spark, folder):
    return nodes(spark, folder).select("doc_id", "ord", tx.citation_link(F.col("doc_id"), F.col("node")).alias("link"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), w AS (SELECT day, CAST(date_trunc('week', day) AS DATE) AS a, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS z FROM d)
SELECT day, CASE WHEN year(a) = 2024 THEN strftime(a, '%m/%d') ELSE strftime(a, '%Y/%m/%d') END || ' – ' || CASE WHEN year(a) = year(z) THEN strftime(z, '%m/%d') ELSE strftime(z, '%Y/%m/%d') END AS week, strftime(day, '%Y/%m') AS month, strftime(day, '%Y') AS year, '' AS every FROM w""")
def range_labels(spark, folder):
    d = table(spark, folder, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    label = lambda p: pr.range_label(p, *pr.bounds(p, F.col("day")), F.lit(2024))
    return d.select("day", label("week").alias("week"), label("month").alias("month"), label("year").alias("year"), label("all").alias("every"))


@query(r"""WITH t AS (SELECT event_id, (event_id % 500) * 900000 AS ms, CASE WHEN event_id % 2 = 0 THEN 3600000 ELSE 60000 END AS unit FROM events)
SELECT event_id, CASE WHEN ms = 0 THEN '0' ELSE regexp_replace(printf('%.2f', ms / unit), '\.?0+$', '') || CASE WHEN unit = 3600000 THEN 'h' ELSE 'min' END END AS label FROM t""")
def tick_labels(spark, folder):
    ms = (F.col("event_id") % 500) * 900000
    return table(spark, folder, "events").select("event_id", pr.tick_label(ms, F.when(F.col("event_id") % 2 == 0, 7200000).otherwise(60000)).alias("label"))


@query("""SELECT p_partkey, 's' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_size END AS fragment, CAST(least(greatest(p_size % 9 + 1, 1), 6) AS INTEGER) AS level FROM part WHERE p_partkey % 5 > 0""")
def toc_heading_hints(spark, folder):
    k = F.col("p_partkey")
    href = F.when(k % 5 > 0, F.concat(F.lit("s"), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("#f"), F.col("p_size").cast("string"))).otherwise("")))
    rows = table(spark, folder, "part").select(k, F.col("p_name").alias("label"), href.alias("href"), (F.col("p_size") % 9).cast("int").alias("depth"))
    return tc.heading_hints(rows).select("p_partkey", "path", "fragment", "level")


@query("SELECT event_id, user_id % 4 + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1 END AS b FROM events")
def clock_advances(spark, folder):
    u = F.col("user_id")
    clocks = rp.advance(F.create_map(F.lit("a"), (u % 4).cast("long")), F.when(u % 3 == 0, "a").otherwise("b"))
    return table(spark, folder, "events").select("event_id", clocks.alias("c")).select("event_id", F.col("c")["a"].alias("a"), F.col("c")["b"].alias("b"))


@query("SELECT doc_id, doc_id % 3 = 0 AS book_id, doc_id % 3 = 1 AS uuid FROM documents")
def safe_ids(spark, folder):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.upper(F.substring(h, 17, 4)), F.substring(h, 21, 12))
    text = F.when(F.col("doc_id") % 3 == 0, h).when(F.col("doc_id") % 3 == 1, uuid).otherwise(F.concat(F.substring(h, 1, 63), F.lit("G")))
    return table(spark, folder, "documents").select("doc_id", tx.is_book_id(text).alias("book_id"), tx.is_uuid(text).alias("uuid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'derived' WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name ELSE 'file ' || c_custkey END AS title FROM customer")
def metadata_precedence(spark, folder):
    k = F.col("c_custkey")
    books = table(spark, folder, "customer").select("c_custkey", F.when(k % 5 == 0, " derived ").otherwise("  ").alias("derived_title"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("preferred_title"),
                                                    F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("package_title"), F.concat(F.lit("/books\\x/file "), k.cast("string"), F.lit(".fb2.zip")).alias("path"))
    return sh.metadata_choice(books).select("c_custkey", "title")


@query("SELECT p_partkey, array_to_string(CASE WHEN string_split(p_type, ' ')[1] = string_split(p_type, ' ')[2] THEN [string_split(p_type, ' ')[1]] ELSE string_split(p_type, ' ')[1:2] END, '|') AS authors FROM part")
def unique_authors(spark, folder):
    words = F.split("p_type", " ")
    raw = F.array(F.concat(F.lit(" "), words[0]), F.lit("  "), F.concat(F.try_element_at(words, F.lit(2)), F.lit(" ")), words[0])
    return table(spark, folder, "part").withColumn("raw", raw).select("p_partkey", F.array_join(sh.trimmed_distinct("raw"), "|").alias("authors"))


@query(f"{ALL_DAYS} SELECT CAST(coalesce(sum(ms) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'), 0) AS BIGINT) AS ms FROM t")
def range_total(spark, folder):
    first, last = pr.bounds("month", F.lit(TODAY).cast("date"))
    daily = iv.daily(read(spark, folder), "device").groupBy("day").agg(F.sum("ms").alias("ms"))
    return pr.total(daily, first, last)


@query("""WITH e AS (SELECT event_id, event_id % 3 AS a1, event_id % 4 AS b1, user_id % 5 AS a2, user_id % 2 AS b2 FROM events)
SELECT CASE WHEN (a1 > a2 OR b1 > b2) AND (a1 < a2 OR b1 < b2) THEN 'conflict' WHEN a1 > a2 OR b1 > b2 THEN 'sent' WHEN a1 < a2 OR b1 < b2 THEN 'received' ELSE 'same' END AS action, count(*) AS n FROM e GROUP BY 1""")
def merge_counters(spark, folder):
    """What a synchronisation did, counted by action."""
    n = lambda c: c.cast("long")
    left = F.create_map(F.lit("a"), n(F.col("event_id") % 3), F.lit("b"), n(F.col("event_id") % 4))
    right = F.create_map(F.lit("a"), n(F.col("user_id") % 5), F.lit("b"), n(F.col("user_id") % 2))
    return rp.merge_counts(table(spark, folder, "events"), left, right)


@query("SELECT page_id, page_id % 4 IN (0, 1) AS web FROM pages")
def web_addresses(spark, folder):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, F.lit("HTTP://a.b:80/x?y#z")).when(k == 2, F.lit("https://user@host/x")).otherwise(F.concat(F.lit("ftp:"), "url"))
    return table(spark, folder, "pages").select("page_id", tx.is_web_url(url).alias("web"))


@query(rf"""WITH {NODES_SQL}, t AS (SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN '— ' WHEN 1 THEN 'IV. ' ELSE '' END || substr(text, 1, 40) AS t FROM nodes)
SELECT doc_id, ord, length(t) < 160 AND NOT regexp_matches(t, '[.!?,;:。，；：！？]\s*$') AND regexp_matches(t, '(?i)^(?:chapter|part|section)?\s*[0-9ivxlc]+(?:\.[0-9]+)*[.)]?\s+\S') AS heading,
regexp_matches(t, '^\s*[—–-]{{1,2}}\s*\S') AND len(string_split_regex(t, '[\t-\r \x{{85}}\x{{A0}}]+')) <= 12 AS credit FROM t""")
def block_predicates(spark, folder):
    t = F.concat(F.when(F.col("ord") % 4 == 0, "— ").when(F.col("ord") % 4 == 1, "IV. ").otherwise(""), F.substring("text", 1, 40))
    return nodes(spark, folder).select("doc_id", "ord", lg.heading_candidate(t, F.lit(0.0)).alias("heading"), lg.credit_like(t).alias("credit"))


@query("SELECT doc_id, to_base64(encode(coalesce(text, ''))) AS encoded, coalesce(text, '') AS back FROM documents")
def base64_round_trip(spark, folder):
    encoded = F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "[\r\n]", "")
    return table(spark, folder, "documents").select("doc_id", encoded.alias("encoded"), F.unbase64(encoded).cast("string").alias("back"))


PARAGRAPHS = ("It goes on and", "It ends here.", "# Heading", "a hyphen-", "He said \"so.\"")


@query(f"""WITH RECURSIVE k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, (conv_id * 7 + turn * 3) % 5 AS a, (conv_id + turn) % 4 AS b FROM conversations),
l AS (SELECT *, {list(PARAGRAPHS)!r} AS w FROM k), p AS (SELECT conv_id, turn, n, CASE WHEN b = 0 THEN [w[a + 1]] ELSE [w[(a + b) % 5 + 1], w[a + 1]] END AS ps FROM l),
q AS (SELECT *, lead(ps[1]) OVER (PARTITION BY conv_id ORDER BY n) AS head, ps[-1] AS tail FROM p),
c AS (SELECT *, head IS NOT NULL AND NOT starts_with(head, '#') AND NOT starts_with(tail, '#') AND (tail = 'It goes on and' OR tail = 'a hyphen-' OR (tail IN ('It ends here.', 'He said "so."') AND head = 'a hyphen-')) AS can FROM q),
j AS (SELECT conv_id, turn, n, ps, head, tail, can, can AS joins, false AS lost FROM c WHERE n = 1
UNION ALL SELECT c.conv_id, c.turn, c.n, c.ps, c.head, c.tail, c.can, c.can AND NOT (len(c.ps) = 1 AND j.joins), j.joins FROM j JOIN c ON c.conv_id = j.conv_id AND c.n = j.n + 1),
o AS (SELECT *, CASE WHEN lost THEN ps[2:] ELSE ps END AS kept, CASE WHEN tail = 'a hyphen-' THEN 'a hyphen' || head WHEN tail = 'It goes on and' AND regexp_matches(head, '^[A-Za-z0-9]') THEN tail || ' ' || head ELSE tail || head END AS whole FROM j)
SELECT conv_id, turn, array_to_string(CASE WHEN joins THEN list_append(kept[1 : len(kept) - 1], whole) ELSE kept END, chr(10) || chr(10)) AS text FROM o""")
def joined_pages(spark, folder):
    """Paragraphs over page breaks; turns stand in for pages of one or two paragraphs."""
    c = table(spark, folder, "conversations")
    a, b = (F.col("conv_id") * 7 + F.col("turn") * 3) % 5, (F.col("conv_id") + F.col("turn")) % 4
    word = lambda n: F.element_at(F.array(*[F.lit(p) for p in PARAGRAPHS]), (n + 1).cast("int"))
    text = F.when(b == 0, F.concat(word(a), F.lit(" \n"))).otherwise(F.concat(word((a + b) % 5), F.lit("\n \n"), word(a)))
    return sr.joined_pages(c.select("conv_id", "turn", text.alias("text")), "conv_id", "turn").select("conv_id", "turn", "text")


@query("""WITH k AS (SELECT p_partkey AS id, p_name AS t FROM part)
SELECT id, unnest(range(6)) AS ord, unnest(['heading', 'paragraph', 'item', 'item', 'quote', 'code']) AS kind, unnest([CAST(1 + id % 6 AS INTEGER), NULL, NULL, NULL, NULL, NULL]) AS level,
unnest([t || ' & on', 'one ' || t || ' two', t || ' goes on', 'second', 'said ' || t, '# ' || t || chr(10) || '  - x']) AS text FROM k""")
def markdown_blocks(spark, folder):
    k, t = F.col("p_partkey"), F.col("p_name")
    text = F.concat(F.repeat(F.lit("#"), (1 + k % 6).cast("int")), F.lit(" "), t, F.lit(" & on ##\n\none "), t, F.lit("\n two\n\n- "), t, F.lit("\ngoes on\n2) second\n\n> said\n> "), t, F.lit("\n```py\n# "), t, F.lit("\n  - x\n```\n"))
    out = sr.markdown_blocks(table(spark, folder, "part").select(k.alias("id"), text.alias("text")), "id")
    return out.select("id", F.col("ord").cast("long").alias("ord"), "kind", "level", "text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_size % 4 > 0 THEN 'note' ELSE 'normal' END AS first, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN 'note' ELSE 'normal' END AS second FROM part")
def note_marks(spark, folder):
    """Links of parts that become note references; even parts have a section of notes."""
    k, size = F.col("p_partkey"), F.col("p_size")
    run = lambda text, scale, raised, target: F.struct(text.alias("text"), F.concat(F.lit(target), F.lit("#f"), k.cast("string")).alias("link"), scale.alias("scale"), raised.alias("raised"), F.lit("normal").alias("role"))
    runs = F.array(run(F.when(k % 3 > 0, F.concat(F.lit("["), (size % 90).cast("string"), F.lit("]"))).otherwise(F.lit("see here")), F.when(size % 4 > 0, 0.8).otherwise(1.0), F.lit(False), "notes"),
                   run(F.lit(" † "), F.lit(1.0), k % 5 == 0, "notes"))
    paths = F.when(k % 2 == 0, F.array(F.lit("notes"))).otherwise(F.array(F.lit("other")))
    marked = table(spark, folder, "part").select("p_partkey", sr.marked_references(runs, paths).alias("r"))
    return marked.select("p_partkey", F.col("r")[0]["role"].alias("first"), F.col("r")[1]["role"].alias("second"))


@query("SELECT p_partkey, unnest(['color', 'margin', 'font-family']) AS name, unnest(['#a' || p_size, CAST(p_size AS VARCHAR) || 'px', 'a:b, c']) AS value FROM part")
def style_declarations(spark, folder):
    n = F.col("p_size").cast("string")
    css = F.concat(F.lit("/* x: y; */ Color : #A"), n, F.lit(" !IMPORTANT;; nothing; margin:"), n, F.lit("PX; : z; empty: ; font-family: A:b, C; /* open: end"))
    return table(spark, folder, "part").select("p_partkey", F.explode(tx.declarations(css)).alias("d")).select("p_partkey", "d.name", "d.value")


@query("""SELECT event_id, '{"key":' || regexp_extract(props, '([0-9]+)', 1) || ',"in":[{"title":"a \\"t\\": k"}],"k2":1}' AS json FROM events""")
def renamed_keys(spark, folder):
    number = F.regexp_extract("props", "([0-9]+)", 1)
    json = F.concat(F.lit('{"k":'), number, F.lit(',"in":[{"t":"a \\"t\\": k"}],"k2":1}'))
    return table(spark, folder, "events").select("event_id", tx.renamed_keys(json, {"k": "key", "t": "title"}).alias("json"))


@query("SELECT user_id, event_type AS node, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2")
def annotations_by_node(spark, folder):
    """Annotations gathered by the text they belong to, in order."""
    e = table(spark, folder, "events").where("event_id % 3 = 0")
    g = e.groupBy("user_id", F.col("event_type").alias("node")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("event_id")).alias("ids"))
    return g.select("user_id", "node", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


LINKED_SQL = """p AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


@query(f"""WITH {LINKED_SQL}, l AS (SELECT event_id, unnest(range(4)) AS o, unnest(['https://a/' || k, 'http://b/' || user_id, 'https://a/' || k, 'http://c/' || event_type]) AS url, unnest(['k' || k, NULL, 'again', event_type]) AS title FROM p),
f AS (SELECT event_id, url, min(o) AS o, arg_min(coalesce(title, ''), o) AS title FROM l GROUP BY 1, 2)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS ord, url, nullif(title, '') AS title FROM f""")
def nested_links(spark, folder):
    """Addresses at several depths of JSON made from events, repeated ones once."""
    e = event_keys(table(spark, folder, "events"))
    k, user, kind = F.col("k").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    json = F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("https://a/"), k).alias("url"), F.concat(F.lit("k"), k).alias("title"))).alias("a"),
        F.struct(F.struct(F.concat(F.lit("http://b/"), user).alias("uri"), F.lit(7).alias("name")).alias("x"), F.array(F.struct(F.concat(F.lit("https://a/"), k).alias("url"), F.lit("again").alias("title"))).alias("y")).alias("b"),
        F.concat(F.lit("http://c/"), kind).alias("url"), kind.alias("name"), F.lit("http://in.text/").alias("z")))
    return jl.links(e.select("event_id", json.alias("json")), "event_id").select("event_id", F.col("ord").cast("long").alias("ord"), "url", "title")


@query("""WITH s AS (SELECT conv_id AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, turn, trim(text) AS t, turn % 5 = 3 AS image FROM conversations),
b AS (SELECT *, lead(image) OVER w AS image2, lead(t) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY s ORDER BY ord)),
c AS (SELECT *, length(t2) BETWEEN 1 AND 300 AND len(regexp_split_to_array(t2, '\\s+')) <= 40 AND regexp_matches(t2, '\\p{L}') AND NOT regexp_matches(t2, '[?!？！]') AND NOT starts_with(lower(t2), 'someone') AND NOT starts_with(t2, '有人')
 AND (regexp_matches(t2, '^[—–\\-(（\\[【]') OR NOT (regexp_matches(t2, '["”’」』]$') OR regexp_matches(lower(t2), '^(i|we|he|she|they|nothing|this|that|it) '))) AS credit FROM b)
SELECT s, ord, CASE WHEN image2 IS NULL THEN 'no such block' WHEN image OR image2 THEN 'wrong blocks' WHEN NOT credit THEN 'no credit' END AS reason FROM c WHERE t <> ''""")
def proposal_reasons(spark, folder):
    """Quotes with the next turn as their credit, proposed for every turn; every fifth turn is a picture."""
    c = table(spark, folder, "conversations")
    ord_ = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("int")
    blocks = c.select(F.col("conv_id").alias("s"), ord_.alias("ord"), F.when(F.col("turn") % 5 == 3, "image").otherwise("paragraph").alias("kind"), "text", F.lit(None).cast("array<string>").alias("body"), F.lit(None).cast("boolean").alias("credited"))
    n = F.col("ord")
    json = F.concat(F.lit('{"kind":"quote","body":['), n.cast("string"), F.lit('],"attribution":'), (n + 1).cast("string"), F.lit(',"alignment":null}'))
    made = blocks.where(F.trim("text") != "").select("s", n.alias("nth"), json.alias("json"))
    return pp.checked(made, blocks, "s").select("s", F.col("nth").cast("long").alias("ord"), "reason")


@query("""WITH RECURSIVE c AS (SELECT conv_id AS s, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, ['heading', 'paragraph', 'item', 'item', 'image', 'caption', 'separator'][(conv_id * 3 + turn * 5 + turn // 3) % 7 + 1] AS kind, CAST(turn % 2 AS INTEGER) AS d, turn % 11 = 10 AS b FROM conversations),
g AS (SELECT s, -1 AS ord, CAST(NULL AS INTEGER) AS grp, false AS heads, CAST(NULL AS INTEGER) AS depth, '' AS kind, '' AS body, CAST(NULL AS INTEGER) AS mine FROM (SELECT DISTINCT s FROM c)
 UNION ALL SELECT s, ord, CASE WHEN apart THEN grp WHEN joins THEN grp ELSE ord END, CASE WHEN apart THEN heads WHEN joins THEN heads AND k = 'heading' ELSE k = 'heading' END, CASE WHEN apart THEN depth WHEN k = 'item' THEN coalesce(CASE WHEN joins THEN depth END, d) END,
  CASE WHEN apart THEN kind ELSE k END, CASE WHEN apart THEN body WHEN k <> 'image' THEN k WHEN joins THEN body ELSE '' END, CASE WHEN NOT apart THEN CASE WHEN joins THEN grp ELSE ord END END
 FROM (SELECT c.s, c.ord, c.kind AS k, c.d, c.kind = 'separator' AS apart, CASE WHEN NOT c.b THEN g.grp END AS grp, g.heads AND NOT c.b AS heads, CASE WHEN NOT c.b THEN g.depth END AS depth, CASE WHEN c.b THEN '' ELSE g.kind END AS kind, CASE WHEN c.b THEN '' ELSE g.body END AS body,
  NOT c.b AND g.grp IS NOT NULL AND (g.heads OR (c.kind = 'caption' AND g.kind = 'image') OR (c.kind = 'item' AND coalesce(c.d >= g.depth, false)) OR (c.kind = 'item' AND g.depth IS NULL AND g.body = 'paragraph')) AS joins FROM g JOIN c ON c.s = g.s AND c.ord = g.ord + 1))
SELECT s, ord, mine AS "group" FROM g WHERE mine IS NOT NULL""")
def focus_groups(spark, folder):
    """Turns of conversations as blocks of kinds by turn, and the groups in which they are read."""
    c = table(spark, folder, "conversations")
    kinds = F.array(*[F.lit(k) for k in ("heading", "paragraph", "item", "item", "image", "caption", "separator")])
    turn = F.col("turn")
    kind = F.element_at(kinds, ((F.col("conv_id") * 3 + turn * 5 + F.floor(turn / 3)) % 7 + 1).cast("int"))
    blocks = c.select(F.col("conv_id").alias("s"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("int").alias("ord"), kind.alias("kind"), F.concat(F.lit("n"), turn.cast("string")).alias("node"),
                      F.when(kind == "item", (turn % 2).cast("int")).alias("depth"), F.lit(None).cast("int").alias("list"), F.lit(False).alias("picture"), (turn % 11 == 10).alias("boundary"))
    return fc.focus_groups(blocks, "s")


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(value / 10) AS BIGINT) AS o, round(value / 500, 3) AS prog, event_type IN ('view', 'click') AS page FROM events),
p AS (SELECT DISTINCT user_id, o, prog, event_id AS page FROM e WHERE page), a AS (SELECT * FROM e WHERE NOT page),
m AS (SELECT a.event_id, p.page, row_number() OVER (PARTITION BY a.event_id ORDER BY p.o DESC, abs(p.prog - a.prog), p.page) AS n FROM a JOIN p ON p.user_id = a.user_id AND p.o <= a.o)
SELECT a.event_id, m.page FROM a LEFT JOIN m ON m.event_id = a.event_id AND n = 1""")
def anchor_pages(spark, folder):
    """Pages of anchors, ties by progression; views and clicks stand in for the beginnings of pages."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.lit("n").alias("node"), F.floor(F.col("value") / 10).alias("offset"), F.round(F.col("value") / 500, 3).alias("progression"), F.col("event_type").isin("view", "click").alias("_page"))
    pages = e.where("_page").select("user_id", "node", "offset", F.col("event_id").alias("page"), "progression")
    return tc.pages_of_anchors(e.where("not _page").drop("_page"), pages, "user_id").select("event_id", "page")


@query(r"""WITH r AS (SELECT conv_id, length(regexp_replace(text, '\s', '', 'g')) AS n, role = 'user' AS bold, turn % 3 = 0 AS italic, 1 + turn % 4 * 0.25 AS size FROM conversations)
SELECT conv_id, round(CASE WHEN sum(n) > 0 THEN sum(CASE WHEN bold THEN n ELSE 0 END) / sum(n) ELSE 0 END, 6) AS bold, round(CASE WHEN sum(n) > 0 THEN sum(CASE WHEN italic THEN n ELSE 0 END) / sum(n) ELSE 0 END, 6) AS italic,
round(CASE WHEN sum(n) > 0 THEN sum(n * size) / sum(n) ELSE 0 END, 6) AS size FROM r GROUP BY 1""")
def style_ratios(spark, folder):
    """Shares of bold and italic text and the mean size of sections; turns stand in for runs."""
    c = table(spark, folder, "conversations")
    runs = c.select("conv_id", "text", (F.col("role") == "user").alias("bold"), (F.col("turn") % 3 == 0).alias("italic"), (1 + F.col("turn") % 4 * 0.25).alias("size"))
    out = sr.style_ratios(runs, "conv_id")
    return out.select("conv_id", *[F.round(n, 6).alias(n) for n in ("bold", "italic", "size")])


@query("""WITH e AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN '{"kind":"' || CASE event_type WHEN 'view' THEN 'seen' ELSE event_type END || '","in":[{"title":' || k || ',"kind":"x"}]' || CASE WHEN event_id % 4 = 2 THEN ',"title":"t"' ELSE '' END || '}' END AS json FROM e""")
def renamed_fields(spark, folder):
    """Keys and values renamed at every depth; null where a new key meets its own name in an object."""
    e = event_keys(table(spark, folder, "events"))
    k, n = F.col("k").cast("string"), F.col("event_id") % 4
    inner = F.when(n == 1, F.concat(F.lit('{"t":'), k, F.lit(',"title":0,"kind":"x"}'))).otherwise(F.concat(F.lit('{"t":'), k, F.lit(',"kind":"x"}')))
    json = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","in":['), inner, F.lit("]"), F.when(n == 2, ',"title":"t"').otherwise(""), F.lit("}"))
    return e.select("event_id", tx.safely_renamed_keys(tx.renamed_values(json, "kind", {"view": "seen"}), {"t": "title"}).alias("json"))
