"""HTML blocks, links, tables of contents, positional joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import html_blocks as hb, html_parts as hp, toc as tc
from lectern.operators.spread import spread
from lectern.plans.registry import query
from lectern.sources.shared import stored
from lectern.sources.tables import table


def pages(spark, folder):
    return table(spark, folder, "pages").withColumn("base", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1))


#: What remains of a page in DuckDB once skipped elements are gone, white space collapsed.
BODY_SQL = r"""b AS (SELECT page_id AS id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>|<nav\b[^>]*>.*?</nav\s*>', ' ', 'g') AS h FROM pages)"""


@query(rf"""WITH {BODY_SQL}, p AS (SELECT id, unnest(regexp_extract_all(h, '(?s)<h1>(.*?)</h1>', 1)) AS t FROM b)
SELECT id, trim(regexp_replace(replace(replace(t, '&quot;', chr(34)), '&amp;', '&'), '[\t\n\f\r ]+', ' ', 'g')) AS text FROM p WHERE trim(t) <> ''""")
def html_headings(spark, folder):
    return hb.blocks(pages(spark, folder)).where("kind = 'heading'").select("id", "text")


@query(rf"""WITH {BODY_SQL}, c AS (SELECT id, string_split_regex(h, '</?(?:address|article|aside|blockquote|body|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|legend|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>') AS parts FROM b),
u AS (SELECT id, unnest(parts) AS t FROM c), x AS (SELECT id, trim(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '[\t\n\f\r ]+', ' ', 'g')) AS t FROM u)
SELECT id, count(*) AS blocks FROM x WHERE t <> '' GROUP BY id""")
def html_block_counts(spark, folder):
    return hb.blocks(pages(spark, folder)).groupBy("id").agg(F.count("*").alias("blocks"))


BOUND = "</?(?:address|article|aside|blockquote|body|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|legend|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\\b[^>]*>"
COLLAPSE = "regexp_replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), '[\\t\\n\\f\\r ]+', ' ', 'g')"
#: Characters of a piece of markup as its tokens count: text between tags, each with white space collapsed, and one for each line break.
CHARS = "list_sum(list_transform(string_split_regex({0}, '(?s)<!--.*?-->|<[^>]*>'), lambda x: length(" + COLLAPSE.format("x") + "))) + len(regexp_extract_all({0}, '<br\\b[^>]*>'))"


@query(rf"""WITH {BODY_SQL}, c AS (SELECT id, list_concat([''], regexp_extract_all(lower(h), '{BOUND}')) AS tags, string_split_regex(h, '(?i){BOUND}') AS parts FROM b),
u AS (SELECT id, unnest(range(len(parts))) AS k, unnest(tags) AS tag, unnest(parts) AS part FROM c),
t AS (SELECT id, k, CASE WHEN tag LIKE '</%' THEN '' ELSE regexp_extract(tag, '^<([a-z0-9]+)', 1) END AS tag, part,
 regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(part, '<br\b[^>]*>', chr(1) || '<br>', 'g'), '(?s)<!--.*?-->|<[^>]*>'), lambda x: {COLLAPSE.format('x')}), ''), chr(1), chr(10), 'g'), ' +', ' ', 'g'), ' ?
 ?', chr(10), 'g') AS raw FROM u),
x AS (SELECT *, regexp_replace(raw, '^[ 
]+|[ 
]+$', '', 'g') AS text FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM x WHERE text <> '' OR tag = 'hr')
SELECT id, CAST(n - 1 AS INTEGER) AS ord, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'hr' THEN 'separator' WHEN tag IN ('li', 'dt', 'dd') THEN 'item' WHEN tag IN ('td', 'th', 'caption') THEN 'cell' WHEN tag = 'pre' THEN 'pre' WHEN tag = 'blockquote' THEN 'quote' ELSE 'paragraph' END AS kind,
CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(tag[2:2] AS INTEGER) END AS level, text, length(text) AS length, CAST(len(regexp_extract_all(part, '(?i)<a\b')) AS BIGINT) AS links,
round(coalesce(list_sum(list_transform(regexp_extract_all(part, '(?is)<(?:b|strong)\b[^>]*>(.*?)(?:</(?:b|strong)\s*>|\z)', 1), lambda y: {CHARS.format('y')})), 0) / greatest({CHARS.format('part')}, 1), 6) AS bold, 'n' || n AS node FROM n""")
def html_blocks(spark, folder):
    return hb.blocks(pages(spark, folder))


@query(r"WITH l AS (SELECT page_id AS id, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*[\x{22}\x{27}]([^\x{22}\x{27}]*)[\x{22}\x{27}]', 1) AS h FROM pages), u AS (SELECT id, unnest(h) AS href, unnest(range(len(h))) AS ord FROM l) SELECT id, CAST(ord AS INTEGER) AS ord, href, ltrim(href, '/') AS path FROM u")
def html_links(spark, folder):
    return hb.links(pages(spark, folder)).select("id", "ord", "href", "path")


@query(r"SELECT page_id AS id, replace(replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '&quot;', chr(34)), '&amp;', '&') AS title FROM pages")
def page_title_sniff(spark, folder):
    return hb.metadata(pages(spark, folder)).select("id", "title")


@query(rf"WITH {BODY_SQL}, p AS (SELECT id, h, strpos(h, '<p>') AS k FROM b WHERE contains(h, '<p>')) SELECT id, 'top' AS fragment, CAST(len(regexp_extract_all(substr(h, 1, k - 1), '(?i){BOUND}')) + 1 AS BIGINT) AS block FROM p")
def fragment_anchors(spark, folder):
    made = pages(spark, folder).withColumn("html", F.regexp_replace("html", "<p>", "<p id='top'>"))
    return hb.anchors(made)


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path,
nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, true AS web FROM pages""")
def url_parts(spark, folder):
    part = lambda name: F.try_parse_url("url", F.lit(name))
    return table(spark, folder, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("REF").alias("fragment"), tx.is_web_url(F.col("url")).alias("web"))


@query("""WITH r AS (SELECT p_partkey AS k, 'd' || (p_size % 5) AS d, 'f' || p_partkey AS f FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN 'O/img/' || f || ' y.png' WHEN 1 THEN 'O/' || d || '/a.xhtml' WHEN 2 THEN 'O/' || d || '/' || f || '.xhtml' WHEN 3 THEN 'root/' || f || '.html' ELSE 'O/' || d || '/bad%zz' || f END AS path,
CASE k % 5 WHEN 1 THEN f WHEN 2 THEN 'f+' || f END AS fragment FROM r""")
def href_resolve(spark, folder):
    k, f = F.col("p_partkey"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    base = F.concat(F.lit("O/d"), (F.col("p_size") % 5).cast("string"), F.lit("/a.xhtml"))
    href = (F.when(k % 5 == 0, F.concat(F.lit("../img/"), f, F.lit("%20y.png"))).when(k % 5 == 1, F.concat(F.lit("#"), f)).when(k % 5 == 2, F.concat(f, F.lit(".xhtml?q=1#f+"), f))
            .when(k % 5 == 3, F.concat(F.lit("/root/./x/../"), f, F.lit(".html"))).otherwise(F.concat(F.lit("bad%zz"), f)))
    df = table(spark, folder, "part").select(k.alias("k"), tx.resolved_href(base, href).alias("r"))
    return df.select("k", "r.path", F.nullif(F.col("r.fragment"), F.lit("")).alias("fragment"))


def toc_rows(spark, folder):
    """A contents tree from parts: brand, type within it, part within that."""
    p = table(spark, folder, "part")
    rows = [p.select("p_brand", F.lit("").alias("b"), F.lit(-1).cast("long").alias("c"), F.lit(0).alias("depth")).distinct(),
            p.select("p_brand", F.col("p_type").alias("b"), F.lit(-1).cast("long").alias("c"), F.lit(1).alias("depth")).distinct(),
            p.select("p_brand", F.col("p_type").alias("b"), F.col("p_partkey").alias("c"), F.lit(2).alias("depth"))]
    df = tc.union_all(rows)
    from pyspark.sql import Window as W

    return df.select(F.col("p_brand").alias("book"), F.row_number().over(W.partitionBy("p_brand").orderBy("b", "c")).alias("ord"), "depth",
                     F.when(F.col("depth") == 0, F.col("p_brand")).when(F.col("depth") == 1, F.col("b")).otherwise(F.col("c").cast("string")).alias("label"))


TOC_SQL = """r AS (SELECT DISTINCT p_brand AS book, '' AS b, -1 AS c, 0 AS depth FROM part UNION ALL SELECT DISTINCT p_brand, p_type, -1, 1 FROM part UNION ALL SELECT p_brand, p_type, p_partkey, 2 FROM part),
t AS (SELECT book, b, c, row_number() OVER (PARTITION BY book ORDER BY b, c) AS ord, depth FROM r),
pa AS (SELECT x.book, x.ord, x.depth, max(y.ord) AS parent FROM t x LEFT JOIN t y ON x.book = y.book AND y.ord < x.ord AND y.depth < x.depth GROUP BY 1, 2, 3)"""


@query(f"WITH {TOC_SQL} SELECT book, CAST(ord AS INTEGER) AS ord, CAST(depth AS INTEGER) AS depth, CAST(parent AS INTEGER) AS parent FROM pa")
def toc_parents(spark, folder):
    return tc.parents(toc_rows(spark, folder)).select("book", "ord", "depth", "parent")


@query(f"WITH {TOC_SQL} SELECT pa.book, CAST(pa.ord AS INTEGER) AS ord FROM pa LEFT JOIN pa AS up ON pa.book = up.book AND pa.parent = up.ord WHERE pa.depth = 0 OR pa.depth = 1 OR (pa.depth = 2 AND pa.parent % 2 = 0)")
def toc_visible(spark, folder):
    from pyspark.sql import Window as W

    rows = tc.ancestors(toc_rows(spark, folder))
    open_ = F.collect_set(F.when((F.col("depth") == 0) | (F.col("ord") % 2 == 0), F.col("ord"))).over(W.partitionBy("book"))
    return tc.visible(rows.withColumn("expanded", open_), F.col("expanded")).select("book", "ord")


@query(f"WITH {TOC_SQL} SELECT book, CAST(ord AS INTEGER) AS ord, CAST(depth - 1 AS INTEGER) AS depth FROM pa WHERE depth > 0")
def toc_promoted(spark, folder):
    return tc.promoted(toc_rows(spark, folder)).select("book", "ord", "depth")


ORDERS_SQL = "o AS (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, o_orderkey FROM orders)"


def order_days(spark, folder):
    return table(spark, folder, "orders").select("o_custkey", F.expr("cast(unix_date(cast(o_orderdate as date)) as bigint)").alias("day"), "o_orderkey")


@query(f"WITH {ORDERS_SQL}, m AS (SELECT o_custkey, day, max(o_orderkey) AS mark FROM o WHERE o_orderkey % 5 = 0 GROUP BY 1, 2), l AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0) SELECT l.o_orderkey, m.mark FROM l ASOF LEFT JOIN m ON l.o_custkey = m.o_custkey AND l.day >= m.day")
def active_toc_entry(spark, folder):
    """As-of join: the last marker of the same customer on or before the order's day."""
    o = order_days(spark, folder)
    marks = o.where("o_orderkey % 5 = 0").groupBy("o_custkey", "day").agg(F.max("o_orderkey").alias("mark"))
    return tc.as_of(o.where("o_orderkey % 5 <> 0"), marks, "o_custkey", "day", "mark").select("o_orderkey", "mark")


@query(f"""WITH {ORDERS_SQL}, l AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0), r AS (SELECT o_custkey AS k, day AS d, o_orderkey AS mark FROM o WHERE o_orderkey % 5 = 0),
n AS (SELECT l.o_orderkey, arg_min(mark, {{'x': abs(day - d), 'd': d, 'm': mark}}) AS mark FROM l JOIN r ON o_custkey = k AND abs(day - d) <= 12 GROUP BY 1) SELECT l.o_orderkey, n.mark FROM l LEFT JOIN n USING (o_orderkey)""")
def nearest_heading_page(spark, folder):
    o = order_days(spark, folder)
    marks = o.where("o_orderkey % 5 = 0").groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("mark"))
    return tc.nearest_within(o.where("o_orderkey % 5 <> 0"), marks, "o_custkey", "day", "mark", 12).select("o_orderkey", "mark")


@query("WITH l AS (SELECT DISTINCT l_partkey, 'Brand#' || (1 + l_partkey % 7) AS b FROM lineitem), f AS (SELECT p_brand, min(p_partkey) AS first_part FROM part GROUP BY 1) SELECT l_partkey, first_part FROM l LEFT JOIN f ON b = p_brand")
def toc_first_match(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", F.concat(F.lit("Brand#"), (1 + F.col("l_partkey") % 7).cast("string")).alias("p_brand")).distinct()
    return tc.first_match(lines, table(spark, folder, "part"), "p_brand", "p_partkey", "p_partkey").select("l_partkey", F.col("p_partkey").alias("first_part"))


@query("""WITH k AS (SELECT c_custkey, 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer), v AS (SELECT 'c' || (n_nationkey * 7) AS key, n_name AS name FROM nation UNION ALL SELECT 'n' || n_nationkey, 'by nation ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)
SELECT c_custkey, coalesce(x.name, y.name) AS name FROM k LEFT JOIN v x ON a = x.key LEFT JOIN v y ON b = y.key""")
def spine_alias(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"))
    n = table(spark, folder, "nation")
    v = n.select(F.concat(F.lit("c"), (F.col("n_nationkey") * 7).cast("string")).alias("key"), F.col("n_name").alias("name")).unionByName(
        n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("by nation "), F.col("n_nationkey").cast("string")).alias("name")))
    return tc.with_fallback(c, F.broadcast(v), ["a", "b"], "name").select("c_custkey", "name")


LINKS_SQL = "l AS (SELECT user_id AS scope, event_id AS ord, 'p' || (event_id % 40) AS own, 'p' || (CAST(floor(value * 100) AS BIGINT) % 40) AS target, CAST(event_id % 3 AS VARCHAR) AS marker FROM events)"


@query(f"WITH {LINKS_SQL} SELECT a.scope, a.ord AS reference, b.ord AS note, a.marker FROM l a JOIN l b ON a.scope = b.scope AND a.own = b.target AND a.target = b.own AND a.marker = b.marker AND a.ord < b.ord")
def footnote_pairs(spark, folder):
    e = table(spark, folder, "events")
    p = lambda c: F.concat(F.lit("p"), (c % 40).cast("string"))
    links = e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("ord"), p(F.col("event_id")).alias("own"), p(F.floor(F.col("value") * 100)).alias("target"), (F.col("event_id") % 3).cast("string").alias("marker"))
    return tc.reciprocal(links)


@query("""WITH c AS (SELECT user_id % 20 AS scope, CAST(floor(value) AS INTEGER) AS key, event_id AS block FROM events WHERE event_type = 'signup'), r AS (SELECT DISTINCT user_id % 20 AS scope, CAST(floor(value) AS INTEGER) AS key FROM events WHERE event_type = 'view'),
l AS (SELECT scope, key, min(block) AS block FROM c GROUP BY 1, 2 HAVING count(*) = 1), g AS (SELECT key, min(block) AS block FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT r.scope, r.key, coalesce(l.block, g.block) AS block FROM r LEFT JOIN l ON r.scope = l.scope AND r.key = l.key LEFT JOIN g ON r.key = g.key""")
def media_references(spark, folder):
    e = table(spark, folder, "events").select("event_type", (F.col("user_id") % 20).alias("scope"), F.floor("value").cast("int").alias("key"), F.col("event_id").alias("block"))
    return tc.local_then_global(e.where("event_type = 'view'").select("scope", "key").distinct(), e.where("event_type = 'signup'").select("scope", "key", "block"))


SPANS_SQL = "s AS (SELECT user_id, event_id, CAST(floor(value * 20) AS BIGINT) AS a, CAST(floor(value * 20) AS BIGINT) + 1 + event_id % 60 AS z FROM events WHERE event_type <> 'error'), p AS (SELECT user_id, CAST(floor(value * 20) AS BIGINT) AS a, CAST(floor(value * 20) AS BIGINT) + 80 AS z FROM events WHERE event_type = 'error')"


def event_spans(spark, folder):
    e = table(spark, folder, "events").withColumn("start", F.floor(F.col("value") * 20))
    return (e.where("event_type <> 'error'").select("user_id", "event_id", "start", (F.col("start") + 1 + F.col("event_id") % 60).alias("end")),
            e.where("event_type = 'error'").select("user_id", "start", (F.col("start") + 80).alias("end")))


@query(f"WITH {SPANS_SQL} SELECT user_id, event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND s.a < p.z AND p.a < s.z)")
def unprotected_proposals(spark, folder):
    spans, protected = event_spans(spark, folder)
    return tc.without_overlaps(spans, "user_id", protected).select("user_id", "event_id")


@query(f"WITH {SPANS_SQL} SELECT user_id, event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.event_id <> s.event_id AND s.a < t.z AND t.a < s.z)")
def lone_proposals(spark, folder):
    return tc.without_overlaps(event_spans(spark, folder)[0], "user_id").select("user_id", "event_id")


@query("WITH t AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) SELECT p_partkey FROM t WHERE n = 1")
def unique_owner(spark, folder):
    return tc.unique_only(table(spark, folder, "part"), "p_brand", "p_size").select("p_partkey")


def made_tables(spark, folder):
    """A table for each order: three rows that its lines fall into, cells that reach over others."""
    i = spread(table(spark, folder, "lineitem").where("l_orderkey % 4 = 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey"), F.lit(1), 300_000, "l_orderkey")
    n = lambda c: c.cast("string")
    tag = F.when(F.col("l_linenumber") % 5 == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(" rowspan="), n(1 + F.col("l_suppkey") % 3), F.lit(" colspan='"), n(1 + F.col("l_partkey") % 3), F.lit("'>q "), n(F.col("l_quantity").cast("int")), F.lit("<br>x &amp; y</"), tag, F.lit(">"))
    rows = i.groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("r")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", cell.alias("c")))), lambda x: x["c"]), "").alias("cells"))
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "cells"))), lambda x: F.concat(F.lit("<tr>"), x["cells"], F.lit("</tr>"))), "\n").alias("rows"))
    return body.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<p>before</p><table><caption>Table "), n(F.col("l_orderkey")), F.lit("</caption>"), "rows", F.lit("</table><p>after</p>")).alias("html"))


@query("""WITH RECURSIVE i AS (SELECT *, l_linenumber % 3 AS g, 1 + l_suppkey % 3 AS rs, 1 + l_partkey % 3 AS cs FROM lineitem WHERE l_orderkey % 4 = 0),
r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY g) - 1 AS INTEGER) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY g, l_linenumber, l_partkey, l_quantity, l_suppkey) AS n FROM i),
k AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey) + 1 AS rows FROM r),
p AS (SELECT l_orderkey, n, r, CAST(0 AS BIGINT) AS c, least(rs, rows - r) AS tall, cs, list_transform(range(0, 90), lambda x: CASE WHEN x < cs THEN r + least(rs, rows - r) ELSE 0 END) AS busy FROM k WHERE n = 1
UNION ALL SELECT k.l_orderkey, k.n, k.r, f.c, least(k.rs, k.rows - k.r), k.cs, list_transform(range(0, 90), lambda x: CASE WHEN x >= f.c AND x < f.c + k.cs THEN k.r + least(k.rs, k.rows - k.r) ELSE p.busy[x + 1] END)
 FROM p JOIN k ON k.l_orderkey = p.l_orderkey AND k.n = p.n + 1, LATERAL (SELECT list_min(list_filter(range(CASE WHEN k.r = p.r THEN p.c + p.cs ELSE 0 END, 90), lambda x: p.busy[x + 1] <= k.r)) AS c) f)
SELECT p.l_orderkey AS id, p.r AS row, CAST(p.c AS INTEGER) AS "column", CAST(p.tall AS INTEGER) AS row_span, CAST(p.cs AS INTEGER) AS column_span, k.l_linenumber % 5 = 0 AS header, 'q ' || CAST(l_quantity AS INTEGER) || ' x & y' AS text, 'Table ' || p.l_orderkey AS caption FROM p JOIN k USING (l_orderkey, n)""")
def html_tables(spark, folder):
    return hp.tables(stored(made_tables(spark, folder), "made-tables")).select("id", "row", "column", "row_span", "column_span", "header", "text", "caption")


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS t, p_size AS n FROM part)
SELECT id, unnest([1, 1, 1, 2]) AS "table", unnest([0, 0, 1, 0]) AS row, unnest([0, 1, 0, 0]) AS "column", unnest([t || ' ' || n, 'b' || n, 'last', 'in ' || t]) AS text, unnest(['T ' || n, 'T ' || n, 'T ' || n, NULL]) AS caption FROM p""")
def nested_tables(spark, folder):
    """Tables in cells of tables, one for each part."""
    t, n = F.col("p_name"), F.col("p_size").cast("string")
    html = F.concat(F.lit("<table><caption>T "), n, F.lit("</caption><tr><td>"), t, F.lit("<table><tr><td>in "), t, F.lit("</td></tr></table>"), n, F.lit("</td><td>b"), n, F.lit("</td></tr><tr><td>last</td></tr></table>"))
    found = hp.tables(table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    return found.select("id", F.col("table").cast("int").alias("table"), "row", "column", "text", "caption")


@query(r"""WITH n AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '(?s)<nav>(.*?)</nav>', 1)) AS nav FROM pages), l AS (SELECT id, unnest(regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1)) AS li, unnest(range(len(regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1)))) AS k FROM n)
SELECT id, k AS ord, 0 AS depth, regexp_replace(li, '<[^>]*>', '', 'g') AS label, regexp_extract(li, 'href="([^"]*)"', 1) AS href FROM l""")
def menu_entries(spark, folder):
    """The menus of pages as tables of contents."""
    menus = table(spark, folder, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("(?s)<nav>.*?</nav>"), F.lit(0)), "").alias("html"))
    return hp.contents_tree(menus).select("id", F.col("ord").cast("long").alias("ord"), F.col("depth").cast("int").alias("depth"), "label", "href")


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS t, p_size AS n, p_partkey % 5 AS k FROM part)
SELECT id, unnest(CASE k WHEN 0 THEN ['Table ' || n || ': ' || t, 'Source: ' || t] WHEN 1 THEN ['表' || n, t] WHEN 2 THEN ['Table ' || n || '. ' || t] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE ['table caption ' || t] END) AS text,
 unnest(CASE k WHEN 0 THEN ['table', 'table'] WHEN 1 THEN ['image', 'image'] WHEN 2 THEN ['table'] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE ['table'] END) AS carrier FROM p""")
def claimed_captions(spark, folder):
    """Captions and notes of tables and pictures by what they say and where they stand; sentences about tables and captions
    between two tables belong to none."""
    t, n, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    cells = "<table><tr><td>x</td></tr></table>"
    html = (F.when(k == 0, put("<div class=table-wrap><p>Table ", n, ": ", t, "</p>", cells, "<p>Source: ", t, "</p></div><p>Source: none</p>"))
            .when(k == 1, put("<p>表", n, "</p><p>", t, "</p><p><img src=a.png></p><p>Table ", n, " shows ", t, "</p>"))
            .when(k == 2, put("<p>Table ", n, " lists ", t, "</p>", cells, "<p>Table ", n, ". ", t, "</p><p>words</p>"))
            .when(k == 3, put(cells, "<p>Table ", n, ": ", t, "</p>", cells)).otherwise(put("<p class='Table_Caption'>table caption ", t, "</p>", cells, "<h2>Table ", n, "</h2>")))
    blocks = hp.table_captions(hp.flow(table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))))
    carriers = blocks.select(F.col("id").alias("_id"), F.col("ord").alias("_ord"), F.col("kind").alias("_kind"))
    return blocks.where("carrier is not null").join(carriers, (F.col("id") == F.col("_id")) & (F.col("carrier") == F.col("_ord"))).select("id", "text", F.col("_kind").alias("carrier"))


def made_parts(spark, folder):
    """Pages with definition lists, pictures with and without captions, and notes."""
    p = table(spark, folder, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    n = k.cast("string")
    lists = F.concat(F.lit("<dl><dt>"), name, F.lit("<dd>first <b>"), n, F.lit("</b></dd><dd>second</dl>"))
    picture = (F.when(k % 3 == 0, F.concat(F.lit("<figure><img src='i"), n, F.lit(".png'><figcaption>Figure "), n, F.lit(". It &amp; more</figcaption></figure><p>text</p>")))
               .when(k % 3 == 1, F.concat(F.lit("<p><img alt=x src=\"i"), n, F.lit(".png\"/></p><p> Fig. "), n, F.lit(" below it</p>"))).otherwise(F.concat(F.lit("<div><img src=i"), n, F.lit(".png></div><p>no caption</p>"))))
    note = F.when(k % 2 == 0, F.concat(F.lit("<aside id='n"), n, F.lit("' epub:type=\"footnote\"><p>Note "), n, F.lit("</p> ends</aside><p>out</p>"))).otherwise(F.concat(F.lit("<p role='doc-endnote x' id=e"), n, F.lit(">End "), n, F.lit("</p><p id=o>out</p>")))
    return p.select(k.alias("page_id"), F.concat(lists, picture, note).alias("html"))


@query("SELECT p_partkey AS id, p_name AS term, unnest(['first ' || p_partkey, 'second']) AS definition FROM part")
def html_definitions(spark, folder):
    return hp.definition_lists(made_parts(spark, folder)).select("id", "term", "definition")


@query("""SELECT p_partkey AS id, 'i' || p_partkey || '.png' AS href, CASE p_partkey % 3 WHEN 0 THEN 'Figure ' || p_partkey || '. It & more' WHEN 1 THEN 'Fig. ' || p_partkey || ' below it' END AS caption,
CASE WHEN p_partkey % 3 < 2 THEN 'figure/' || p_partkey END AS key FROM part""")
def html_figures(spark, folder):
    return hp.figures(made_parts(spark, folder)).select("id", "href", "caption", "key")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 'e' END || p_partkey AS fragment, CASE WHEN p_partkey % 2 = 0 THEN 'Note ' || p_partkey || ' ends' ELSE 'End ' || p_partkey END AS text FROM part")
def html_notes(spark, folder):
    return hp.note_definitions(made_parts(spark, folder))
