"""Page lines, grid lines, moved quotes, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import pages as pg, search as se
from lectern.plans.registry import query
from lectern.plans.text import NODES_SQL
from lectern.sources.tables import table


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE l_quantity END AS h, l_returnflag || l_linestatus AS t FROM lineitem),
m AS (SELECT l_orderkey, list_sort(list(h) FILTER (WHERE h > 0)) AS s FROM l GROUP BY 1),
d AS (SELECT l_orderkey, CASE WHEN s IS NULL OR len(s) = 0 THEN 12.0 ELSE s[len(s) // 2 + 1] END AS median FROM m)
SELECT l_orderkey, l_linenumber, median, h > median * 1.3 AND length(t) < 160 AS heading FROM l JOIN d USING (l_orderkey)""")
def page_headings(spark, folder):
    """Lines taller than the middle height of their page; orders stand in for pages, quantities for heights."""
    i = table(spark, folder, "lineitem")
    height = F.when(F.col("l_linenumber") % 5 == 0, 0.0).otherwise(F.col("l_quantity"))
    return pg.page_headings(i, "l_orderkey", height, F.concat("l_returnflag", "l_linestatus")).select("l_orderkey", "l_linenumber", "median", "heading")


@query("""WITH p AS (SELECT user_id, value AS a, value + event_id % 7 AS z FROM events), o AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
g AS (SELECT *, sum(CASE WHEN a <= reach + 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM o)
SELECT user_id, min(a) AS start, max(z) AS "end" FROM g GROUP BY user_id, part""")
def grid_lines(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 7).alias("z"))
    return pg.merged_lines(e, "user_id", "a", "z", 0.5)


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"p": ' || props || ', "q": "\\",]"}' WHEN 1 THEN '{"a": [1, ' || event_id || '], "b": ",}"}' END AS json FROM events""")
def tolerant_json(spark, folder):
    """Objects of events wrapped in prose, with commas too many."""
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"p": '), "props", F.lit(', "q": "\\",]",}'))).when(k == 1, F.concat(F.lit('Here: ```{"a": [1, '), n, F.lit(',], "b": ",}",}``` end'))).otherwise(F.concat(F.lit("no object "), n))
    return table(spark, folder, "events").select("event_id", pg.tolerant_json(text).alias("json"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\\s\\x{A0}]+', '', 'g') AS t, regexp_replace(lower(substr(text, 1, 3)), '[\\s\\x{A0}]+', '', 'g') AS q FROM conversations),
c AS (SELECT *, coalesce(q <> '' AND contains(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), q), false) AS continued FROM t)
SELECT conv_id, turn, continued, CAST(sum(CASE WHEN continued THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS spread FROM c""")
def continuation_spreads(spark, folder):
    """Sections whose opening stands in the one before; turns stand in for sections, three letters for the quote."""
    c = table(spark, folder, "conversations")
    return pg.spread_groups(c, "conv_id", "turn", F.substring("text", 1, 3), F.col("text")).select("conv_id", "turn", "continued", "spread")


@query(f"""WITH {NODES_SQL}, a AS (SELECT doc_id AS id, doc_id, node, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS s, substr(text, 1, 30) AS quote, ord FROM nodes WHERE ord = 1 AND length(text) >= 40),
own AS (SELECT a.*, trim(regexp_replace(substr(n.text, s + 1, 30), '[\\s\\x{{A0}}]+', ' ', 'g')) = trim(regexp_replace(quote, '[\\s\\x{{A0}}]+', ' ', 'g')) AS same FROM a JOIN nodes n ON n.doc_id = a.doc_id AND n.node = a.node),
f AS (SELECT own.id, n.node, strpos(lower(n.text), lower(quote)) AS p, strpos(substr(lower(n.text), strpos(lower(n.text), lower(quote)) + length(quote)), lower(quote)) > 0 AS again, length(quote) AS n FROM own JOIN nodes n ON n.doc_id = own.doc_id WHERE NOT same AND contains(lower(n.text), lower(quote)))
SELECT id, node, CAST(s AS INTEGER) AS start, CAST(s + 30 AS INTEGER) AS "end" FROM own WHERE same
UNION ALL SELECT id, min(node), CAST(min(p - 1) AS INTEGER), CAST(min(p - 1 + n) AS INTEGER) FROM f GROUP BY id HAVING count(*) = 1 AND NOT bool_or(again)""")
def reanchored_quotes(spark, folder):
    """Annotations on the second line of each document; every third one has lost its place."""
    nodes = se.text_nodes(table(spark, folder, "documents"))
    start = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0)
    made = nodes.where("ord = 1 and length(text) >= 40").select(
        F.col("doc_id").alias("id"), "doc_id", "node", start.alias("start"), (start + 30).alias("end"), F.substring("text", 1, 30).alias("quote"))
    return pg.reanchored(made, nodes).select("id", "node", "start", "end")


@query("""SELECT conv_id, turn, 0 AS layer, text FROM conversations UNION ALL SELECT conv_id, turn, 1, '> ' || text FROM conversations WHERE turn % 2 = 0""")
def bilingual_overlay(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return pg.overlaid(c, c.where("turn % 2 = 0").withColumn("text", F.concat(F.lit("> "), "text")), ["conv_id", "turn"], bilingual=True)


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '> ' || text ELSE text END AS text FROM conversations")
def rewrite_overlay(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return pg.overlaid(c, c.where("turn % 2 = 0").withColumn("text", F.concat(F.lit("> "), "text")), ["conv_id", "turn"])


@query("""WITH t AS (SELECT p_partkey AS image, 'i' || p_partkey AS name FROM part UNION SELECT p_partkey, 'j' || (p_partkey * p_partkey % 997) FROM part),
b AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'i' ELSE 'j' END || p_partkey AS name, p_partkey AS block FROM part),
p AS (SELECT DISTINCT image, block FROM t JOIN b USING (name)), o AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM p) SELECT image, block FROM o WHERE n = 1""")
def described_images(spark, folder):
    """Pictures and the texts that describe them by name; parts stand in for both."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("p"))
    images = p.select(F.col("p").alias("image"), F.concat(F.lit("i"), F.col("p").cast("string"), F.lit("  j"), (F.col("p") * F.col("p") % 997).cast("string")).alias("refs"))
    blocks = p.select(F.concat(F.when(F.col("p") % 3 == 0, "i").otherwise("j"), F.col("p").cast("string")).alias("name"), F.col("p").alias("block"))
    return pg.described(images, blocks)
