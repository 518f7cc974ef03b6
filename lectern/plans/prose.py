"""Prose marks, sentences, and the batch form of the reading stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.arrays import enclosed
from lectern.operators import language as lg, search as se
from lectern.plans.registry import query
from lectern.sources.tables import event_keys, table
from lectern.streaming import reading as st


@query()
def tracker_sessions(spark, folder):
    """Readings that ticks complete; events stand in for ticks, squeezed to seconds."""
    e = event_keys(table(spark, folder, "events"))
    ticks = e.select("device", F.col("event_id").alias("at0"), (F.col("event_type") != "error").alias("eligible"), F.col("event_type").isin("click", "view").alias("activity"),
                     ((F.col("user_id") % 25 - 12) * 3600).cast("int").alias("offset"), F.least(F.lit(1.0), F.col("value") / 500).alias("progress"))
    return st.readings_of(ticks.withColumn("at", F.col("at0") * 20).drop("at0"))


@query()
def sentences(spark, folder):
    return lg.sentences(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def lines(spark, folder):
    """Text lines with made list marks and references."""
    n = se.text_nodes(table(spark, folder, "documents"))
    mark = F.element_at(F.array(*[F.lit(m) for m in ("• ", "(3) ", "十二、", "IV. ", "b) ", "1900. ", "", "x ")]), (F.col("ord") % 8 + 1).cast("int"))
    return n.select("doc_id", "ord", F.concat(mark, F.col("text")).alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
n AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, text FROM l WHERE text <> '' AND ord % 8 <= 4 AND NOT regexp_matches(text, '^[0-9]'))
SELECT doc_id, ord, ['bullet', 'arabic', 'chinese', 'roman', 'alpha'][ord % 8 + 1] AS family, [1, 3, 12, 4, 2][ord % 8 + 1] AS value FROM n WHERE trim(text) <> ''""")
def list_markers(spark, folder):
    df = lines(spark, folder).where("ord % 8 <= 4").withColumn("m", lg.list_marker(F.col("text"))).where("m is not null")
    return df.select("doc_id", "ord", "m.family", "m.value")


@query("""WITH m AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 7 AS k FROM part)
SELECT id, 'figure' AS kind, unnest([CAST(n AS VARCHAR), CAST(n + 1 AS VARCHAR), CAST(n + 2 AS VARCHAR)]) AS number FROM m WHERE k = 0
UNION ALL SELECT id, 'table', n || '-1' FROM m WHERE k = 1 UNION ALL SELECT id, 'figure', '12' FROM m WHERE k = 2 UNION ALL SELECT id, unnest(['table', 'figure']), unnest([CAST(n AS VARCHAR), 'a.' || n || 'b']) FROM m WHERE k = 3
UNION ALL SELECT id, 'figure', unnest(['35', '36']) FROM m WHERE k = 4 UNION ALL SELECT id, 'table', n || 'c' FROM m WHERE k = 5""")
def media_mentions(spark, folder):
    """Figures and tables that made sentences mention: chains, full-width digits, letters before and after, Chinese numerals."""
    n, k = F.col("p_size"), F.col("p_partkey") % 7
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    text = (F.when(k == 0, put("see Figs ", n, ", ", n + 1, " and ", n + 2, " above")).when(k == 1, put("表", n, "–１ 显示")).when(k == 2, put("as in Fig. １２ or misfigure ", n))
            .when(k == 3, put("Tab. ", n, "; FIGURE A.", n, "B")).when(k == 4, put("插图三十五及三十六")).when(k == 5, put("tables ", n, "(c)")).otherwise(put("Plate ", n, ", chart ", n, " and prefigure ", n)))
    return lg.media_references(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))).select("id", "kind", "number")


@query("""WITH c AS (SELECT c_custkey AS id, replace(c_name, 'Customer#', 'N') AS who, 1900 + c_custkey % 120 AS y, c_custkey % 4 AS k FROM customer)
SELECT id, 'Smith, ' || y AS inside, true AS cites FROM c WHERE k = 0 UNION ALL SELECT id, 'as ' || who, false FROM c WHERE k = 0 UNION ALL SELECT id, '1, ' || (y % 50) || '-99', true FROM c WHERE k = 1
UNION ALL SELECT id, 'see Ng and Lee, ' || y || '; Wu et al., ' || y || 'a', true FROM c WHERE k = 2""")
def citation_candidates(spark, folder):
    k, y, who = F.col("c_custkey") % 4, (1900 + F.col("c_custkey") % 120).cast("string"), F.replace("c_name", F.lit("Customer#"), F.lit("N"))
    text = (F.when(k == 0, F.concat(F.lit("Words (Smith, "), y, F.lit(") and (as "), who, F.lit(") here."))).when(k == 1, F.concat(F.lit("Numbers [1, "), ((1900 + F.col("c_custkey") % 120) % 50).cast("string"), F.lit("-99].")))
            .when(k == 2, F.concat(F.lit("Many（see Ng and Lee, "), y, F.lit("; Wu et al., "), y, F.lit("a）."))).otherwise("none"))
    return lg.citations(table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), text.alias("text")), "id").select("id", "inside", "cites")


@query("""WITH RECURSIVE t AS (SELECT page_id AS id, unnest(string_split(html, '')) AS c, unnest(range(length(html))) AS pos FROM pages),
b AS (SELECT id, c, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n, CASE c WHEN '(' THEN ')' WHEN '[' THEN ']' WHEN '（' THEN '）' WHEN '［' THEN '］' END AS own FROM t WHERE c IN ('(', ')', '[', ']', '（', '）', '［', '］')),
r AS (SELECT id, CAST(0 AS BIGINT) AS n, '' AS open, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT id FROM b)
 UNION ALL SELECT r.id, b.n, CASE WHEN own IS NOT NULL THEN own || open WHEN c = open[1] THEN substr(open, 2) ELSE open END, CASE WHEN open = '' THEN pos ELSE s END, CASE WHEN own IS NULL AND c = open THEN pos + 1 END FROM r JOIN b ON b.id = r.id AND b.n = r.n + 1)
SELECT id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM r WHERE e IS NOT NULL""")
def nested_brackets(spark, folder):
    """Outermost passages in brackets of whole pages, markup and scripts included."""
    spans = enclosed(F.col("html"), lg.CITED_IN)
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.inline_outer(spans)).where("start is not null")


@query("""WITH p AS (SELECT page_id AS id, url, page_id % 3 AS k FROM pages) SELECT id, url AS link FROM p WHERE k = 0 UNION ALL SELECT id, url || '_(c)' FROM p WHERE k = 1 UNION ALL SELECT id, 'www.z' || id || '.com' FROM p WHERE k = 1""")
def prose_links(spark, folder):
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.concat(F.lit("look (at "), "url", F.lit("), now"))).when(k == 1, F.concat(F.lit("see "), "url", F.lit("_(c), or <www.z"), F.col("page_id").cast("string"), F.lit(".com>.”"))).otherwise("no address, http or www")
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.explode(tx.web_links(text)).alias("link"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ['xiv', 'mmc', 'ii'][p_size % 3 + 1] WHEN 2 THEN ['twentyone', 'seven', 'onehundred'][p_size % 3 + 1] END AS key FROM part""")
def heading_ordinals(spark, folder):
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_size") % 3 + 1).cast("int"))
    k = F.col("p_partkey") % 5
    heading = (F.when(k == 0, F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit("."))).when(k == 1, pick("Part XIV", "mmc —", "Book: II")).when(k == 2, pick("Twenty-One", "seven:", "One hundred"))
               .when(k == 3, F.concat(F.lit("Part the "), F.col("p_size").cast("string"))).otherwise(" "))
    return table(spark, folder, "part").select("p_partkey", tx.ordinal(heading).alias("key"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'epub' WHEN 1 THEN 'fbz' WHEN 3 THEN 'azw3' WHEN 4 THEN 'pdf' WHEN 5 THEN 'mobi' END AS format FROM part""")
def format_dispatch(spark, folder):
    ending = F.element_at(F.array(*[F.lit(e) for e in (".EPUB", ".fb2.zip", ".zip", ".azw3", ".Pdf", ".azw")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, folder, "part").select("p_partkey", tx.book_format(F.concat("p_name", ending)).alias("format"))


@query("""SELECT p_partkey, regexp_matches(' ' || lower(p_type) || ' ', '[^a-z0-9]brushed[^a-z0-9]') AS held FROM part""")
def glossary_terms(spark, folder):
    return table(spark, folder, "part").select("p_partkey", tx.contains_term(F.col("p_type"), F.lit("Brushed")).alias("held"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def daily_counts(spark, folder):
    """The streaming aggregate over a finished table (a watermark has no effect there)."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.daily_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))
