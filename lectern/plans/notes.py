"""Annotations, notes, sources, glossaries; events, parts and orders stand in for a reader's own records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import notes as nt, replica as rp, search as se, toc as tc
from lectern.operators.ranks import placed
from lectern.plans.registry import query
from lectern.plans.text import NODES_SQL
from lectern.sources.tables import event_keys, table

NOTES_SQL = """n AS (SELECT event_id AS id, user_id % 10 AS s1, event_id % 10 AS s2, 'b' || (user_id % 7) AS book, 'u' || user_id AS device, event_type AS quote,
CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '  ' END AS note, event_type = 'error' AS deleted FROM events)"""


def annotations(spark, folder):
    note = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "  ")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.array(F.col("user_id") % 10, F.col("event_id") % 10).alias("spines"), F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("book"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("device"), F.col("event_type").alias("quote"), note.alias("note"), (F.col("event_type") == "error").alias("deleted"))


@query(f"WITH {NOTES_SQL} SELECT id, quote, note FROM n WHERE (s1 = 3 OR s2 = 3) AND contains(lower(quote || ' ' || coalesce(note, '')), 'click') ORDER BY id LIMIT 30")
def annotation_search(spark, folder):
    return nt.search_annotations(annotations(spark, folder), "CLICK", "id", 3).select("id", "quote", "note")


@query(f"WITH {NOTES_SQL} SELECT book, count(*) AS annotations, count(*) FILTER (trim(coalesce(note, '')) <> '') AS notes FROM n GROUP BY 1")
def annotation_counts(spark, folder):
    return nt.annotation_counts(annotations(spark, folder), "book")


@query(f"WITH {NOTES_SQL} SELECT id, book FROM n WHERE NOT deleted AND device = 'u7'")
def own_annotations(spark, folder):
    return nt.own_visible(annotations(spark, folder), F.lit("u7")).select("id", "book")


PLACED_SQL = "p AS (SELECT event_id AS id, user_id AS reader, CASE WHEN event_id % 11 > 0 THEN user_id % 5 + event_id % 3 END AS spine, 'n' || (event_id % 120) AS node, CASE WHEN event_id % 13 > 0 THEN CAST(floor(value) AS BIGINT) END AS o FROM events)"


@query(f"WITH {PLACED_SQL} SELECT reader, id, row_number() OVER (PARTITION BY reader ORDER BY spine ASC NULLS LAST, CAST(substr(node, 2) AS BIGINT), o ASC NULLS LAST, id) AS place FROM p")
def annotations_in_order(spark, folder):
    """Every reader's annotations in reading order, with their places."""
    e = table(spark, folder, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("reader"), F.when(F.col("event_id") % 11 > 0, F.col("user_id") % 5 + F.col("event_id") % 3).alias("spine"),
                    F.concat(F.lit("n"), (F.col("event_id") % 120).cast("string")).alias("node"), F.when(F.col("event_id") % 13 > 0, F.floor("value")).alias("offset"))
    return placed(rows, *rp.reading_order(), group="reader").select("reader", "id", "place")


TITLES = ("Notes", "Endnotes 2", "  Footnote: ", "Noted", "注释", "Chapter 1", "NOTES—12")
TOC_SQL = f"t AS (SELECT p_brand AS book, p_partkey AS spine, {list(TITLES)!r}[p_partkey % 7 + 1] AS label, 's' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '#x' ELSE '' END AS href FROM part)"


def note_toc(spark, folder):
    p = table(spark, folder, "part")
    label = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("spine"), label.alias("label"), F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "#x").otherwise("")).alias("href"))


@query(f"WITH {TOC_SQL} SELECT book, spine FROM t WHERE spine % 7 IN (0, 1, 2, 4, 6) AND spine % 4 <> 0")
def note_sections(spark, folder):
    return nt.note_sections(note_toc(spark, folder))


@query("""WITH d AS (SELECT 's' || (user_id % 9) AS path, 'f' || (event_id % 50) AS fragment, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS text FROM events WHERE event_type <> 'view'),
f AS (SELECT path, fragment, arg_min(text, ord) AS definition FROM d GROUP BY 1, 2), r AS (SELECT event_id AS id, 's' || (event_id % 12) AS path, 'f' || (user_id % 60) AS fragment FROM events WHERE event_type = 'view' AND event_id % 3 > 0)
SELECT id, definition FROM r JOIN f USING (path, fragment) WHERE trim(definition) <> ''""")
def footnote_definitions(spark, folder):
    e = table(spark, folder, "events")
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    anchors = e.where("event_type <> 'view'").select(name("s", F.col("user_id") % 9).alias("path"), name("f", F.col("event_id") % 50).alias("fragment"), F.col("event_id").alias("ord"),
                                                     F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("text"))
    fragment = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("#"), name("f", F.col("user_id") % 60)))
    links = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.concat(name("s", F.col("event_id") % 12), fragment).alias("href"))
    return nt.definitions(links, anchors).select("id", "definition")


@query("WITH l AS (SELECT user_id, event_id, event_id % 6 AS number FROM events) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, number ORDER BY event_id) AS n FROM l) WHERE n = 1 OR number = 0")
def reference_notes(spark, folder):
    links = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") % 6).alias("number"))
    return nt.reference_notes(links, "user_id", "event_id", "number").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) - 1 AS INTEGER) AS ordinal, 'c' || l_orderkey || '_' || (l_suppkey % 3) || '_' || (row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) - 1) AS wire_id FROM lineitem")
def citation_ordinals(spark, folder):
    i = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("paragraph"))
    return nt.citation_ids(i, "l_orderkey", "paragraph", "l_linenumber").select("l_orderkey", "l_linenumber", "ordinal", "wire_id")


@query("WITH f AS (SELECT user_id, 'https://x.org/' || (CAST(floor(value) AS BIGINT) % 60) AS url, min(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_id, url FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM f) WHERE n <= 30")
def merged_sources(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", F.concat(F.lit("https://x.org/"), (F.floor("value") % 60).cast("string")).alias("url"))
    return nt.merged_sources(e, "user_id", "event_id").select("user_id", "event_id", "url")


GLOSSARY_SQL = """p AS (SELECT user_id AS book, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS ord, '  Term ' || (CAST(floor(value) AS BIGINT) % 40) AS source, event_type AS target, event_id % 4 > 0 AS held FROM events),
k AS (SELECT DISTINCT user_id AS book, 'term ' || (user_id % 40) AS s FROM events),
w AS (SELECT *, lower(trim(source)) AS s FROM p WHERE held AND ord < 32), f AS (SELECT *, row_number() OVER (PARTITION BY book, s ORDER BY ord) AS one FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.book = w.book AND k.s = w.s)),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord) AS n FROM f WHERE one = 1)"""


@query(f"WITH {GLOSSARY_SQL} SELECT book, ord, trim(source) AS source, target FROM r WHERE n <= 8")
def glossary_merge(spark, folder):
    from pyspark.sql import Window as W

    e = table(spark, folder, "events")
    ord_ = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    proposed = e.select(F.col("user_id").alias("book"), ord_.alias("ord"), F.concat(F.lit("  Term "), (F.floor("value") % 40).cast("string")).alias("source"), F.col("event_type").alias("target"), (F.col("event_id") % 4 > 0).alias("held"))
    known = e.select(F.col("user_id").alias("book"), F.concat(F.lit("TERM  "), (F.col("user_id") % 40).cast("string")).alias("source")).distinct()
    return nt.merged_glossary(known, proposed, "book")


FOUND_SQL = """e AS (SELECT user_id AS book, event_id AS ord, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE event_type END AS title, CAST(floor(value) AS BIGINT) % 200 AS page, event_id % 4 AS depth FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY book, page, title ORDER BY ord) AS one FROM e WHERE page BETWEEN 1 AND 180 AND trim(title) <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, ord) AS place FROM f WHERE one = 1)"""


def found_toc(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, " ").otherwise(F.col("event_type")).alias("title"),
                                              (F.floor("value") % 200).alias("page"), (F.col("event_id") % 4).cast("int").alias("depth"), F.lit(180).alias("pages"))
    return nt.discovered_toc(e, "book", "pages")


@query(f"WITH {FOUND_SQL} SELECT book, page, title, CAST(place AS INTEGER) AS place FROM d WHERE place <= 512")
def discovered_toc(spark, folder):
    return found_toc(spark, folder).select("book", "page", "title", "place")


@query(f"WITH {FOUND_SQL} SELECT a.book, CAST(a.place AS INTEGER) AS ord, CAST(max(b.place) AS INTEGER) AS parent FROM d a LEFT JOIN d b ON a.book = b.book AND b.place < a.place AND b.depth < a.depth WHERE a.place <= 512 GROUP BY 1, 2")
def generated_toc(spark, folder):
    """The tree of discovered entries: each under the last earlier one of smaller depth."""
    return tc.parents(found_toc(spark, folder).select("book", F.col("place").alias("ord"), "depth")).select("book", "ord", "parent")


@query(f"WITH {FOUND_SQL} SELECT book, CAST(place AS INTEGER) AS place FROM d WHERE place <= 128")
def toc_given(spark, folder):
    return found_toc(spark, folder).where(F.col("place") <= nt.TOC_GIVEN).select("book", "place")


@query(f"""WITH {NODES_SQL}, h AS (SELECT doc_id, sum(len(string_split(lower(text), 'and ')) - 1) AS hits FROM nodes WHERE contains(lower(text), 'and ') GROUP BY 1),
b AS (SELECT *, sum(hits) OVER (ORDER BY doc_id) - hits AS before FROM h) SELECT doc_id, CAST(hits AS BIGINT) AS hits, CAST(before AS BIGINT) AS before FROM b WHERE before < 200""")
def search_batches(spark, folder):
    """Hits by document as a search gives them out, until 200 are shown."""
    hits = se.search(se.text_nodes(table(spark, folder, "documents")), "and ")
    return nt.search_batches(hits, "doc_id")


@query("WITH v AS (SELECT DISTINCT turn, conv_id FROM conversations WHERE turn % 2 = 0) SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM v WHERE v.conv_id = c.conv_id AND v.turn = c.turn)")
def visible_nodes(spark, folder):
    """Blocks whose node is on the screen."""
    c = table(spark, folder, "conversations").select("conv_id", "turn")
    return c.join(c.where("turn % 2 = 0").distinct(), ["conv_id", "turn"], "left_semi")


@query("SELECT b.book, coalesce(p.p_name, '') AS title, n FROM (SELECT 'b' || regexp_extract(props, '([0-9]+)', 1) AS book, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2) b LEFT JOIN part p ON p.p_partkey = b.k")
def statistics_with_library(spark, folder):
    """Statistics joined with the library; books that are gone keep their figures."""
    stats = event_keys(table(spark, folder, "events")).groupBy("book", "k").agg(F.count("*").alias("n"))
    books = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    return stats.join(books, "k", "left").select("book", F.coalesce("title", F.lit("")).alias("title"), "n")
