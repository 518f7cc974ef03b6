"""Text nodes, search, paging, scripts, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import batching as bt, continuations as co, search as se
from lectern.plans.registry import query
from lectern.sources.tables import table

NODES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents), nodes AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'n' || (ord + 1) AS node, text FROM l WHERE text <> '')"


def nodes(spark, folder):
    return se.text_nodes(table(spark, folder, "documents"))


@query(f"WITH {NODES_SQL} SELECT doc_id, ord, node, text FROM nodes")
def text_nodes(spark, folder):
    return nodes(spark, folder).select("doc_id", "ord", "node", "text")


#: Places from the pieces between hits: each hit is as long as the query, which holds for ASCII.
HITS_SQL = f"""WITH {NODES_SQL}, p AS (SELECT *, string_split(lower(text), 'the ') AS parts FROM nodes WHERE contains(lower(text), 'the ')),
h AS (SELECT doc_id, ord, node, text, unnest(range(1, len(parts))) AS i, parts FROM p),
s AS (SELECT doc_id, ord, node, text, CAST(list_sum(list_transform(parts[1 : i], lambda x: length(x))) + 4 * (i - 1) AS INTEGER) AS start FROM h)"""


@query(f"{HITS_SQL} SELECT doc_id, ord, node, start, start + 4 AS \"end\", substr(text, greatest(start - 60, 0) + 1, least(start + 64, length(text)) - greatest(start - 60, 0)) AS excerpt FROM s")
def search_hits(spark, folder):
    return se.search(nodes(spark, folder), "the ")


@query(f"{HITS_SQL} SELECT doc_id, ord, start FROM s ORDER BY doc_id, ord, start LIMIT 200")
def search_top200(spark, folder):
    return se.first_hits(se.search(nodes(spark, folder), "the ")).select("doc_id", "ord", "start")


@query(f"{HITS_SQL} SELECT doc_id, ord, start FROM s ORDER BY doc_id, ord, start LIMIT 6")
def search_given(spark, folder):
    """What an assistant is given of a search."""
    return se.first_hits(se.search(nodes(spark, folder), "the "), se.GIVEN).select("doc_id", "ord", "start")


@query("""WITH t AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM t WHERE place <= 5""")
def service_top5(spark, folder):
    """The five longest documents of every source."""
    d = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return se.first_of_each(d, "source", F.col("n_chars").desc(), F.col("doc_id").asc()).select("source", "doc_id", "place")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) AS BIGINT) AS n FROM documents")
def search_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(se.places(F.col("text"), "the", True)).cast("long").alias("n"))


@query(f"WITH {NODES_SQL} SELECT doc_id, node, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nodes")
def section_offsets(spark, folder):
    return se.offsets(nodes(spark, folder)).select("doc_id", "node", "offset")


@query(f"""WITH {NODES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM nodes), k AS (SELECT * FROM n WHERE n > 2 AND n <= 42),
c AS (SELECT *, 3000 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM k)
SELECT doc_id, node, substr(text, 1, CAST(remaining AS INTEGER)) AS text, length(text) > remaining AS truncated FROM c WHERE remaining > 0""")
def content_page(spark, folder):
    return se.page(nodes(spark, folder), 2, 40, 3000).select("doc_id", "node", "text", "truncated")


@query("SELECT b.item_id AS quote_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def quote_repeats(spark, folder):
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return se.quote_pairs(quotes, table(spark, folder, "documents").select("doc_id", "text"))


@query("SELECT quote_id, min(doc_id) AS doc_id FROM (SELECT b.item_id AS quote_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)) GROUP BY 1 HAVING count(*) = 1")
def unique_quotes(spark, folder):
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return se.unique_quotes(quotes, table(spark, folder, "documents").select("doc_id", "text"))


@query(r"""WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[\x{1100}-\x{11FF}\x{2E80}-\x{2FFF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]')) AS cjk,
len(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]')) AS latin FROM documents)
SELECT doc_id, CASE WHEN cjk + latin < 2 THEN 'unknown' WHEN cjk * 100 >= (cjk + latin) * 60 THEN 'cjk' WHEN latin * 100 >= (cjk + latin) * 60 THEN 'latin' ELSE 'unknown' END AS by_text, CASE doc_id % 6 WHEN 0 THEN 'latin' WHEN 1 THEN 'cjk' WHEN 2 THEN 'other' WHEN 3 THEN 'latin' WHEN 4 THEN NULL ELSE CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN 'latin' WHEN lang IN ('zh', 'ja') THEN 'cjk' END END AS by_tag FROM c""")
def writing_system(spark, folder):
    k = F.col("doc_id") % 6
    tag = F.when(k == 0, F.concat(F.upper("lang"), F.lit("_AT"))).when(k == 1, F.concat("lang", F.lit("-Hant"))).when(k == 2, "sr").when(k == 3, "sr-Latn").when(k == 4, "und").otherwise(F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", tx.writing_system_of_title(F.col("text")).alias("by_text"), tx.writing_system_of_tag(tag).alias("by_tag"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[\x{370}-\x{52F}\x{590}-\x{8FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]')) AS rivals FROM documents)
SELECT doc_id, latin >= 5 AND latin * 100 >= (latin + rivals * 2) * 70 AS english FROM c""")
def english_predominance(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.mostly_english(F.col("text")).alias("english"))


@query(f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) AS ascii_,
regexp_extract_all(lower(text), '\\b[A-Za-z]+\\b') AS w FROM documents)
SELECT doc_id, letters > 0 AND ascii_ >= 20 AND ascii_ * 100 >= letters * 85 AND len(w) >= 5 AND len(list_filter({list(tx.CUES)!r}, lambda c: list_contains(w, c))) >= 2 AS prose FROM c""")
def english_prose(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.english_prose(F.col("text")).alias("prose"))


@query(r"SELECT doc_id, regexp_replace(lower(text), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}:.\-\x{2010}-\x{2014}]', '', 'g') AS heading_key, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS letters_key FROM documents")
def doc_heading_key(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.heading_key(F.col("text")).alias("heading_key"), tx.letters_digits_key(F.col("text")).alias("letters_key"))


@query(r"SELECT doc_id, lower(regexp_replace(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS normalised, regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g') AS collapsed FROM documents")
def normalised_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.normalized(F.col("text")).alias("normalised"), tx.collapse_html_space(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped, text AS back FROM documents")
def escape_round_trip(spark, folder):
    e = tx.escaped(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", e.alias("escaped"), tx.unescaped(e).alias("back"))


@query("""WITH n AS (SELECT p_partkey, CAST(p_partkey % 399 + 1 AS INTEGER) AS n FROM part) SELECT p_partkey, n AS chinese, n AS roman, CAST(NULL AS INTEGER) AS neither FROM n""")
def numeral_values(spark, folder):
    """Numerals written out for each part's number and read again."""
    n = (F.col("p_partkey") % 399 + 1).cast("int")
    digit = lambda d, words: F.element_at(F.array(*[F.lit(w) for w in words]), (d + 1).cast("int"))
    ones, tens, hundreds = n % 10, F.floor(n / 10) % 10, F.floor(n / 100)
    han = ("", *"一二三四五六七八九")
    chinese = F.concat(F.when(hundreds > 0, F.concat(digit(hundreds, han), F.lit("百"))).otherwise(""), F.when(tens > 0, F.concat(digit(tens, han), F.lit("十"))).otherwise(""), digit(ones, han))
    roman = F.concat(F.repeat(F.lit("C"), hundreds.cast("int")), digit(tens, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), digit(ones, ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")))
    return table(spark, folder, "part").select("p_partkey", tx.chinese_number(chinese).alias("chinese"), tx.roman_number(roman).alias("roman"), tx.roman_number(F.concat(roman, F.lit("1"))).alias("neither"))


@query("""WITH c AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, role FROM c WHERE n <= 6 AND s <= 2400""")
def chat_history_budget(spark, folder):
    return bt.newest_within(table(spark, folder, "conversations"), "conv_id", "turn", F.length("text"), 6, 2400).select("conv_id", "turn", "role")


def _lengths(spark, folder):
    return nodes(spark, folder).select("doc_id", "ord", F.length("text").alias("size"), F.col("text").rlike("^.{1,24}$").alias("short"))


GREEDY_SQL = """WITH RECURSIVE {nodes}, i AS (SELECT doc_id, ord, length(text) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM nodes),
g AS (SELECT doc_id, ord, n, size AS s, 0 AS batch FROM i WHERE n = 1 UNION ALL
SELECT i.doc_id, i.ord, i.n, CASE WHEN s + size > {budget} THEN size ELSE s + size END, CASE WHEN s + size > {budget} THEN batch + 1 ELSE batch END FROM g JOIN i ON i.doc_id = g.doc_id AND i.n = g.n + 1)
SELECT doc_id, ord, batch FROM g"""


@query(GREEDY_SQL.format(nodes=NODES_SQL, budget=2000))
def translation_batches(spark, folder):
    return bt.greedy(_lengths(spark, folder), "doc_id", "ord", "size", bt.TRANSLATION_BUDGET).select("doc_id", "ord", "batch")


@query(f"""WITH RECURSIVE {NODES_SQL}, m AS (SELECT doc_id, ord, length(text) AS size, regexp_matches(text, '^.{{1,24}}$') AS short, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM nodes),
i AS (SELECT *, CAST(sum(CASE WHEN short AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section FROM m),
g AS (SELECT doc_id, ord, n, section, size AS s, 0 AS batch FROM i WHERE n = 1 UNION ALL
SELECT i.doc_id, i.ord, i.n, i.section, CASE WHEN i.section <> g.section OR s + size > 5000 THEN size ELSE s + size END, CASE WHEN i.section <> g.section OR s + size > 5000 THEN batch + 1 ELSE batch END FROM g JOIN i ON i.doc_id = g.doc_id AND i.n = g.n + 1)
SELECT doc_id, ord, section, batch FROM g""")
def greedy_batches(spark, folder):
    """Batches of at most 5,000 characters within sections, which short lines begin."""
    rows = bt.sections(_lengths(spark, folder), "doc_id", "ord", F.col("short"))
    return bt.greedy(rows, "doc_id", "ord", "size", bt.SECTION_BUDGET, "section").select("doc_id", "ord", "section", "batch")


@query(f"""WITH {NODES_SQL}, n AS (SELECT *, regexp_matches(text, '^.{{1,24}}$') AS short FROM nodes)
SELECT doc_id, ord, CAST(sum(CASE WHEN short AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM n)""")
def section_groups(spark, folder):
    return bt.sections(_lengths(spark, folder), "doc_id", "ord", F.col("short")).select("doc_id", "ord", "section")


@query(f"""WITH {NODES_SQL}, n AS (SELECT *, regexp_matches(text, '^.{{1,24}}$') AS short FROM nodes), q AS (SELECT *, CASE WHEN short AND coalesce(lag(short) OVER (PARTITION BY doc_id ORDER BY ord), false) THEN 0 ELSE 1 END AS s FROM n)
SELECT doc_id, ord, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM q""")
def caption_islands(spark, folder):
    return bt.islands(_lengths(spark, folder), "doc_id", "ord", F.col("short")).select("doc_id", "ord", "island")


@query("""WITH p AS (SELECT DISTINCT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS g FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n FROM r) SELECT user_id, k, n AS run_size FROM c WHERE n >= 2""")
def marker_sequences(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()
    return bt.sequences(e, "user_id", "k", "k").select("user_id", "k", "run_size")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 10 END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem),
f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER w AS mark, last_value(v IGNORE NULLS) OVER w AS lv FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber, CAST(coalesce(lv + n - mark, n) AS BIGINT) AS ordinal FROM f""")
def list_ordinals(spark, folder):
    i = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("start"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") * 10).alias("value"))
    return bt.list_ordinals(i, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("ordinal").cast("long").alias("ordinal"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events)
SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS number FROM e""")
def footnote_numbers(spark, folder):
    return bt.note_numbers(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", F.col("number").cast("long").alias("number"))


@query("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 1000000) AS \"end\" FROM orders")
def chapter_page_ranges(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.lit(1_000_000).cast("long").alias("pages"))
    return bt.page_ranges(o, "o_custkey", "o_orderkey", "pages").select("o_custkey", "o_orderkey", "end")


@query("""WITH s AS (SELECT user_id, event_id, event_type = 'signup' AS heading, value > 250 AS opens FROM events)
SELECT user_id, event_id, coalesce(last_value(CASE WHEN heading THEN opens END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_region FROM s""")
def reference_regions(spark, folder):
    e = table(spark, folder, "events")
    return bt.region_flag(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("value") > 250).select("user_id", "event_id", "in_region")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 100), event_id) AS r FROM events) SELECT user_id, event_id FROM d WHERE r <= 8""")
def nearest_blocks(spark, folder):
    return bt.nearest(table(spark, folder, "events"), "user_id", F.abs(F.col("value") - 100), "event_id").select("user_id", "event_id")


@query()
def glossary_pick(spark, folder):
    """Terms of a made glossary that each document holds, longest first, while they fit the budget."""
    terms = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where("length(term) >= 4").distinct()
    d = table(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("term"))
    held = d.join(terms, "term").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    size = lambda x: F.length(F.to_json(F.struct(x.alias("s"), x.alias("t"))))
    ordered = F.array_sort("terms", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return held.select("doc_id", bt.pick_skipping(ordered, size, 400, bt.GLOSSARY_MOST).alias("picked"))


@query(r"""WITH n AS (SELECT item_id AS quote_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM benchmark), q AS (SELECT quote_id, substr(t, 1, length(t) // 2) || repeat('*', quote_id % 30) || substr(t, length(t) // 2 + 1 + quote_id % 7) AS q FROM n WHERE t <> ''),
d AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents), c AS (SELECT *, length(q) AS n, contains(t, q) AS same FROM q JOIN d ON contains(t, q) OR (length(q) >= 96 AND contains(t, substr(q, 1, 32)))),
p AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM c WHERE NOT same), h AS (SELECT *, list_max(list_filter(range(0, n + 1), lambda k: substr(t, i, k) = substr(q, 1, k) AND i + k - 1 <= length(t))) AS a FROM p WHERE substr(t, i, 32) = substr(q, 1, 32)),
l AS (SELECT *, unnest(range(n - 24, n + 25)) AS z FROM h), m AS (SELECT *, least(a, z) AS b, substr(t, i, z) AS w FROM l WHERE i - 1 + z <= length(t)),
s AS (SELECT *, least(list_max(list_filter(range(0, n + 1), lambda k: k <= z AND right(w, k) = right(q, k))), n - b, z - b) AS e FROM m)
SELECT DISTINCT quote_id, doc_id FROM c WHERE same UNION SELECT quote_id, doc_id FROM s WHERE b >= 32 AND e >= 32 AND n - b - e <= 24 AND z - b - e <= 24""")
def near_quote_repeats(spark, folder):
    """Passages of the benchmark, changed in the middle, that documents repeat but for the change."""
    b = table(spark, folder, "benchmark").select(F.col("item_id").alias("quote_id"), co.normalised(F.col("text")).alias("t")).where("t <> ''")
    half, k = F.floor(F.length("t") / 2).cast("int"), F.col("quote_id")
    quote = F.concat(F.substring(F.col("t"), F.lit(1), half), F.repeat(F.lit("*"), (k % 30).cast("int")), F.substring(F.col("t"), (half + 1 + k % 7).cast("int"), F.lit(2147483647)))
    docs = table(spark, folder, "documents").select("doc_id", co.normalised(F.col("text")).alias("text"))
    return co.near_quotes(b.select("quote_id", quote.alias("quote")), docs)
