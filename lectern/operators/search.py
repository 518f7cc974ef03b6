"""Text nodes of documents, literal search with exact places, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.arrays import match_spans
from lectern.functions.text import excerpt

#: Hits that a search page shows, that an assistant is given, and that it takes from each service.
SHOWN, GIVEN, SERVICE = 200, 6, 5
MARK_KIND = "struct<start:int,end:int>"


def text_nodes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-empty lines as nodes: doc_id, ord, node (`n1`, `n2`, ... counting every line), text."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("ord", "text"))
    return lines.where("text <> ''").withColumn("node", F.concat(F.lit("n"), (F.col("ord") + 1).cast("string")))


def places(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """Array of (start, end) of non-overlapping matches of a literal, by code points; an empty query has none.

    Pieces between matches and the matches give the places, so a match whose length differs
    from the query's (by case folding) keeps its own.
    """
    if not query:
        return F.array().cast(f"array<{MARK_KIND}>")
    return marks(text, ("" if case_sensitive else "(?iu)") + "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def marks(text: Column, pattern: str) -> Column:
    """Array of (start, end) of non-overlapping matches of a pattern, by code points."""
    return F.transform(match_spans(text, pattern), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))


def search(nodes: DataFrame, query: str, case_sensitive: bool = False, around: int = 60) -> DataFrame:
    """Every hit: doc_id, ord, node, start, end, excerpt. Nodes without the words are dropped before places are computed."""
    holds = F.col("text").contains(query) if case_sensitive else F.lower("text").contains(query.lower())
    if not query.isascii():
        holds = F.lit(True)
    hits = nodes.where(holds).withColumn("m", F.explode(places(F.col("text"), query, case_sensitive)))
    return hits.select("doc_id", "ord", "node", "m.start", "m.end", excerpt(F.col("text"), F.col("m.start"), F.col("m.end"), around).alias("excerpt"))


def first_hits(hits: DataFrame, n: int = SHOWN) -> DataFrame:
    return hits.orderBy("doc_id", "ord", "start").limit(n)


def first_of_each(rows: DataFrame, group: str, *order: Column, n: int = SERVICE) -> DataFrame:
    """The n first rows of each group, with their place. Each task keeps its own first n of a group before they meet, so a group
    that holds most rows is no task of its own."""
    part = W.partitionBy(group, "_part").orderBy(*order)
    own = rows.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= n)
    return own.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n).drop("_part", "_n")


def page(nodes: DataFrame, offset: int = 0, limit: int = 40, budget: int = 14_000) -> DataFrame:
    """Per document: nodes offset to offset + limit until the budget of characters is spent; the last one is cut."""
    w = W.partitionBy("doc_id").orderBy("ord")
    df = nodes.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit))
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_left", F.lit(budget) - before).where("_left > 0")
    cut = F.substring(F.col("text"), F.lit(1), F.col("_left").cast("int"))
    return df.select("doc_id", "ord", "node", cut.alias("text"), (F.length("text") > F.col("_left")).alias("truncated"))


def offsets(nodes: DataFrame) -> DataFrame:
    """Where each node starts in its document: characters of the nodes before it."""
    before = F.sum(F.length("text")).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    return nodes.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def unique_quotes(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Where each quote (quote_id, quote) occurs in exactly one document: quote_id, doc_id."""
    one = quote_pairs(quotes, documents).groupBy("quote_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return one.select("quote_id", "doc_id")


#: Characters of a quote that key its search, and of the pieces that texts of documents are cut into.
KEY_CHARS = 12


def quote_pairs(quotes: DataFrame, documents: DataFrame, key_chars: int = KEY_CHARS) -> DataFrame:
    """Pairs (quote_id, doc_id) where the document holds the quote, character for character.

    Every document is cut into pieces of key_chars characters, one after the other, and only
    their hashes travel. A quote of twice that length or more holds at least one whole piece of
    any text it occurs in, so its own hashes at the first key_chars offsets meet that piece. A
    shorter quote is looked up by its hash at its own length: there each place of a document
    counts, once for each such length that quotes have. What meets is checked on the texts of
    those documents alone.
    """
    known = quotes.where("quote is not null").select("quote_id", "quote", F.length("quote").alias("n"))
    if known.where("n = 0").limit(1).count():
        empty = known.where("n = 0").select("quote_id")
        every = documents.where("text is not null").select("doc_id").withColumn("_one", F.lit(1)).join(F.broadcast(empty.withColumn("_one", F.lit(1))), "_one").select("quote_id", "doc_id")
    else:
        every = None
    cut = lambda c, at, n: F.xxhash64(F.substring(c, at + 1, n))
    long = known.where(f"n >= {2 * key_chars}").select("quote_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(key_chars - 1)), lambda i: cut(F.col("quote"), i, F.lit(key_chars))))).alias("key"))
    words = documents.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{{key_chars}}}"), F.lit(0)), lambda x: F.xxhash64(x)))).alias("key"))
    met = words.join(long, "key").select("quote_id", "doc_id")
    short = known.where(f"n > 0 and n < {2 * key_chars}")
    for (n,) in short.select("n").distinct().collect():  # at most 2 * key_chars lengths
        own = short.where(F.col("n") == n).select("quote_id", F.xxhash64("quote").alias("key"))
        # every place: the pieces of length n that begin at offset 0, 1, ... n - 1
        pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.regexp_extract_all(F.substring(F.col("text"), i + 1, F.length("text")), F.lit(f"(?s).{{{n}}}"), F.lit(0))))
        places = documents.where(F.length("text") >= n).select("doc_id", F.explode(F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))).alias("key"))
        met = met.unionByName(places.join(own, "key").select("quote_id", "doc_id"))
    checked = met.distinct().join(known.select("quote_id", "quote"), "quote_id").join(documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("quote")))
    out = checked.select("quote_id", "doc_id").distinct()
    return out if every is None else out.unionByName(every)
