"""Page lines, grid lines, quotes that move, and answers of models: small ordered passes as windows and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Height of a line that counts as a heading, in medians of its page, and its characters at most.
HEADING_RATIO, HEADING_CHARS = 1.3, 160
#: Height assumed for a page whose lines have none.
PLAIN_HEIGHT = 12.0
SPACES = r"[\s\xA0]+"


def middle(values: Column) -> Column:
    """The element at half the length of the sorted array (the upper one of two); null if it is empty."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def page_headings(lines: DataFrame, page: str, height: Column, text: Column) -> DataFrame:
    """lines with median (the middle positive height of the page) and heading: taller than that by the ratio, and short."""
    tall = lines.withColumn("_h", height)
    medians = tall.groupBy(page).agg(F.coalesce(middle(F.collect_list(F.when(F.col("_h") > 0, F.col("_h")))), F.lit(PLAIN_HEIGHT)).alias("median"))
    return tall.join(medians, page).withColumn("heading", (F.col("_h") > F.col("median") * HEADING_RATIO) & (F.length(text) < HEADING_CHARS)).drop("_h")


def merged_lines(pieces: DataFrame, key: str, start: str, end: str, tolerance: float) -> DataFrame:
    """key, start, end: pieces of a line that overlap or leave a gap of at most the tolerance become one."""
    line = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(line.rowsBetween(W.unboundedPreceding, -1))
    df = pieces.withColumn("_new", F.when(F.col(start) <= reach + tolerance, 0).otherwise(1))
    df = df.withColumn("_part", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(key, "_part").agg(F.min(start).alias("start"), F.max(end).alias("end")).select(key, "start", "end")


def tolerant_json(text: Column) -> Column:
    """From the first brace to the last, with commas before a closing bracket left out; text in quotes stays. Null without braces."""
    inside = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(inside, r'(?s)("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1"), F.lit(""))


def spread_groups(sections: DataFrame, key: str, order: str, quote: Column, text: Column) -> DataFrame:
    """sections with continued (its quote stands in the section before it) and spread: the number of its group.

    Texts are compared without white space and in lower case; an empty quote continues nothing.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), SPACES, "")
    line = W.partitionBy(key).orderBy(order)
    df = sections.withColumns({"_q": plain(quote), "_t": plain(text)})
    held = (F.col("_q") != "") & F.lag("_t").over(line).contains(F.col("_q"))
    df = df.withColumn("continued", F.coalesce(held, F.lit(False))).drop("_q", "_t")
    return df.withColumn("spread", F.sum(F.when(F.col("continued"), 0).otherwise(1)).over(line.rowsBetween(W.unboundedPreceding, 0)))


def reanchored(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node, start, end: where each annotation (id, doc_id, node, start, end, quote) stands now.

    Its own place if the text there still equals the quote but for white space; else the only
    place of its document that holds the quote; else nothing. The quote is searched only in
    nodes of the annotation's own document.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(c, SPACES, " "))
    own = annotations.join(nodes.select("doc_id", "node", F.col("text").alias("_text")), ["doc_id", "node"], "left")
    cut = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    own = own.withColumn("_same", F.coalesce(squeezed(cut) == squeezed(F.col("quote")), F.lit(False)))
    fixed = own.where("_same").select("id", "node", "start", "end")
    lost = own.where("not _same and quote <> ''").select("id", "doc_id", "quote")
    near = lost.join(nodes.select("doc_id", "node", "text"), "doc_id").where(F.lower("text").contains(F.lower("quote")))
    lowered, sought = F.lower("text"), F.lower("quote")
    first = F.position(sought, lowered)
    found = near.select("id", "node", (first - 1).alias("start"), (first - 1 + F.length("quote")).alias("end"), (F.position(sought, lowered, first + F.length("quote")) > 0).alias("_again"))
    once = found.groupBy("id").agg(F.count("*").alias("_n"), F.bool_or("_again").alias("_again"), F.min(F.struct("node", "start", "end")).alias("p"))
    return fixed.unionByName(once.where("_n = 1 and not _again").select("id", "p.node", "p.start", "p.end"))


def overlaid(blocks: DataFrame, translations: DataFrame, keys: list[str], bilingual: bool = False) -> DataFrame:
    """blocks (keys, text) with the translation's text in place of their own; bilingual: both, the original first (layer 0, 1)."""
    given = translations.select(*keys, F.col("text").alias("_new"))
    both = blocks.join(given, keys, "left")
    if not bilingual:
        return both.withColumn("text", F.coalesce("_new", "text")).drop("_new")
    layers = F.array_compact(F.array(F.struct(F.lit(0).alias("layer"), F.col("text").alias("t")), F.when(F.col("_new").isNotNull(), F.struct(F.lit(1).alias("layer"), F.col("_new").alias("t")))))
    return both.withColumn("_l", F.explode(layers)).withColumns({"text": F.col("_l.t"), "layer": F.col("_l.layer")}).drop("_l", "_new")


def described(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images (image, refs: names divided by spaces) with the block (name, block) that one of the names stands for, if it describes no other image."""
    tokens = images.select("image", F.explode(F.array_distinct(F.filter(F.split("refs", r"\s+"), lambda t: t != ""))).alias("name"))
    pairs = tokens.join(blocks.select("name", "block"), "name").select("image", "block").distinct()
    owners = F.count("*").over(W.partitionBy("block"))
    return pairs.withColumn("_n", owners).where("_n = 1").select("image", "block")
