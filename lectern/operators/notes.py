"""Annotations, notes, sources and glossaries: filters, joins and small ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.text import normalized

#: Annotations that a search gives, links that an answer keeps, and terms added at once, looked at, and kept in all.
FOUND, SOURCES, ADDED, PROPOSED, KEPT_TERMS = 30, 30, 8, 32, 2000
#: Entries of a contents list that are given, and of one that is discovered.
TOC_GIVEN, TOC_FOUND = 128, 512
# What a section of notes is called.
NOTE_TITLES = ("footnote", "footnotes", "endnote", "endnotes", "note", "notes", "脚注", "尾注", "注释", "注解")


def search_annotations(annotations: DataFrame, query: str, order: str, spine: int | None = None, most: int = FOUND) -> DataFrame:
    """The first annotations (quote, note, spines) whose quote or note holds the query, whatever its case; in one section if asked."""
    held = F.lower(F.concat(F.col("quote"), F.lit(" "), F.coalesce("note", F.lit("")))).contains(query.lower())
    inside = F.lit(True) if spine is None else F.array_contains("spines", spine)
    return annotations.where(held & inside).orderBy(order).limit(most)


def annotation_counts(annotations: DataFrame, *keys: str) -> DataFrame:
    """All annotations, and those with a note that is not blank."""
    return annotations.groupBy(*keys).agg(F.count("*").alias("annotations"), F.count_if(F.coalesce(F.trim("note") != "", F.lit(False))).alias("notes"))


def own_visible(annotations: DataFrame, device: Column | None = None) -> DataFrame:
    """Annotations that are not deleted; of one device if given."""
    shown = annotations.where("not deleted")
    return shown if device is None else shown.where(F.col("device") == device)


def is_note_title(label: Column) -> Column:
    """Whether a contents entry is called notes, perhaps with a number."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(label)), r"[\s.,:;!?，。！？：；、·—_-]+", " "))
    return bare.rlike("^(?:" + "|".join(NOTE_TITLES) + r")(?: [0-9]+)?$")


def note_sections(toc: DataFrame) -> DataFrame:
    """Sections (book, spine) that contents entries without a fragment call notes."""
    return toc.where(F.col("spine").isNotNull() & ~F.col("href").contains("#") & is_note_title(F.col("label"))).select("book", "spine").distinct()


def definitions(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (href) with the text of what they point at: path and fragment both equal, the text not blank."""
    path, fragment = F.substring_index("href", "#", 1), F.regexp_extract("href", "#(.+)$", 1)
    asked = references.where(F.col("href").contains("#")).withColumns({"path": path, "fragment": fragment}).where("fragment <> ''")
    first = anchors.groupBy("path", "fragment").agg(F.min_by("text", "ord").alias("definition"))
    return asked.join(first, ["path", "fragment"]).where(F.trim("definition") != "").drop("path", "fragment")


def reference_notes(links: DataFrame, scope: str, order: str, number: str) -> DataFrame:
    """Links of a scope in order; of those that share a number other than 0 the first."""
    first = F.row_number().over(W.partitionBy(scope, number).orderBy(order)) == 1
    return links.withColumn("_first", first).where(F.col("_first") | (F.col(number) == 0)).drop("_first")


def citation_ids(candidates: DataFrame, block: str, paragraph: str, order: str) -> DataFrame:
    """candidates with ordinal (from 0 in their paragraph) and wire_id."""
    n = F.row_number().over(W.partitionBy(block, paragraph).orderBy(order)) - 1
    return candidates.withColumn("ordinal", n).withColumn("wire_id", F.concat(F.lit("c"), F.col(block).cast("string"), F.lit("_"), F.col(paragraph).cast("string"), F.lit("_"), F.col("ordinal").cast("string")))


def merged_sources(sources: DataFrame, key: str, order: str, most: int = SOURCES) -> DataFrame:
    """The first source of each url (key, order, url), at most `most` of a key, in order."""
    first = sources.groupBy(key, "url").agg(F.min(order).alias(order))
    return first.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def merged_glossary(known: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """Terms to add: of the first proposals (ord, source, target, held) those that the texts hold and that are not known,
    one of each normalised source, at most ADDED, while the glossary has room."""
    worth = proposed.where(F.col("held") & (F.col("ord") < PROPOSED) & (F.trim("source") != "") & (F.trim("target") != "")).withColumn("_s", normalized(F.col("source")))
    old = known.select(key, normalized(F.col("source")).alias("_s")).distinct()
    sizes = known.groupBy(key).agg(F.count("*").alias("_known"))
    new = worth.join(old, [key, "_s"], "left_anti").withColumn("_first", F.row_number().over(W.partitionBy(key, "_s").orderBy("ord"))).where("_first = 1")
    ranked = new.join(sizes, key, "left").withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ord")))
    room = F.least(F.lit(ADDED), F.lit(KEPT_TERMS) - F.coalesce("_known", F.lit(0)))
    return ranked.where(F.col("_n") <= room).select(key, "ord", F.trim("source").alias("source"), F.trim("target").alias("target"))


def discovered_toc(entries: DataFrame, key: str, pages: str, most: int = TOC_FOUND) -> DataFrame:
    """Valid entries (ord, title, page, depth), the first of each page and title, with their place by page."""
    ok = F.col("page").between(1, F.col(pages)) & F.col("depth").between(0, 64) & (F.trim("title") != "") & (F.length("title") <= 500)
    kept = entries.where(ok).withColumn("_first", F.row_number().over(W.partitionBy(key, "page", "title").orderBy("ord"))).where("_first = 1")
    placed = kept.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("page", "ord")))
    return placed.where(F.col("place") <= most).drop("_first")


def search_batches(hits: DataFrame, section: str, most: int = 200) -> DataFrame:
    """Hits of each section while fewer than `most` came before: what a search gives out, batch after batch, until it stops."""
    counts = hits.groupBy(section).agg(F.count("*").alias("hits"))
    # prefix sums in two steps: sums of ranges of sections, then inside a range, so no task orders all sections
    width = 4096
    ranged = counts.withColumn("_range", F.floor(F.col(section) / width))
    sums = ranged.groupBy("_range").agg(F.sum("hits").alias("_sum"))
    offsets = sums.withColumn("_offset", F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).where(F.col("_offset") < most)  # one row per range
    inside = F.sum("hits").over(W.partitionBy("_range").orderBy(section)) - F.col("hits")
    return ranged.join(offsets.select("_range", "_offset"), "_range").withColumn("before", F.col("_offset") + inside).where(F.col("before") < most).select(section, "hits", "before")
