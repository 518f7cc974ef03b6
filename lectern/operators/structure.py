"""Order inside sections: reading units, picture runs, indents, table grids, promoted headings, contiguous groups, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.text import heading_key, ordinal
from lectern.operators.spread import parts

#: Blocks at the start of a section in which a heading without an anchor is sought, indents that count as one, and spans of a table's cell.
SOUGHT, SAME_INDENT, MOST_SPAN = 8, 4.0, 64
#: Elements and rules of a cascade that one task matches.
TASK_RULES = 200_000

# Words of a heading's label that are not its number.
DIVISIONS = ("chapter", "part", "book")
# First words of lines that are no prose (`#` up to six times, numbers with one of NUMBER_ENDS), beginnings of such
# lines, and what no prose holds.
HEADING_MARK, LIST_MARKS, NUMBER_ENDS = "#", ("-", "*", "+"), (".", ")")
LINE_BEGINNINGS, HELD = (">", "```", "|"), ("![", "<", "$$")
# Ends of sentences, what closes after them, and hyphens.
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？", "；", ";", ":")
CLOSING = ("”", "’", '"', "'", ")", "）", "]", "】")
HYPHENS = ("-", "‐", "‑", "\u00ad")
# Marks of notes, what may stand around one, most marks of one, the share of the text's size up to which a run is small.
NOTE_MARKS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "*", "†", "‡", "§")
AROUND_MARKS = ("[", "]", "(", ")", "（", "）", "【", "】", ".")
MOST_MARKS, SMALL = 8, 0.85


def reading_units(blocks: DataFrame, key: str, order: str, boundary: Column, content: Column) -> DataFrame:
    """blocks with unit: a boundary starts a new one unless nothing but headings lies between it and the boundary before."""
    line = W.partitionBy(key).orderBy(order)
    df = blocks.withColumn("_b", F.coalesce(boundary, F.lit(False)) | (F.row_number().over(line) == 1)).withColumn("_part", F.sum(F.col("_b").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_some", F.max(F.coalesce(content, F.lit(False)).cast("int")).over(W.partitionBy(key, "_part")))
    starts = F.col("_b") & (F.col("_part").eqNullSafe(1) | (F.lag("_some").over(line) == 1))
    return df.withColumn("_s", starts.cast("int")).withColumn("unit", F.sum("_s").over(line.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_b", "_part", "_some", "_s")


def captioned_runs(blocks: DataFrame, key: str, order: str, kind: str = "kind") -> DataFrame:
    """blocks with protected: pictures of a run that a caption precedes or follows."""
    line = W.partitionBy(key).orderBy(order)
    picture = F.col(kind) == "image"
    new = F.when(picture & F.coalesce(F.lag(kind).over(line) == "image", F.lit(False)), 0).otherwise(1)
    df = blocks.withColumn("_new", new).withColumn("_run", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    beside = F.coalesce(F.lag(kind).over(line) == "caption", F.lit(False)) | F.coalesce(F.lead(kind).over(line) == "caption", F.lit(False))
    df = df.withColumn("_beside", beside).withColumn("protected", picture & (F.max((picture & F.col("_beside")).cast("int")).over(W.partitionBy(key, "_run")) == 1))
    return df.drop("_new", "_run", "_beside")


def contiguous(ids: Column) -> Column:
    """Whether an array of whole numbers goes up by one at every step."""
    after = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), after, lambda a, b: b - a)
    return (F.size(ids) > 0) & F.forall(steps, lambda d: d == 1)


def composed_groups(groups: DataFrame, displayed: DataFrame, key: str) -> DataFrame:
    """Groups (key, group, source) whose blocks (key, source, position) all exist and lie side by side: first and last position."""
    met = groups.join(displayed.select(key, "source", "position"), [key, "source"], "left")
    out = met.groupBy(key, "group").agg(
        F.count_if(F.col("position").isNull()).alias("_missing"), F.min("position").alias("first"), F.max("position").alias("last"), F.count("position").alias("_n"), F.countDistinct("position").alias("_d"))
    return out.where("_missing = 0 and _n > 0 and _n = _d and last - first + 1 = _n").select(key, "group", "first", "last")


def indent_bins(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with bin: in order of value a new bin starts more than SAME_INDENT beyond the one that began the last.

    Values differ by bins of a section only, so the different ones of a key are folded in one array.
    """
    kind = "array<struct<value:double,bin:int>>"
    start = F.struct(F.lit(None).cast("double").alias("head"), F.lit(-1).alias("bin"), F.array().cast(kind).alias("out"))

    def put(s: Column, v: Column) -> Column:
        new = s["head"].isNull() | (v - s["head"] > SAME_INDENT)
        bin_ = F.when(new, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(F.when(new, v).otherwise(s["head"]).alias("head"), bin_.alias("bin"), F.array_append(s["out"], F.struct(v.alias("value"), bin_.alias("bin"))).alias("out"))

    levels = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.col(value).cast("double"))).alias("v"))
    bins = levels.select(F.col(key).alias("_k"), F.inline(F.aggregate("v", start, put, lambda s: s["out"])).alias("_v", "bin"))
    return rows.join(bins, (F.col(key) == F.col("_k")) & (F.col(value).cast("double") == F.col("_v"))).drop("_k", "_v")


def list_depths(indents: Column) -> Column:
    """Depth of each item of a list from its indent: a deeper one opens a level, a known one closes those below it, a lesser
    one goes under the last that is smaller."""
    start = F.struct(F.array().cast("array<double>").alias("stack"), F.array().cast("array<int>").alias("out"))

    def last_where(stack: Column, test) -> Column:
        """Levels up to the last that passes the test; none if no level does."""
        places = F.filter(F.transform(stack, lambda x, i: F.when(test(x), i + 1).otherwise(0)), lambda p: p > 0)
        return F.coalesce(F.array_max(places), F.lit(0))

    def step(s: Column, v: Column) -> Column:
        stack = s["stack"]
        deeper = (F.size(stack) == 0) | (v > F.try_element_at(stack, F.lit(-1)) + SAME_INDENT)
        known, under = last_where(stack, lambda x: F.abs(v - x) <= SAME_INDENT), last_where(stack, lambda x: x < v)
        new = F.when(deeper, F.array_append(stack, v)).when(known > 0, F.slice(stack, F.lit(1), known)).otherwise(F.array_append(F.slice(stack, F.lit(1), under), v))
        return F.struct(new.alias("stack"), F.array_append(s["out"], F.size(new) - 1).alias("out"))

    return F.aggregate(F.transform(indents, lambda x: x.cast("double")), start, step, lambda s: s["out"])


def numbered_label(label: Column) -> tuple[Column, Column]:
    """Number and title of a heading's label such as "Part Two: The sea": its words, but for one that names the division, are
    a number and a title. Both are empty if there are fewer than two."""
    words = F.filter(F.split(label, "[^\\p{L}\\p{M}\\p{N}\\p{S}'’]+"), lambda w: w != "")
    words = F.when(F.lower(F.try_element_at(words, F.lit(1))).isin(*DIVISIONS), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    two = F.size(words) > 1
    return F.when(two, words[0]).otherwise(""), F.when(two, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise("")


def promoted_headings(blocks: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Blocks (key, ord, text) that a hint (key, hint, label, level, anchor) makes headings: ord, level, hint.

    A hint with an anchor looks at the block there and its neighbours, one without at the first
    of its section. Its label must be a block's text, or a number and the title after it; a hint
    with more than one match is left out.
    """
    line = W.partitionBy(key).orderBy("ord")
    b = blocks.select(key, "ord", heading_key(F.col("text")).alias("_key"), ordinal(F.col("text")).alias("_ordinal"), heading_key(F.lead("text").over(line)).alias("_next"), (F.row_number().over(line) - 1).alias("_at"))
    number, title = numbered_label(F.col("label"))
    h = hints.select(key, "hint", "level", "anchor", heading_key(F.col("label")).alias("_label"), heading_key(number).alias("_number"), heading_key(title).alias("_title"))
    anchored = h.join(b.select(key, F.col("ord").alias("anchor"), F.col("_at").alias("_where")), [key, "anchor"], "left")
    near = anchored.withColumn("_at", F.explode(F.when(F.col("_where").isNotNull(), F.sequence(F.col("_where") - 1, F.col("_where") + 1)).otherwise(F.sequence(F.lit(0), F.lit(SOUGHT - 1)))))
    met = near.join(b, [key, "_at"])
    whole = F.col("_key") == F.col("_label")
    pair = F.coalesce(F.col("_ordinal").isNotNull() & F.col("_next").isNotNull() & (
        (F.concat("_key", "_next") == F.col("_label")) | ((F.col("_ordinal") == F.col("_number")) & (F.col("_next") == F.col("_title")) & (F.col("_number") != ""))), F.lit(False))
    found = met.where(whole | pair).withColumn("_n", F.count("*").over(W.partitionBy(key, "hint"))).where("_n = 1")
    found = found.withColumn("ord", F.explode(F.when(whole, F.array("_at")).otherwise(F.array("_at", F.col("_at") + 1))))
    at = b.select(key, F.col("_at").alias("_place"), F.col("ord").alias("_ord"))
    return found.select(key, "hint", "level", F.col("ord").alias("_place")).join(at, [key, "_place"]).select(key, F.col("_ord").alias("ord"), "level", "hint")


def specificity(id_: Column, classes: Column, tag: Column) -> Column:
    return F.when(id_.isNotNull(), 100).otherwise(0) + F.size(classes) * 10 + F.when(tag.isNotNull(), 1).otherwise(0)


def cascaded(elements: DataFrame, rules: DataFrame, key: str = "element") -> DataFrame:
    """The value of each property (element, property, value) that the rules give the elements (tag, id, classes).

    A rule (tag, id, classes, order, property, value) is filed under the rarest thing it asks
    for, its id, else a class, else its tag, so rules and elements meet by equality; what else
    it asks for is checked on those pairs. The most specific rule wins, of equals the later.
    Tasks grow in number with elements and rules.
    """
    n = parts(elements.select(key).unionByName(rules.select(F.col("order").alias(key))), F.lit(1), TASK_RULES)
    mark = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    filed = rules.select("*", F.coalesce(mark("id", F.col("id")), mark("class", F.try_element_at("classes", F.lit(1))), mark("tag", F.col("tag"))).alias("_file"), specificity(F.col("id"), F.col("classes"), F.col("tag")).alias("_s"))
    filed = filed.select("_file", F.col("tag").alias("_tag"), F.col("id").alias("_id"), F.col("classes").alias("_classes"), "_s", "order", "property", "value").repartition(n, "_file")
    files = F.concat(F.array(mark("id", F.col("id")), mark("tag", F.col("tag"))), F.transform(F.array_distinct("classes"), lambda c: mark("class", c)))
    met = elements.select(key, "tag", "id", "classes", F.explode(F.array_compact(files)).alias("_file")).repartition(n, "_file").join(filed, "_file")
    fits = (F.col("_tag").isNull() | (F.col("_tag") == F.col("tag"))) & (F.col("_id").isNull() | (F.col("_id") == F.col("id"))) & (F.size(F.array_except("_classes", "classes")) == 0)
    return met.where(fits).select(key, "property", "value", "_s", "order").repartition(n, key).groupBy(key, "property").agg(F.max_by("value", F.struct("_s", "order")).alias("value"))


def is_prose(paragraph: Column) -> Column:
    """No line begins as a heading, an item of a list, a quote, code or a row of a table does, and nothing stands for a picture,
    markup or a formula."""
    def other(line: Column) -> Column:
        first = F.regexp_extract(line, r"^\S+", 0)
        alone = F.length(line) > F.length(first)
        hashes = F.length(first).between(1, 6) & (F.translate(first, HEADING_MARK, "") == "")
        number = F.right(first, F.lit(1)).isin(*NUMBER_ENDS) & F.substring(first, F.lit(1), F.length(first) - 1).rlike("^[0-9]+$")
        begins = F.exists(F.array(*[F.lit(b) for b in LINE_BEGINNINGS]), line.startswith)
        return (alone & (hashes | first.isin(*LIST_MARKS) | number)) | begins

    return (paragraph != "") & ~F.exists(F.split(paragraph, "\n"), other) & ~F.exists(F.array(*[F.lit(h) for h in HELD]), paragraph.contains)


def joining_score(tail: Column, head: Column) -> Column:
    """How far the end of one page and the beginning of the next speak for one paragraph (above 0) or against it.

    An open end speaks for it, a hyphen most of all; the end of a sentence speaks against it, but a full stop may belong to an
    abbreviation if what follows goes on in lower case.
    """
    closed = F.rtrim(tail, F.lit("".join(CLOSING)))
    hyphen, ended = F.right(tail, F.lit(1)).isin(*HYPHENS), F.right(closed, F.lit(1)).isin(*SENTENCE_ENDS)
    short = (F.right(closed, F.lit(1)) == SENTENCE_ENDS[0]) & F.substring(head, 1, 1).between("a", "z")
    return F.lit(1) + F.when(hyphen, 4).otherwise(0) - F.when(ended, 2).otherwise(0) + F.when(ended & short, 2).otherwise(0)


def joined_pages(pages: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """pages with text in which a paragraph that a page break cuts is whole again: the first paragraph of a page moves to
    the end of the page before it, if both are prose and the earlier one does not end a sentence.

    A page whose only paragraph has moved away has nothing that the next could join, so along a run of such pages every
    second join happens.
    """
    line = W.partitionBy(key).orderBy(page)
    df = pages.withColumn("_p", F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n\s*\n"))
    df = df.withColumns({"_tail": F.element_at("_p", -1), "_head": F.lead(F.col("_p")[0]).over(line), "_one": F.size("_p") == 1})

    can = F.coalesce(is_prose(F.col("_tail")) & is_prose(F.col("_head")) & (joining_score(F.col("_tail"), F.col("_head")) > 0), F.lit(False))
    hyphen = F.right(F.col("_tail"), F.lit(1)).isin(*HYPHENS)
    df = df.withColumn("_can", can)
    before = F.coalesce(F.lag("_can").over(line), F.lit(False))
    df = df.withColumn("_starts", (~(F.col("_one") & before)).cast("int")).withColumn("_run", F.sum("_starts").over(line.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(key, "_run").orderBy(page))
    df = df.withColumn("_joins", F.col("_can") & (place % 2 == 1)).withColumn("_lost", F.coalesce(F.lag("_joins").over(line), F.lit(False)))
    space = F.when(F.col("_tail").rlike("[A-Za-z0-9]$") & F.col("_head").rlike("^[A-Za-z0-9]"), " ").otherwise("")
    whole = F.when(hyphen, F.concat(F.substring("_tail", F.lit(1), F.length("_tail") - 1), F.col("_head"))).otherwise(F.concat("_tail", space, "_head"))
    kept = F.when(F.col("_lost"), F.slice("_p", F.lit(2), F.size("_p"))).otherwise(F.col("_p"))
    new = F.when(F.col("_joins"), F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(whole))).otherwise(kept)
    return df.withColumn(text, F.array_join(new, "\n\n")).drop("_p", "_tail", "_head", "_one", "_can", "_starts", "_run", "_joins", "_lost")


def markdown_blocks(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, kind, level, text of the blocks of plain Markdown: headings, list items, quotes, fenced code, paragraphs."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    line = W.partitionBy(key).orderBy("at")
    fence = F.col("line").rlike(r"^\s*```")
    df = lines.withColumn("_f", F.sum(fence.cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("_fence", fence)
    code = (F.col("_f") % 2 == 1) | F.col("_fence")
    heading, item, quote = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1), F.col("line").rlike(r"^\s*(?:[-*+]|[0-9]+[.)])\s+\S"), F.col("line").rlike(r"^\s*>")
    df = df.withColumn("kind", F.when(code, "code").when(heading != "", "heading").when(item, "item").when(quote, "quote").when(F.trim("line") == "", "blank").otherwise("paragraph"))
    df = df.withColumn("level", F.when(F.col("kind") == "heading", F.length(heading)))
    alone = F.col("kind").isin("heading", "item", "blank") | (F.col("kind") != F.lag("kind").over(line)) | F.lag("kind").over(line).isNull()
    # lines without a mark after an item go on with it
    goes_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(line) == "item")
    df = df.withColumn("_new", (alone & ~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_b", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    bare = (F.when(F.col("kind") == "heading", F.regexp_replace("line", r"^#+\s+|\s*#*\s*$", "")).when(F.col("kind") == "item", F.regexp_replace("line", r"^\s*(?:[-*+]|[0-9]+[.)])\s+", ""))
            .when(F.col("kind") == "quote", F.regexp_replace("line", r"^\s*>\s?", "")).otherwise(F.col("line")))
    df = df.where("kind <> 'blank' and not _fence").withColumn("_t", bare)
    out = df.groupBy(key, "_b").agg(F.min_by("kind", "at").alias("kind"), F.min_by("level", "at").alias("level"), F.sort_array(F.collect_list(F.struct("at", "_t"))).alias("_l"))
    joined = F.when(F.col("kind") == "code", F.array_join(F.transform("_l", lambda x: x["_t"]), "\n")).otherwise(F.trim(F.array_join(F.transform("_l", lambda x: F.trim(x["_t"])), " ")))
    out = out.withColumn("text", joined).withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("_b")) - 1)
    return out.select(key, "ord", "kind", "level", "text")


def marked_references(runs: Column, paths: Column) -> Column:
    """Runs (text, link, scale, raised, role) of which those become note references that point into a section of notes, are
    small or raised, and hold nothing but a mark."""
    def one(r: Column) -> Column:
        # one unbroken run of marks once everything that may stand around it is a blank
        runs_ = F.filter(F.split(F.translate(r["text"], "".join(AROUND_MARKS), " " * len(AROUND_MARKS)), r"\s+"), lambda x: x != "")
        is_mark = (F.size(runs_) == 1) & (F.length(runs_[0]) <= MOST_MARKS) & F.forall(F.split(runs_[0], ""), lambda c: c.isin(*NOTE_MARKS))
        notes = r["link"].contains("#") & F.array_contains(paths, F.substring_index(r["link"], "#", 1)) & (r["role"] == "normal") & ((r["scale"] <= SMALL) | r["raised"]) & is_mark
        return r.withField("role", F.when(F.coalesce(notes, F.lit(False)), "note").otherwise(r["role"]))

    return F.transform(runs, one)


def style_ratios(runs: DataFrame, *key: str) -> DataFrame:
    """key, bold, italic and size: shares of bold and italic characters and the mean size of runs (text, bold, italic, size),
    weighed by characters that are no white space; 0 where there are none. Null flags are false, a null size is 1."""
    n = F.coalesce(F.length(F.regexp_replace("text", r"\s", "")), F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum(n)), F.lit(0.0))
    marked = lambda name: F.when(F.coalesce(name, F.lit(False)), n).otherwise(0)
    return runs.groupBy(*key).agg(share(marked("bold")).alias("bold"), share(marked("italic")).alias("italic"), share(n * F.coalesce("size", F.lit(1.0))).alias("size"))
