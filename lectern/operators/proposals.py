"""Proposals for the structure of a section: what is shown of its blocks, and which proposals hold.

A proposal names blocks of one section by number, as JSON. Each is checked by itself, with one reason if it fails; of those that
pass, a proposal counts only if no earlier one of its section that counts has any of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.text import bound, roman_number
from lectern.operators.structure import captioned_runs, contiguous

# The fields of each kind of proposal, and what an alignment may be.
FIELDS = {
    "quote": ("kind", "body", "attribution", "alignment"), "quote_before": ("kind", "body", "attribution", "alignment"), "quote_inline": ("kind", "body", "credit", "alignment"),
    "figure": ("kind", "images", "captions"), "section_heading": ("kind", "block"), "quote_attribution": ("kind", "quote", "attribution", "body_index"),
}
ALIGNMENTS = ("start", "center", "end", "justify")
SCHEMA = "kind string, body array<int>, attribution int, alignment string, credit string, images array<int>, captions array<int>, block int, quote int, body_index int"
# Limits of credits and headings, beginnings that are no credit, words that introduce nothing, and ends that introduce a quote.
MOST_CREDIT, MOST_CREDIT_WORDS, MOST_HEADING = 300, 40, 120
NO_CREDITS = ("someone", "有人")
SENTENCE_WORDS = ("i", "we", "he", "she", "they", "nothing", "this", "that", "it")
NO_SPEAKERS = ("someone", "somebody", "people say", "有人", "研究表明")
SAYING = (" writes", " wrote", " says", " said", " as follows", " the following", " put it", "写道", "说道", "指出", "说")
HEADING_WORDS = ("chapter", "part", "section", "book", "volume", "chap.", "sec.", "vol.")
HEADING_UNITS = ("章", "节", "篇", "部", "卷", "回")
CREDIT_MARKS = ("—", "–", "-", "(", "（", "[", "【")


def is_credit(text: Column) -> Column:
    """Whether a text may say who wrote a quote: short, with letters, no question or call, and no sentence of its own."""
    t = F.trim(text)
    low = F.lower(t)
    fits = F.length(t).between(1, MOST_CREDIT) & (F.size(F.split(t, r"\s+")) <= MOST_CREDIT_WORDS) & t.rlike(r"\p{L}") & (F.translate(t, "?!？！", "") == t)
    vague = F.exists(F.array(*[F.lit(n) for n in NO_CREDITS]), low.startswith)
    marked = F.substring(t, 1, 1).isin(*CREDIT_MARKS)
    sentence = F.right(t, F.lit(1)).isin('"', "”", "’", "」", "』") | (low.contains(" ") & F.substring_index(low, " ", 1).isin(*SENTENCE_WORDS))
    return F.coalesce(fits & ~vague & (marked | ~sentence), F.lit(False))


def introduces(text: Column) -> Column:
    """Whether a text leads to the words of someone that it names."""
    t = F.lower(F.trim(text))
    any_of = lambda words, test: F.exists(F.array(*[F.lit(w) for w in words]), test)
    ends = F.right(t, F.lit(1)).isin(":", "：") | any_of(SAYING, F.rtrim(t, F.lit(".。")).endswith)
    return F.coalesce((F.length(t) >= 4) & ~any_of(NO_SPEAKERS, t.contains) & ends, F.lit(False))


def is_numbered_heading(text: Column) -> Column:
    """Whether a short text is a number, or begins with one as headings do: digits in parts, a word for a division and its number, or
    a Chinese numeral and its unit."""
    t = F.trim(text)
    bracket = F.substring(t, 1, 1).isin("(", "（")
    body = F.when(bracket, F.substring(t, 2, MOST_HEADING)).otherwise(t)

    def digits(lead: Column) -> Column:
        parts = F.split(F.translate(lead, "．", "."), r"\.", -1)
        dotted = F.try_element_at(parts, F.lit(-1)) == ""
        good = F.forall(F.when(dotted, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), lambda p: p.rlike("^[0-9０-９]{1,4}$"))
        after = F.substring(body, F.length(lead) + 1, F.lit(1))
        ends = F.when(bracket, after.isin(")", "）")).otherwise(dotted | (after == "") | after.isin(" ", ")", "）", "、", ":", "：") | after.rlike("[一-鿿]"))
        alone = t.rlike(r"^[1-9][0-9]{0,3}[.)．）]?$")
        return (lead != "") & good & ends & (t.rlike(r"\p{L}") | alone)

    words = F.split(F.lower(t), r"\s+")
    second = F.rtrim(F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")), F.lit(".:：、)）-"))
    named = words[0].isin(*HEADING_WORDS) & (second.rlike("^[0-9０-９]{1,4}(?:[.．][0-9０-９]{1,4})*$") | (roman_number(second).isNotNull() & second.rlike("^[ivxlcdm]+$")))
    numeral = F.regexp_extract(t, "^第([零〇一二三四五六七八九十百千两0-9０-９]+)", 1)
    han = (numeral != "") & F.substring(t, F.length(numeral) + 2, F.lit(1)).isin(*HEADING_UNITS)
    return F.coalesce((F.length(t) <= MOST_HEADING) & (bound(F.regexp_extract(body, "^[0-9０-９.．]*", 0), digits) | named | han), F.lit(False))


def shown(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, ord from 0 without gaps, kind, text, body: texts of a quote, credited) with type: what a proposal may do with
    each, and heading: whether it may become one. Pictures with a caption beside their run are protected."""
    df = captioned_runs(blocks, key, "ord")
    plain = (F.col("kind") == "paragraph") & (F.trim("text") != "")
    kind = (F.when(plain, "paragraph").when(F.col("kind") == "heading", "boundary").when(F.col("kind") == "attribution", "attribution_candidate")
            .when((F.col("kind") == "image") & ~F.col("protected"), "image_needs_caption").when((F.col("kind") == "quote") & ~F.coalesce("credited", F.lit(False)), "quote_missing_attribution").otherwise("protected_boundary"))
    return df.withColumn("type", kind).withColumn("heading", F.coalesce(plain & is_numbered_heading(F.col("text")), F.lit(False))).drop("protected")


def checked(proposals: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """proposals (key, nth, json) with ids (blocks, in order), reason (null if it passes by itself): what is wrong first.

    blocks: what shown() gives. Proposals meet the blocks that they name and those beside, by equality.
    """
    line = W.partitionBy(key).orderBy("ord")
    b = shown(blocks, key).withColumns({"_before": F.lag("kind").over(line), "_after": F.lead("kind").over(line)})
    df = proposals.withColumn("g", F.from_json("json", SCHEMA)).withColumn("_keys", F.json_object_keys("json"))
    kind, g = F.col("g.kind"), F.col("g")
    array = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    one = lambda c: F.array_compact(F.array(c))
    ids = (F.when(kind == "figure", F.concat(array(g["images"]), array(g["captions"]))).when(kind == "section_heading", one(g["block"])).when(kind == "quote_attribution", F.concat(one(g["quote"]), one(g["attribution"])))
           .otherwise(F.concat(array(g["body"]), one(g["attribution"]))))
    df = df.withColumn("ids", F.array_sort(ids))
    wanted = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array_sort(F.array(*[F.lit(f) for f in x])) for pair in FIELDS.items() for x in pair])
    exact = F.coalesce(F.array_sort("_keys") == wanted[kind], F.lit(False))
    named = df.select(key, "nth", F.explode(F.array_distinct("ids")).alias("ord")).join(b.select(key, "ord", F.struct("ord", "type", "heading", "text", "body", "_before", "_after").alias("_b")), [key, "ord"])
    met = named.groupBy(key, "nth").agg(F.sort_array(F.collect_list("_b")).alias("_blocks"))
    df = df.join(met, [key, "nth"], "left").withColumn("_blocks", F.coalesce("_blocks", F.array().cast(met.schema["_blocks"].dataType)))
    of = lambda which: F.filter("_blocks", lambda x: F.array_contains(array(which), x["ord"]))
    at = lambda i: F.get(F.filter("_blocks", lambda x: x["ord"] == i), F.lit(0))
    plain = lambda which: F.forall(of(which), lambda x: x["type"] == "paragraph")
    body, said = array(g["body"]), F.col("g.attribution")
    last, first = F.try_element_at(body, F.lit(-1)), F.try_element_at(body, F.lit(1))
    credit, tail = F.trim("g.credit"), F.trim(at(last)["text"])
    quoted = at(g["quote"])
    inline = (credit != "") & (F.length(tail) > F.length(credit)) & tail.endswith(credit) & is_credit(credit)
    after_quote = (said == g["quote"] + 1) & at(said)["type"].isin("paragraph", "attribution_candidate") & is_credit(at(said)["text"])
    in_quote = (g["body_index"] >= 1) & (g["body_index"] == F.size(quoted["body"]) - 1) & is_credit(F.get(quoted["body"], g["body_index"]))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    texts = kind.isin("quote", "quote_before", "quote_inline")
    reason = (F.when(g.isNull() | F.col("_keys").isNull(), "unreadable").when(no(kind.isin(*FIELDS)), "unknown kind").when(~exact, "fields").when(no(contiguous(F.col("ids"))), "not side by side")
              .when(F.size("_blocks") < F.size("ids"), "no such block").when(F.array_contains("_keys", "alignment") & g["alignment"].isNotNull() & ~g["alignment"].isin(*ALIGNMENTS), "alignment")
              .when((kind == "section_heading") & no(F.get("_blocks", F.lit(0))["heading"]), "no heading")
              .when((kind == "figure") & no(contiguous(array(g["images"])) & contiguous(array(g["captions"]))), "not side by side")
              .when((kind == "figure") & no(F.forall(of(g["images"]), lambda x: x["type"] == "image_needs_caption") & plain(g["captions"])), "wrong blocks")
              .when((kind == "figure") & ((at(F.array_min(g["images"]))["_before"].eqNullSafe("image")) | at(F.array_max(g["images"]))["_after"].eqNullSafe("image")), "part of a run")
              .when((kind == "quote_attribution") & no(quoted["type"] == "quote_missing_attribution"), "wrong blocks").when((kind == "quote_attribution") & (said.isNull() == g["body_index"].isNull()), "fields")
              .when((kind == "quote_attribution") & no(F.when(said.isNotNull(), after_quote).otherwise(in_quote)), "no credit")
              .when(texts & no(contiguous(body)), "not side by side").when(texts & no(plain(body)), "wrong blocks").when((kind == "quote_inline") & no(inline), "no credit")
              .when(kind.isin("quote", "quote_before") & no(at(said)["type"] == "paragraph"), "wrong blocks").when((kind == "quote") & no((said == last + 1) & is_credit(at(said)["text"])), "no credit")
              .when((kind == "quote_before") & no((said == first - 1) & introduces(at(said)["text"])), "no introduction"))
    return df.withColumn("reason", reason).select(*proposals.columns, "ids", "reason")


def accepted(proposals: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """checked(), with `taken` as the reason of those whose blocks an earlier proposal that counts has."""
    every = checked(proposals, blocks, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("nth", "json", "ids", "reason"))).alias("p"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        clash = F.arrays_overlap(s["used"], x["ids"])
        use = x["reason"].isNull() & ~clash
        return F.struct(F.when(use, F.concat(s["used"], x["ids"])).otherwise(s["used"]).alias("used"), F.when(x["reason"].isNull() & clash, F.array_append(s["taken"], x["nth"])).otherwise(s["taken"]).alias("taken"))

    told = every.withColumn("_taken", F.aggregate("p", start, step, lambda s: s["taken"]))
    out = told.select(key, "_taken", F.inline("p"))
    return out.select(key, "nth", "json", "ids", F.when(F.array_contains("_taken", F.col("nth")), "taken").otherwise(F.col("reason")).alias("reason"))


def annotated(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Runs (key, run, text, mark) of texts (key, text) with inline spans (key, nth, start, end, text, mark) applied.

    A span stands where it says if the text there is its own, else where its text occurs once; others are left out. Of spans
    that overlap the one that begins first counts, of equals the earlier.
    """
    met = spans.join(texts.select(key, F.col("text").alias("_t")), key)
    here = F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    once = (F.length("_t") - F.length(F.replace(F.col("_t"), F.col("text"), F.lit("")))) == F.length("text")
    found = F.when(here, F.col("start")).when(once & (F.col("text") != ""), F.instr(F.col("_t"), F.col("text")) - 1)
    held = met.withColumn("_a", found).where("_a is not null and text <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("_a").alias("a"), "nth", (F.col("_a") + F.length("text")).alias("z"), "mark"))).alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,z:int,mark:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.struct(x["a"].alias("a"), x["z"].alias("z"), x["mark"].alias("mark"))
        return F.when(x["a"] >= s["end"], F.struct(x["z"].alias("end"), F.array_append(s["out"], new).alias("out"))).otherwise(s)

    df = texts.select(key, "text").join(held, key, "left").withColumn("m", F.coalesce(F.aggregate("s", start, step, lambda s: s["out"]), F.array().cast("array<struct<a:int,z:int,mark:string>>")))
    # what lies between the spans, and the spans
    edges = F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit(None).cast("string").alias("mark"))), "m")
    nexts = F.concat(F.transform("m", lambda x: x["a"]), F.array(F.length("text")))
    pieces = F.flatten(F.zip_with(edges, nexts, lambda e, n: F.array(
        F.struct(F.substring(F.col("text"), e["a"] + 1, e["z"] - e["a"]).alias("text"), e["mark"].alias("mark")), F.struct(F.substring(F.col("text"), e["z"] + 1, n - e["z"]).alias("text"), F.lit(None).cast("string").alias("mark")))))
    return df.select(key, F.posexplode_outer(F.filter(pieces, lambda p: p["text"] != "")).alias("run", "_p")).where("_p is not null").select(key, "run", "_p.text", "_p.mark")
