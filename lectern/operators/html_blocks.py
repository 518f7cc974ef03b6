"""HTML sections as ordered blocks, by columns and windows: tokens, regions, boundaries, grouping.

A page becomes token rows (tags, text). Running sums mark what lies in a link or in bold
and where blocks begin: at every start and end tag of a block element, which also ends
paragraphs that were left open. Text of a block is joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.text import resolved_href
from lectern.operators.spread import spread

#: Characters of pages whose tokens one task sorts.
TASK_CHARS = 2_000_000

# Elements that produce nothing, and elements that bound blocks.
SKIPPED = ("script", "style", "head", "nav", "title", "template", "noscript")
BLOCKS = tuple("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Named characters that occur in books.
NAMED = {"nbsp": "\xa0", "copy": "©", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "shy": "\xad", "apos": "'", "quot": '"', "lt": "<", "gt": ">"}
TOKEN = r"""(?s)<!--.*?-->|<[!?/A-Za-z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>|[^<]+|<"""


def decoded_entities(text: Column) -> Column:
    """Named and numbered character references as characters; unknown ones stay."""
    out = text
    for name, c in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    out = F.when(out.contains("&#"), _characters(out)).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _characters(text: Column) -> Column:
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#[xX]?[0-9A-Fa-f]{1,6};"), F.lit(0)))

    def put(out: Column, m: Column) -> Column:
        hexadecimal = m.rlike("^&#[xX]")
        code = F.when(hexadecimal, F.conv(F.regexp_extract(m, "([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(m, "^&#([0-9]+);$", 1)).try_cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.replace(out, m, F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), wide).otherwise(m))

    return F.aggregate(refs, text, put)


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_chars: int | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """id, ord, token, tag (lower case, null for text), closing. Skipped elements and comments are left out.

    most_chars: pages of more characters give no rows (2 * 1024 * 1024 is a usual limit of readers); none by default.
    """
    html, bare = F.col(html_col), F.col("_html")
    for name in skipped:
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    kept = bare if most_chars is None else F.when(F.length("_html") <= most_chars, bare)
    # pages are dealt out before they become tokens: windows and groups of a page need no further shuffle
    dealt = spread(pages.select(F.col(id_col).alias("id"), html.alias("_html")), F.length("_html"), TASK_CHARS, "id")
    df = dealt.select("id", F.posexplode(F.regexp_extract_all(kept, F.lit(TOKEN), F.lit(0))).alias("ord", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    is_tag = F.col("token").rlike(r"(?s)^<[!?/A-Za-z].*>$")
    df = df.withColumns({"tag": F.when(is_tag, name), "closing": is_tag & F.col("token").startswith("</")})
    return df.where("tag is null or tag <> ''")


def in_items(blocks: DataFrame) -> DataFrame:
    """blocks (id, at, bound: the tag it begins with, tag: that if it is a start tag) with item: whether an item of the list
    that is open there is open. An item ends with its list, its end tag or the next item of that list."""
    line = W.partitionBy("id").orderBy("at")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    lists = F.when(~F.col("bound").isin("ul", "ol", "menu"), 0).when(F.col("tag").isNotNull(), 1).otherwise(-1)
    df = blocks.withColumn("_sum", F.sum(F.coalesce(lists, F.lit(0))).over(upto))
    df = df.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0)))
    # what the last tag at this depth says; a new list at a depth begins without an item
    said = (F.when((F.col("bound") == "li") & F.col("tag").isNotNull(), True).when(F.col("bound") == "li", False).when(F.col("bound").isin("ul", "ol", "menu") & F.col("tag").isNotNull(), False))
    level = W.partitionBy("id", "_depth").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    open_ = F.coalesce(F.last(said, ignorenulls=True).over(level), F.lit(False))
    return df.withColumn("item", open_ & (F.col("_depth") > 0)).drop("_sum", "_depth")


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ord (from 0), kind, level, text, length, links, bold (share of characters), node.

    kind: heading, paragraph, item, cell, pre, quote, separator. White space is collapsed,
    `br` is a newline, blocks without text are dropped (a separator has none).
    """
    line = W.partitionBy("id").orderBy("ord")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    bounds = F.col("tag").isin(*BLOCKS)
    change = lambda names: F.when(F.col("tag").isin(*names), F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    df = tokens(pages, id_col, html_col).withColumns({"block": F.sum(bounds.cast("int")).over(upto), "opens": F.when(bounds & ~F.col("closing"), F.col("tag"))})
    # a mark that is never closed ends with its block
    df = df.withColumn("in_bold", F.sum(change(("b", "strong"))).over(W.partitionBy("id", "block").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)) > 0)
    raw = F.when(F.col("tag").isNull(), F.regexp_replace(decoded_entities(F.col("token")), "[\t\n\f\r ]+", " ")).when(F.col("tag") == "br", "\n").otherwise("")
    df = df.withColumns({"piece": raw, "chars": F.length(raw)})
    part = F.struct("ord", "piece")
    sums = df.groupBy("id", "block").agg(
        F.min("ord").alias("at"), F.max("opens").alias("tag"), F.max(F.when(bounds, F.col("tag"))).alias("bound"), F.sort_array(F.collect_list(F.when(F.col("chars") > 0, part))).alias("parts"),
        F.count_if((F.col("tag") == "a") & ~F.col("closing")).alias("links"), F.sum(F.when(F.col("in_bold"), F.col("chars")).otherwise(0)).alias("bold_chars"), F.sum("chars").alias("chars"))
    # a block begins with one tag: text behind the end of a list is an item if the list stood in one
    sums = in_items(sums)
    joined = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, " +", " "), " ?\n ?", "\n"), "^[ \n]+|[ \n]+$", "")
    kind = (F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "hr", "separator").when(F.col("tag").isin("li", "dt", "dd") | (F.col("tag").isNull() & F.col("item")), "item")
            .when(F.col("tag").isin("td", "th", "caption"), "cell").when(F.col("tag") == "pre", "pre").when(F.col("tag") == "blockquote", "quote").otherwise("paragraph"))
    out = sums.withColumns({"text": text, "kind": kind, "level": F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))})
    out = out.where("text <> '' or kind = 'separator'").withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("at")))
    return out.select("id", (F.col("n") - 1).alias("ord"), "kind", "level", "text", F.length("text").alias("length"), "links",
                      F.round(F.col("bold_chars") / F.greatest("chars", F.lit(1)), 6).alias("bold"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("node"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", base: str = "base") -> DataFrame:
    """id, ord, href, path, fragment, internal: every link of the page, resolved against the column base."""
    found = F.regexp_extract_all(html_col, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    df = pages.select(F.col(id_col).alias("id"), F.col(base).alias("_base"), F.posexplode(found).alias("ord", "href"))
    outside = F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:")
    r = resolved_href(F.col("_base"), F.col("href"))
    return df.withColumn("r", F.when(~outside, r)).select("id", "ord", "href", "r.path", "r.fragment", (~outside).alias("internal"))


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, fragment, block: the block of each `id` or `name` attribute; the first of a name wins."""
    line = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = tokens(pages, id_col, html_col).withColumn("block", F.sum(F.col("tag").isin(*BLOCKS).cast("int")).over(line))
    name = F.regexp_extract("token", r"(?i)\s(?:id|name)\s*=\s*[\"']([^\"']+)[\"']", 1)
    return df.withColumn("fragment", name).where("fragment <> ''").groupBy("id", "fragment").agg(F.min("block").alias("block"))


def metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, title, author, cover: from the head of the page."""
    named = lambda n: F.nullif(F.regexp_extract(html_col, rf"(?is)<meta\s[^>]*name\s*=\s*[\"']{n}[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    title = F.trim(F.regexp_replace(decoded_entities(F.regexp_extract(html_col, "(?is)<title[^>]*>(.*?)</title>", 1)), "[\t\n\f\r ]+", " "))
    return pages.select(F.col(id_col).alias("id"), F.nullif(title, F.lit("")).alias("title"), named("author").alias("author"), named("cover").alias("cover"))
