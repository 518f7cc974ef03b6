"""Tables, definition lists, figures and notes of HTML sections, as rows: running counts over the page's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions.arrays import scanned
from lectern.functions.text import begins_with_table_label, bound, is_table_note, speaks_of_a_table, standalone_table_label
from lectern.operators.html_blocks import BLOCKS, decoded_entities, tokens
from lectern.operators.language import caption_key
from lectern.operators.structure import MOST_SPAN
from lectern.operators.toc import parents

# What an element's type or role says of a note.
NOTE_TYPES = ("footnote", "endnote", "rearnote", "note", "doc-footnote", "doc-endnote")

# Elements that wrap others, and what the class of a wrapper of a table holds.
WRAPPERS = ("div", "section", "article", "figure", "aside")
TABLE_CLASSES = ("table", "tabular", "tbl")


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a tag, in quotes or bare; null if it has none."""
    found = F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"(?is)^\s[^=]*=\s*", ""), "^[\"']|[\"']$", "")
    return F.when(found != "", decoded_entities(bare))


def span_of(token: Column, name: str) -> Column:
    number = F.regexp_extract(token, rf"(?i)\s{name}\s*=\s*[\"']?\s*([0-9]{{1,4}})", 1).try_cast("int")
    return F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.lit(MOST_SPAN))


def opened(df: DataFrame, column: str, names: tuple[str, ...], key: str = "id") -> DataFrame:
    """df with a running count of the start tags among the names."""
    upto = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.sum((F.col("tag").isin(*names) & ~F.col("closing")).cast("int")).over(upto))


def inside(df: DataFrame, column: str, test: Column, key: str = "id") -> DataFrame:
    """df with whether a start tag that passes the test is open (its end tag is the next of that name at its depth)."""
    upto = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.sum(F.when(test & ~F.col("closing"), 1).when(test & F.col("closing"), -1).otherwise(0)).over(upto) > 0)


def joined_text() -> Column:
    """Text of a group's tokens in order, white space collapsed."""
    part = F.when(F.col("tag").isNull(), F.struct("ord", F.col("token").alias("t"))).when(F.col("tag").isin("br", *BLOCKS), F.struct("ord", F.lit(" ").alias("t")))
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "")
    return F.trim(F.regexp_replace(decoded_entities(raw), "[\t\n\f\r ]+", " "))


def nested(df: DataFrame, column: str, names: tuple[str, ...], key: str = "id") -> DataFrame:
    """df with column: the number of the innermost open element of the names (null outside), counted by start tags; and
    column_depth, how many are open. A tag belongs to the element that it opens or closes; stray end tags count nothing.

    At one depth elements follow each other, so the last start tag of a token's depth is the element around it.
    """
    upto = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    mine, depth = F.col("tag").isin(*names), f"{column}_depth"
    step = F.when(mine & F.col("closing"), -1).when(mine, 1).otherwise(0)
    df = df.withColumn("_sum", F.sum(step).over(upto)).withColumn("_nth", F.sum((step == 1).cast("int")).over(upto))
    # below zero there is nothing to close: the sum counts from its lowest value so far
    df = df.withColumn("_low", F.least(F.min("_sum").over(upto), F.lit(0)))
    closes = (step == -1) & (F.col("_sum") >= F.coalesce(F.lag("_low").over(W.partitionBy(key).orderBy("ord")), F.lit(0)))
    df = df.withColumn(depth, (F.col("_sum") - F.col("_low") + F.when(closes, 1).otherwise(0)).cast("int"))
    level = W.partitionBy(key, depth).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.when(F.col(depth) > 0, F.max(F.when(step == 1, F.col("_nth"))).over(level))).drop("_sum", "_nth", "_low")


def grid(cells: Column, rows: Column) -> Column:
    """row, column, row_span and column_span of cells (row, row_span, column_span, in order): each takes the first columns
    of its row that no cell above reaches into."""
    kind = "struct<row:int,column:int,row_span:int,column_span:int>"
    state = f"struct<row:int,next:int,busy:array<int>,cell:{kind}>"
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("busy"), F.lit(None).cast(kind).alias("cell"))

    def place(s: Column, x: Column) -> Column:
        busy, first = s["busy"], F.when(s["row"] == x["row"], s["next"]).otherwise(0)
        free = F.filter(F.sequence(first, F.greatest(F.size(busy), first)), lambda c: F.coalesce(F.get(busy, c), F.lit(0)) <= x["row"])

        def put(at: Column) -> Column:
            end, tall = at + x["column_span"], F.least(x["row_span"], rows - x["row"])
            new = F.transform(F.sequence(F.lit(0), F.greatest(F.size(busy), end) - 1), lambda c: F.when((c >= at) & (c < end), x["row"] + tall).otherwise(F.coalesce(F.get(busy, c), F.lit(0))))
            cell = F.struct(x["row"].alias("row"), at.alias("column"), tall.alias("row_span"), x["column_span"].alias("column_span"))
            return F.struct(x["row"].alias("row"), end.alias("next"), new.alias("busy"), cell.alias("cell"))

        return bound(F.array_min(free), put)

    return scanned(cells, start, place, state, lambda s: s["cell"], kind)


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, table, row, column, row_span, column_span, header, text, caption: the cells of every table where they stand in its
    grid. A table in a cell is a table of its own; its text is not the cell's. Cells outside a row are in the first."""
    df = tokens(pages.where(F.lower(F.col(html_col)).contains("<table")), id_col, html_col)
    df = nested(df, "table", ("table",))
    # what follows a table in a cell is a word of its own
    behind = F.coalesce(F.lag("table_depth").over(W.partitionBy("id").orderBy("ord")) > F.col("table_depth"), F.lit(False))
    df = df.withColumn("_behind", behind).where("table is not null").withColumns({
        "token": F.when(F.col("_behind") & F.col("tag").isNull(), F.concat(F.lit(" "), "token")).otherwise(F.col("token")),
        "tag": F.when(F.col("_behind") & ~F.col("tag").isin(*BLOCKS), "br").otherwise(F.col("tag"))}).drop("table_depth", "_behind")
    cells = F.col("tag").isin("td", "th")
    # within a table's own tokens: rows and cells counted, and what is open
    upto = W.partitionBy("id", "table").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    opens = ~F.col("closing")
    open_ = (F.when(cells & opens, "cell").when((F.col("tag") == "caption") & opens, "caption").when(F.col("tag").isin("td", "th", "caption", "tr", "table"), ""))
    df = df.withColumns({
        "line": F.greatest(F.sum(((F.col("tag") == "tr") & opens).cast("int")).over(upto), F.lit(1)), "cell": F.sum((cells & opens).cast("int")).over(upto), "_open": F.last(open_, ignorenulls=True).over(upto)})
    start = cells & opens
    # empty rows count for the height of cells that reach over them
    df = df.withColumn("_rows", F.max(F.when((F.col("tag") == "tr") & opens, F.col("line"))).over(W.partitionBy("id", "table")).cast("int"))
    texts = df.where("_open <> ''").groupBy("id", "table", F.when(F.col("_open") == "cell", F.col("cell")).otherwise(0).alias("cell")).agg(
        joined_text().alias("text"), F.min("line").alias("line"), F.bool_or(F.col("tag") == "th").alias("header"), F.max("_rows").alias("_rows"),
        F.max(F.when(start, span_of(F.col("token"), "rowspan"))).alias("row_span"), F.max(F.when(start, span_of(F.col("token"), "colspan"))).alias("column_span"))
    cell = F.struct("cell", (F.col("line") - 1).cast("int").alias("row"), "row_span", "column_span", F.coalesce("header", F.lit(False)).alias("header"), "text")
    told = texts.groupBy("id", "table").agg(F.coalesce(F.max("_rows"), F.lit(1)).alias("_rows"), F.sort_array(F.collect_list(F.when(F.col("cell") > 0, cell))).alias("cells"), F.max(F.when(F.col("cell") == 0, F.nullif("text", F.lit("")))).alias("caption"))
    placed = told.withColumn("at", grid(F.col("cells"), F.col("_rows"))).select("id", "table", "caption", F.inline_outer(F.arrays_zip("cells", "at"))).where("at is not null")  # not outer, Spark works the grid out again to see whether it is empty
    return placed.select("id", "table", "at.row", "at.column", "at.row_span", "at.column_span", "cells.header", "cells.text", "caption")


def scopes(df: DataFrame) -> DataFrame:
    """df with scope: the innermost open wrapper whose class speaks of a table, by its place; null outside. The wrappers of
    a page are gone through with a stack."""
    wraps = F.col("tag").isin(*WRAPPERS)
    tabular = F.lower(F.coalesce(attribute(F.col("token"), "class"), F.lit(""))).rlike("|".join(TABLE_CLASSES))
    wanted = df.where(wraps).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "closing", tabular.alias("tabular")))).alias("w")).where(F.exists("w", lambda x: x["tabular"]))
    state = "struct<ord:int,open:array<int>>"
    zero = F.struct(F.lit(-1).alias("ord"), F.array().cast("array<int>").alias("open"))

    def step(s: Column, x: Column) -> Column:
        inner = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(-1))
        opened = F.array_append(s["open"], F.when(x["tabular"], x["ord"]).otherwise(inner))
        left = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return F.struct(x["ord"].alias("ord"), F.when(x["closing"], left).otherwise(opened).alias("open"))

    at = lambda s: F.struct(s["ord"].alias("ord"), F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(-1)).alias("_scope"))
    known = wanted.select("id", F.inline_outer(scanned(F.col("w"), zero, step, state, at, "struct<ord:int,_scope:int>")))
    last = F.last("_scope", ignorenulls=True).over(W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return df.join(known, ["id", "ord"], "left").withColumn("scope", F.nullif(last, F.lit(-1))).drop("_scope")


def flow(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ord, kind (table, image, caption, paragraph, other), text, classes, scope: the blocks of a page with its outer
    tables and pictures among them, each as one block."""
    df = scopes(nested(tokens(pages, id_col, html_col), "table", ("table",)))
    df = df.where((F.col("table_depth") == 0) | ((F.col("table_depth") == 1) & (F.col("tag") == "table")))
    upto = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("block", F.sum(F.col("tag").isin(*BLOCKS).cast("int")).over(upto))
    starts = F.col("tag").isin(*BLOCKS) & ~F.col("closing")
    own = df.groupBy("id", "block").agg(
        F.min("ord").alias("ord"), F.max(F.when(starts, F.col("tag"))).alias("tag"), joined_text().alias("text"), F.bool_or(F.col("tag").isin("img", "image")).alias("_image"),
        F.lower(F.max(F.when(starts, attribute(F.col("token"), "class")))).alias("classes"), F.max("scope").alias("scope"))
    kind = (F.when(F.col("tag") == "table", "table").when((F.col("text") == "") & F.col("_image"), "image").when(F.col("text") == "", None).when(F.col("tag").isin("figcaption", "caption"), "caption")
            .when(F.coalesce(F.col("tag"), F.lit("p")).isin("p", "div", "section", "figure", "article", "body"), "paragraph").otherwise("other"))
    return own.withColumn("kind", kind).where("kind is not null").select("id", "ord", "kind", "text", "classes", "scope")


def table_captions(blocks: DataFrame, key: str = "id") -> DataFrame:
    """blocks (key, ord, kind, text, classes, scope) with carrier: the ord of the table or picture whose caption or note a
    block is; null for others.

    From each carrier the blocks on both sides are claimed up to the first that cannot belong to it; blocks of kind
    spacing are passed over. A block that two carriers claim belongs to neither.
    """
    line = W.partitionBy(key).orderBy("ord")
    df = blocks.where("kind <> 'spacing'").withColumn("_carrier", F.col("kind").isin("table", "image"))
    df = df.withColumn("_gap", F.sum(F.col("_carrier").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    told = F.when(F.col("_carrier"), F.struct("ord", "scope"))
    df = df.withColumns({
        "_left": F.last(told, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)), "_right": F.first(told, ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)),
        "_titled": F.coalesce(F.lag(standalone_table_label("text")).over(line), F.lit(False)), "_before": F.coalesce(F.lag("_carrier").over(line), F.lit(False)), "_two": F.coalesce(F.lag("_carrier", 2).over(line), F.lit(False)),
        "_after": F.coalesce(F.lead("_carrier").over(line), F.lit(False)), "_tables": F.sum((F.col("kind") == "table").cast("int")).over(W.partitionBy(key, "scope"))})
    classes = F.translate(F.coalesce("classes", F.lit("")), "-_", "")
    text = F.trim("text")
    words = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), classes.contains)
    named = begins_with_table_label(text) | words(("tablecaption", "tabletitle"))
    prose = F.col("kind").isin("paragraph", "caption") & (text != "") & ~speaks_of_a_table(text)

    def fits(media: Column, paired: Column) -> Column:
        apart = F.col("scope").isNotNull() & ~F.col("scope").eqNullSafe(media["scope"])
        within = F.col("scope").isNotNull() & (F.col("scope") == media["scope"]) & (F.col("_tables") <= 1)
        return prose & ~apart & (named | (F.col("_titled") & paired) | (within & (words(("caption", "title", "legend")) | is_table_note(text))))

    free = ~F.col("_carrier")
    # a title stands between its label and the carrier, or behind the label that follows the carrier
    df = df.withColumns({"_l": free & F.coalesce(fits(F.col("_left"), F.col("_two")), F.lit(False)), "_r": free & F.coalesce(fits(F.col("_right"), F.col("_after")), F.lit(False))})
    gap = W.partitionBy(key, "_gap")
    # the carrier that begins a gap is no block of it
    upto = lambda c, order: F.min((F.col(c) | F.col("_carrier")).cast("int")).over(gap.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) == 1
    left = free & F.col("_left").isNotNull() & upto("_l", F.col("ord").asc())
    right = free & F.col("_right").isNotNull() & upto("_r", F.col("ord").desc())
    df = df.withColumn("_a", left).withColumn("_z", right)
    owner = F.when(F.col("_a") & ~F.col("_z"), F.col("_left.ord")).when(F.col("_z") & ~F.col("_a"), F.col("_right.ord"))
    return df.select(*blocks.columns, owner.alias("carrier"))


def definition_lists(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ord, term, definition: every definition with the term before it."""
    df = opened(opened(tokens(pages, id_col, html_col), "list", ("dl",)), "item", ("dt", "dd"))
    df = inside(df, "in_list", F.col("tag") == "dl").where("in_list and item > 0")
    items = df.groupBy("id", "list", "item").agg(joined_text().alias("text"), F.max(F.when(F.col("tag").isin("dt", "dd") & ~F.col("closing"), F.col("tag"))).alias("kind"))
    line = W.partitionBy("id", "list").orderBy("item")
    term = F.last(F.when(F.col("kind") == "dt", F.col("text")), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
    return items.withColumn("term", term).where("kind = 'dd'").select("id", F.col("item").alias("ord"), "term", F.col("text").alias("definition"))


def figures(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, image, href, caption, key: every picture with the caption of its figure, or the block after it that begins like one."""
    df = opened(opened(tokens(pages, id_col, html_col), "image", ("img", "image")), "figure", ("figure",))
    upto = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("block", F.sum(F.col("tag").isin(*BLOCKS).cast("int")).over(upto))
    df = inside(inside(df, "in_figure", F.col("tag") == "figure"), "in_caption", F.col("tag") == "figcaption")
    images = df.where("tag in ('img', 'image')").select("id", "image", "in_figure", "figure", "block", F.coalesce(attribute(F.col("token"), "src"), attribute(F.col("token"), "href")).alias("href"))
    captions = df.where("in_caption").groupBy("id", "figure").agg(F.nullif(joined_text(), F.lit("")).alias("_own"))
    texts = df.where("not in_caption").groupBy("id", "block").agg(joined_text().alias("text")).where("text <> ''")
    # the next block with text after the picture's own, in one ordered pass
    both = images.select("id", "block", "image").unionByName(texts.select("id", "block", "text"), allowMissingColumns=True)
    # from the end: pictures before the text of the same block, as only later blocks count
    behind = W.partitionBy("id").orderBy(F.col("block").desc(), F.col("image").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    next_ = both.withColumn("_next", F.last("text", ignorenulls=True).over(behind)).where("image is not null").select("id", "image", "_next")
    out = images.join(captions, ["id", "figure"], "left").join(next_, ["id", "image"], "left")
    caption = F.when(F.col("in_figure"), F.col("_own")).when(caption_key(F.col("_next")).isNotNull(), F.col("_next"))
    return out.select("id", "image", "href", caption.alias("caption")).withColumn("key", caption_key(F.col("caption")))


def note_definitions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, fragment, text: the elements whose type or role says that they are notes, by their id."""
    df = tokens(pages, id_col, html_col)
    kind = F.lower(F.coalesce(attribute(F.col("token"), "epub:type"), attribute(F.col("token"), "role"), F.lit("")))
    starts = F.col("tag").isin("aside", "div", "li", "p", "section") & ~F.col("closing") & F.arrays_overlap(F.split(kind, " "), F.array(*[F.lit(t) for t in NOTE_TYPES]))
    upto = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("note", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(upto)).where("note > 0")
    own = F.first(F.when(F.col("tag").isNotNull(), F.col("tag"))).over(W.partitionBy("id", "note").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    df = df.withColumn("_own", own)
    depth = F.sum(F.when((F.col("tag") == F.col("_own")) & ~F.col("closing"), 1).when(F.col("tag") == F.col("_own"), -1).otherwise(0)).over(W.partitionBy("id", "note").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    ended = F.max((F.col("_depth") <= 0).cast("int")).over(W.partitionBy("id", "note").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)) == 1
    held = df.withColumn("_depth", depth).withColumn("_ended", ended).where("not _ended")
    out = held.groupBy("id", "note").agg(F.first(attribute(F.when(F.col("tag").isNotNull(), F.col("token")), "id"), ignorenulls=True).alias("fragment"), joined_text().alias("text"))
    return out.where("fragment is not null and text <> ''").select("id", "fragment", "text")


def contents_tree(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ord (from 0), depth, parent (ord of the entry above), label, href: the entries of tables of contents, in the two forms that
    books have: nested lists with links, and nested points with a label and content. Entries without a label are left out, and
    what is under them moves to the entry above.

    An entry is what follows its start tag up to the next tag that begins or ends an entry or a list.
    """
    df = tokens(pages, id_col, html_col, skipped=("script", "style", "head", "title", "doctitle", "docauthor"))
    opens = ~F.col("closing")
    point, item = (F.col("tag") == "navpoint") & opens, (F.col("tag") == "li") & opens
    df = nested(nested(df, "list", ("ol", "ul", "menu")), "point", ("navpoint",))
    upto = W.partitionBy("id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("entry", F.sum((point | item).cast("int")).over(upto)).where("entry > 0")
    own = W.partitionBy("id", "entry").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    ended = F.sum((F.col("tag").isin("ol", "ul", "menu") | (F.col("tag").isin("li", "navpoint") & F.col("closing"))).cast("int")).over(own)
    df = df.withColumn("_ended", ended).where("_ended = 0")
    link = F.when(F.col("tag") == "a", attribute(F.col("token"), "href")).when(F.col("tag") == "content", attribute(F.col("token"), "src"))
    found = df.groupBy("id", "entry").agg(joined_text().alias("label"), F.min_by(link, F.when(link.isNotNull(), F.col("ord"))).alias("href"), (F.max(F.when(point, F.col("point_depth")).when(item, F.col("list_depth"))) - 1).alias("depth"))
    kept = found.where("label <> ''").withColumn("ord", F.row_number().over(W.partitionBy("id").orderBy("entry")) - 1)
    tree = parents(kept, "id")
    return tree.select("id", "ord", "depth", "parent", "label", "href")
