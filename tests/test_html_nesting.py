"""Nested tables and lists, and captions by claim, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import html_blocks as hb, html_parts as hp


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def cells(spark, html):
    got = hp.tables(pages(spark, html)).orderBy("table", "row", "column").collect()
    return [(r["table"], r["row"], r["column"], r["text"], r["caption"]) for r in got]


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td>a<table><tr><td>in</td></tr></table>z</td><td>b</td></tr><tr><td>c</td></tr></table>",
     [(1, 0, 0, "a z", None), (1, 0, 1, "b", None), (1, 1, 0, "c", None), (2, 0, 0, "in", None)]),
    ("</table><table><caption>T</caption><tr><th>h<tr><td>a<td>b</table>x<table><td>q</table>", [(1, 0, 0, "h", "T"), (1, 1, 0, "a", "T"), (1, 1, 1, "b", "T"), (2, 0, 0, "q", None)]),
    ("<table><tr><td><table><caption>in</caption><tr><td><table><tr><td>deep</td></tr></table></td></tr></table></td><td>o</td></tr></table>",
     [(1, 0, 0, "", None), (1, 0, 1, "o", None), (2, 0, 0, "", "in"), (3, 0, 0, "deep", None)]),
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr></tr><tr><td>c</td></tr></table>", [(1, 0, 0, "a", None), (1, 0, 1, "b", None), (1, 2, 0, "c", None)]),
    ("<p>no table</p>", [])])
def test_tables(spark, html, want):
    assert cells(spark, html) == want


@pytest.mark.parametrize("html, want", [
    ("<ul><li>a<ul><li>b</li></ul>c</li></ul>d", [("item", "a"), ("item", "b"), ("item", "c"), ("paragraph", "d")]),
    ("<ul><li>a<ol><li>b<li>c</ol>d<p>e</p>f<li>g</ul><p>h", [("item", "a"), ("item", "b"), ("item", "c"), ("item", "d"), ("paragraph", "e"), ("item", "f"), ("item", "g"), ("paragraph", "h")]),
    ("</ul>x<ul>y<li>z</li>w</ul>v", [("paragraph", "x"), ("paragraph", "y"), ("item", "z"), ("paragraph", "w"), ("paragraph", "v")])])
def test_lists(spark, html, want):
    assert [(r["kind"], r["text"]) for r in hb.blocks(pages(spark, html)).orderBy("ord").collect()] == want


@pytest.mark.parametrize("text, label, prose, note", [
    ("Table 3. Results", True, False, False), ("Table 3 shows it", True, True, False), ("Table 3b", False, False, False), ("表3显示", True, True, False), ("表格 2-1：值", True, False, False), ("TABLE 4.2 is", True, True, False),
    ("Note: x", False, False, True), ("资料来源：y", False, False, True), ("Sources : z", False, False, True), ("Nota: z", False, False, False), ("Tables 3", False, False, False), ("", False, False, False)])
def test_words_of_tables(spark, text, label, prose, note):
    t = F.lit(text)
    r = spark.range(1).select(tx.begins_with_table_label(t).alias("a"), tx.speaks_of_a_table(t).alias("b"), tx.is_table_note(t).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (label, prose, note)


LABEL, TITLE, CAPTION, PROSE, NOTE = "Table 1", "A title", "Table 2: Data", "Table 3 shows it", "Source: me"


def plain_claims(blocks):
    """Walks from every carrier over its neighbours, as far as they can belong to it."""
    blocks = [b for b in blocks if b[1] != "spacing"]
    carrier = [b[1] in ("table", "image") for b in blocks]
    tables = {}
    for b in blocks:
        tables[b[4]] = tables.get(b[4], 0) + (b[1] == "table")

    def fits(j, i):
        _, kind, text, classes, scope = blocks[j]
        if kind not in ("paragraph", "caption") or not text or text == PROSE or (scope is not None and scope != blocks[i][4]):
            return False
        paired = j > 0 and not carrier[j - 1] and blocks[j - 1][2] == LABEL and (j + 1 == i or j - 2 == i)
        within = scope is not None and scope == blocks[i][4] and tables[scope] <= 1
        return paired or text in (LABEL, CAPTION) or "table-caption" in classes or (within and ("legend" in classes or text == NOTE))

    claims = {}
    for i in range(len(blocks)):
        for d in (-1, 1) if carrier[i] else ():
            j = i + d
            while 0 <= j < len(blocks) and not carrier[j] and fits(j, i):
                claims.setdefault(j, []).append(i)
                j += d
    return {blocks[j][0]: blocks[own[0]][0] for j, own in claims.items() if len(own) == 1}


def test_captions_against_a_walk(spark):
    r = random.Random(7)
    made, rows = {}, []
    for k in range(400):
        made[k] = [(n, r.choice(["table", "image", "paragraph", "paragraph", "paragraph", "paragraph", "caption", "spacing", "other"]), "", "", r.choice([None, None, 1, 2])) for n in range(r.randint(1, 9))]
        made[k] = [(n, kind, "" if kind in ("table", "image", "spacing") else r.choice([LABEL, TITLE, CAPTION, PROSE, NOTE, "words"]), r.choice(["", "", "legend", "table-caption"]), s) for n, kind, _, _, s in made[k]]
        rows += [(k, *b) for b in made[k]]
    df = spark.createDataFrame(rows, "id int, ord int, kind string, text string, classes string, scope int").repartition(5)
    got = {}
    for x in hp.table_captions(df).where("carrier is not null").collect():
        got.setdefault(x["id"], {})[x["ord"]] = x["carrier"]
    for k, blocks in made.items():
        assert got.get(k, {}) == plain_claims(blocks), blocks


def test_flow(spark):
    html = ("<p>lead</p><div class='my-table'><p>Table 1: First</p><table><tr><td>A<table><tr><td>x</table></td></tr></table><p>Note: n1</p></div>"
            "<p>between</p><p>Table 2</p><p>A long title</p><p><img src=i.png></p><p>Table 9 shows it</p>")
    got = hp.table_captions(hp.flow(pages(spark, html))).orderBy("ord").collect()
    kinds = {r["ord"]: r["kind"] for r in got}
    assert [(r["kind"], r["text"], r["carrier"] and kinds[r["carrier"]]) for r in got] == [
        ("paragraph", "lead", None), ("paragraph", "Table 1: First", "table"), ("table", "", None), ("paragraph", "Note: n1", "table"), ("paragraph", "between", None), ("paragraph", "Table 2", "image"), ("paragraph", "A long title", "image"), ("image", "", None), ("paragraph", "Table 9 shows it", None)]


@pytest.mark.parametrize("html, want", [
    ("<nav epub:type='toc'><h1>Contents</h1><ol><li><a href='a.xhtml'>One &amp; only</a><ol><li><a href='a.xhtml#x'>Part <i>x</i></a></li><li><span>No link</span></li></ol></li><li><a href=b.xhtml>Two</a></li></ol></nav>",
     [(0, 0, None, "One & only", "a.xhtml"), (1, 1, 0, "Part x", "a.xhtml#x"), (2, 1, 0, "No link", None), (3, 0, None, "Two", "b.xhtml")]),
    ("<ncx><docTitle><text>Book</text></docTitle><navMap><navPoint id='p1'><navLabel><text>One</text></navLabel><content src='a.html'/><navPoint><navLabel><text>Deep</text></navLabel><content src='a.html#d'/></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src='b.html'/></navPoint></navMap></ncx>",
     [(0, 0, None, "One", "a.html"), (1, 1, 0, "Deep", "a.html#d"), (2, 0, None, "Two", "b.html")]),
    ("<ul><li><ul><li><a href=x>In</a></li></ul></li><li>After</ul>", [(0, 1, None, "In", "x"), (1, 0, None, "After", None)]), ("<p>none</p>", [])])
def test_contents(spark, html, want):
    got = hp.contents_tree(pages(spark, html)).orderBy("ord").collect()
    assert [(r["ord"], r["depth"], r["parent"], r["label"], r["href"]) for r in got] == want
