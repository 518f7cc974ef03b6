"""Proposals: one reason each, first come first served; inline spans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import proposals as pp

BLOCKS = [
    ("heading", "Title", None, None), ("paragraph", "As Ann writes:", None, None), ("paragraph", "A line of hers.", None, None), ("paragraph", "Another one.", None, None), ("paragraph", "— Ann Lee, Letters", None, None),
    ("image", "", None, None), ("paragraph", "What the picture shows", None, None), ("image", "", None, None), ("caption", "Figure 2", None, None), ("quote", "q", ["Words.", "Bob Ray"], False), ("attribution", "Bob Ray", None, None),
    ("paragraph", "3. Of trees", None, None), ("paragraph", "All good things, she said. — Eve", None, None), ("image", "", None, None), ("image", "", None, None), ("paragraph", "He did not go!", None, None),
]
CASES = [
    ({"kind": "quote", "body": [2, 3], "attribution": 4, "alignment": None}, None), ({"kind": "quote_before", "body": [2], "attribution": 1, "alignment": "center"}, "taken"),
    ({"kind": "section_heading", "block": 11}, None), ({"kind": "section_heading", "block": 6}, "no heading"), ({"kind": "section_heading", "block": 0}, "no heading"), ({"kind": "section_heading", "block": 99}, "no such block"),
    ({"kind": "figure", "images": [5], "captions": [6]}, None), ({"kind": "figure", "images": [7], "captions": [8]}, "wrong blocks"), ({"kind": "figure", "images": [14], "captions": [15]}, "part of a run"), ({"kind": "figure", "images": [13, 14], "captions": [15]}, None),
    ({"kind": "quote_attribution", "quote": 9, "attribution": 10, "body_index": None}, None), ({"kind": "quote_attribution", "quote": 9, "attribution": None, "body_index": 1}, "taken"),
    ({"kind": "quote_attribution", "quote": 9, "attribution": 10, "body_index": 1}, "fields"), ({"kind": "quote_attribution", "quote": 9, "attribution": None, "body_index": 0}, "no credit"), ({"kind": "quote_attribution", "quote": 3, "attribution": 4, "body_index": None}, "wrong blocks"),
    ({"kind": "quote_inline", "body": [12], "credit": "— Eve", "alignment": None}, None), ({"kind": "quote_inline", "body": [12], "credit": "— Adam", "alignment": None}, "no credit"),
    ({"kind": "quote", "body": [2], "attribution": 4, "alignment": None}, "not side by side"), ({"kind": "quote", "body": [12], "attribution": 13, "alignment": None}, "wrong blocks"), ({"kind": "quote", "body": [2], "attribution": 3, "alignment": "left"}, "alignment"),
    ({"kind": "quote", "body": [1], "attribution": 2}, "fields"), ({"kind": "quote", "body": [], "attribution": None, "alignment": None}, "not side by side"), ({"kind": "quote_before", "body": [3], "attribution": 2, "alignment": None}, "no introduction"),
    ({"kind": "poem", "body": [1]}, "unknown kind"), ({"kind": "section_heading", "block": 11, "x": 1}, "fields"),
]


def section(spark, n=1):
    rows = [(s, k, *b) for s in range(n) for k, b in enumerate(BLOCKS)]
    return spark.createDataFrame(rows, "s int, ord int, kind string, text string, body array<string>, credited boolean")


def test_reasons(spark):
    texts = [json.dumps(c) for c, _ in CASES] + ["no json", None]
    df = spark.createDataFrame([(s, k, t) for s in range(2) for k, t in enumerate(texts)], "s int, nth int, json string").repartition(3)
    got = {(r["s"], r["nth"]): r["reason"] for r in pp.accepted(df, section(spark, 2), "s").collect()}
    want = [r for _, r in CASES] + ["unreadable", "unreadable"]
    for s in range(2):
        assert [got[s, k] for k in range(len(texts))] == want
    assert pp.accepted(df.where("false"), section(spark), "s").count() == 0


def test_first_come(spark):
    """No block belongs to two accepted proposals, and each that was turned away meets an earlier accepted one."""
    r = random.Random(2)
    df, blocks = [], [(0, k, "paragraph", f"{k + 1}. words", None, None) for k in range(40)]
    for n in range(120):
        a = r.randint(0, 38)
        df.append((0, n, json.dumps({"kind": "section_heading", "block": a} if n % 3 else {"kind": "quote", "body": [a], "attribution": a + 1, "alignment": None})))
    got = pp.accepted(spark.createDataFrame(df, "s int, nth int, json string"), spark.createDataFrame(blocks, "s int, ord int, kind string, text string, body array<string>, credited boolean"), "s").orderBy("nth").collect()
    used = set()
    for x in got:
        assert x["reason"] == ("taken" if used & set(x["ids"]) else None)
        used |= set(x["ids"]) if x["reason"] is None else set()


@pytest.mark.parametrize("text, credit, leads, heading", [
    ("— Ann Lee", True, False, False), ("Ann Lee, 1999", True, False, False), ("Who?", False, False, False), ("someone said", False, False, False), ("He wrote it", False, False, False), ("(He wrote it)", True, False, False), ("“Yes”", False, False, False), ("12", False, False, True),
    ("As Bob said:", True, True, False), ("people say:", True, False, False), ("老师指出。", True, True, False), ("Chapter IV: Rain", True, False, True), ("第十二章 海", True, False, True), ("1.2.3 Methods", True, False, True), ("（3）方法", True, False, True), ("1999 was a year", True, False, True),
    ("12345 things", True, False, False), ("chapter and verse", True, False, False), ("3.14", False, False, False), ("", False, False, False), ("2)", False, False, True)])
def test_texts(spark, text, credit, leads, heading):
    t = F.lit(text)
    r = spark.range(1).select(pp.is_credit(t).alias("c"), pp.introduces(t).alias("i"), pp.is_numbered_heading(t).alias("h")).first()
    assert (r["c"], r["i"], r["h"]) == (credit, leads, heading)


def test_inline_spans(spark):
    texts = spark.createDataFrame([(1, "see Fig. 1 and x=2 or x=2, é😀 end"), (2, "plain"), (3, None), (4, "")], "k int, text string")
    spans = [(1, 0, 4, 10, "Fig. 1", "citation"), (1, 1, 8, 12, "1 an", "overlaps"), (1, 2, 0, 3, "é😀", "moved"), (1, 3, 0, 3, "x=2", "twice"), (1, 4, 15, 18, "x=2", "formula"), (1, 5, 0, 1, "nowhere", "gone"), (9, 0, 0, 1, "p", "other"), (2, 0, 0, 5, "plain", "all")]
    got = {}
    for r in pp.annotated(texts, spark.createDataFrame(spans, "k int, nth int, start int, end int, text string, mark string"), "k").orderBy("k", "run").collect():
        got.setdefault(r["k"], []).append((r["text"], r["mark"]))
    assert got == {1: [("see ", None), ("Fig. 1", "citation"), (" and ", None), ("x=2", "formula"), (" or x=2, ", None), ("é😀", "moved"), (" end", None)], 2: [("plain", "all")]}
