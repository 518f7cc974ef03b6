"""Brackets, citations, places in order, and files that a broken run leaves."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import arrays as ar
from lectern.operators import language as lg
from lectern.operators.ranks import placed
from lectern.sources import files as fl


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def plain_enclosed(text):
    stack, out, start = [], [], 0
    for i, c in enumerate(text):
        if c in lg.CITED_IN:
            start = start if stack else i
            stack.append(lg.CITED_IN[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                out.append((start, i + 1))
    return out


def test_brackets_against_a_stack(spark):
    """Nested, crossed, unclosed and stray brackets; many in one text; characters outside the basic plane."""
    r = random.Random(4)
    texts = ["".join(r.choice("()[]（）［］ab😀") for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += ["(a[b]c) (d", "(a]b)", "([)]", ")(", "", "(x)" * 2000, "(" * 400 + ")" * 400, "[" * 50 + "(a)", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["s"] for x in df.select("i", ar.enclosed(F.col("t"), lg.CITED_IN).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if t is None else [tuple(s) for s in got[i]] == plain_enclosed(t), t


def test_scans_of_long_arrays(spark):
    n = 1000
    sums = one(spark, ar.scanned(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, x: s + x, "int"))
    assert sums == [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert one(spark, ar.scanned(F.array().cast("array<int>"), F.lit(0), lambda s, x: s + x, "int")) == []
    assert one(spark, ar.scanned(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, x: x, "int", lambda s: F.when(s % 3 == 0, s), "int")) == [3, 6, 9]


@pytest.mark.parametrize("text, want", [
    ("Smith, 1999", True), ("Smith and Lee, 2001a", True), ("Smith & van der Berg 1999, 2003", True), ("see Ng, Wu, and Li, 2001; Xu et al., 1998", True), ("Smith et al. 1999, pp. 3-5", True), ("王小明，2004", True), ("张三等，1999", True), ("李四、王五 2010", True),
    ("1999", False), ("in 1999", False), ("March 1999", False), ("Figure 2001", False), ("born 1950", False), ("smith 1999", False), ("Smith", False), ("Smith, 1999 and more", False), ("Smith, 2150", False), ("A B C D E F 1999", False), ("", False)])
def test_works(spark, text, want):
    assert one(spark, lg.cites_works(F.lit(text))) is want


@pytest.mark.parametrize("inside, before, want", [
    ("1, 3-5", "as shown by studies ", True), ("12", "参见", True), ("7", "see: ", True), ("5-3", "see ", False), ("0", "see ", False), ("1", "the array index, see ", False), ("1", "a value ", False), ("1.5", "see ", False), ("10000", "see ", False), ("1 – 4", "refs. ", True)])
def test_numbers(spark, inside, before, want):
    assert one(spark, lg.cites_numbers(F.lit(inside), F.lit(before))) is want


def test_candidates(spark):
    texts = [(1, "Words (see Smith (and others), 1999) and (no) and (a1b) [3]; see [4, 5]. (Fig. 2) (1) (" + "x" * 610 + "1)"), (2, None), (3, ""), (4, "open (Smith, 1999")]
    got = lg.citation_candidates(spark.createDataFrame(texts, "id int, text string"), "id").orderBy("id", "start").collect()
    assert [(r["inside"], r["local"]) for r in got] == [("see Smith (and others), 1999", False), ("a1b", False), ("3", False), ("4, 5", True), ("Fig. 2", True)]
    assert got[0]["before"] == "Words " and got[3]["after"].startswith(". (Fig. 2)")


def test_places(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 20), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    for group in ("g", None):
        got = placed(df, F.col("v").asc(), F.col("k").asc(), group=group).collect()
        want = {}
        for g, v, k in sorted(rows, key=lambda x: x[1:]):
            want[k] = sum(1 for w in want if not group or rows[w][0] == g) + 1
        assert {x["k"]: x["place"] for x in got} == want
    assert placed(df.where("false"), F.col("v")).count() == 0


def test_broken_write(spark, tmp_path, monkeypatch):
    """A run that breaks off after the rows: the rows before it are written again, not taken for present."""
    old, new, place = spark.range(5), spark.range(7), f"{tmp_path}/t"
    assert fl.write_if_changed(old, place)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(fl, "mark", broken)
        with pytest.raises(OSError):
            fl.write_if_changed(new, place)
    assert fl.write_if_changed(old, place) and spark.read.parquet(f"{place}/rows").count() == 5 and not fl.write_if_changed(old, place)
