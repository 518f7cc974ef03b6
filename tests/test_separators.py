"""Lines of symbols and blank lines that part a text."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import separators as sp


@pytest.mark.parametrize("text, want", [
    ("* * *", "repeated"), ("＊＊＊", "repeated"), ("***​*", "repeated"), ("**", None), ("*-*", None), ("• • •", "repeated"), ("* a *", None), ("◆", "weak"), ("◆◆", None), ("---", "weak"), ("—–-", "weak"), ("--", None), ("———▲", "weak"), ("–––▲", None),
    ("▲---", None), ("___", "weak"), ("", None), ("   ", None), ("*" * 32, "repeated"), ("*" * 33, None), ("⁂", None), (None, None)])
def test_symbols(spark, text, want):
    assert spark.range(1).select(sp.symbols(F.lit(text).cast("string")).alias("v")).first()["v"] == want


@pytest.mark.parametrize("raw, breaks, want", [(" ", 0, True), (" 　\n", 0, True), ("  ", 0, False), ("  ", 1, True), ("", 2, True), ("a ", 1, False), (None, 1, False)])
def test_blanks(spark, raw, breaks, want):
    assert spark.range(1).select(sp.is_set_blank(F.lit(raw).cast("string"), F.lit(breaks)).alias("v")).first()["v"] is want


PROSE = "This is a paragraph of prose with more than forty characters."


def test_separated(spark):
    """Each middle block between its neighbours: (before, text, after, held, centered, margin) and whether it parts."""
    cases = [
        (PROSE, "* * *", PROSE, False, False, 0.0, True), (PROSE, "* * *", PROSE, True, False, 0.0, False), ("x", "***", "y", False, False, None, True),
        (PROSE, "---", PROSE, False, True, 8.0, True), (PROSE, "---", PROSE, False, True, 4.0, False), (PROSE, "---", PROSE, False, False, 9.0, False), ("short", "---", PROSE, False, True, 9.0, False),
        ("RULE", "◆", "x", False, True, 0.0, True), ("x", "◆", "RULE", False, True, None, True), (PROSE, "◆", "HEAD", False, True, 9.0, False), (None, "◆", PROSE, None, None, 9.0, False), (PROSE, "words", PROSE, False, True, 9.0, False)]
    kind = {"RULE": "rule", "HEAD": "heading"}
    rows = []
    for k, (a, t, z, held, centered, margin, _) in enumerate(cases):
        rows += [(k, n, kind.get(x, "paragraph"), x, held, centered, margin) for n, x in ((1, a), (5, t), (9, z))]
    df = spark.createDataFrame(rows, "k int, ord int, kind string, text string, held boolean, centered boolean, margin double")
    got = {r["k"]: r["part"] for r in sp.separated(df, "k").where("ord = 5").collect()}
    assert got == {k: "symbols" if c[-1] else None for k, c in enumerate(cases)}
    assert sp.separated(df, "k").where("ord <> 5 and part is not null").count() == 0 and sp.separated(df.where("false"), "k").count() == 0
