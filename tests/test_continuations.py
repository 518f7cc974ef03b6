"""Repeated quotes with one change, against a plain comparison."""

import random

from pyspark.sql import functions as F

from lectern.operators import continuations as co


def plain(text, quote):
    if quote in text:
        return True
    n = len(quote)
    if n < co.LONG:
        return False
    for start in range(len(text)):
        if not text.startswith(quote[: co.END], start):
            continue
        for size in range(n - co.CHANGED, min(n + co.CHANGED, len(text) - start) + 1):
            w = text[start : start + size]
            a = next((k for k in range(min(n, size)) if w[k] != quote[k]), min(n, size))
            z = next((k for k in range(min(n, size) - a) if w[-1 - k] != quote[-1 - k]), min(n, size) - a)
            if a >= co.END and z >= co.END and n - a - z <= co.CHANGED and size - a - z <= co.CHANGED:
                return True
    return False


def test_planted_changes(spark):
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abc.é😀\\E*") for _ in range(k))
    quotes, texts = [], []
    for k in range(160):
        q = word(r.choice([10, 40, 95, 96, 97, 130, 260]))
        at, gone, put = r.randint(0, len(q)), r.choice([0, 0, 3, 20, 24, 25, 40]), r.choice([0, 1, 5, 23, 24, 25, 30])
        quotes.append((k, q))
        texts.append((k, word(r.randint(0, 60)) + q[:at] + word(put) + q[at + gone :] + word(r.randint(0, 60))))
    quotes += [(900, None), (901, ""), (902, "x" * 200)]
    texts += [(900, None), (901, ""), (902, "x" * 90 + "y" * 24 + "x" * 90), (903, ("x" * 33 + "y" * 60) * 20)]
    q, d = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string")
    got = {tuple(x) for x in co.near_quotes(q, d).collect()}
    assert got == {(i, j) for i, a in quotes if a for j, b in texts if b is not None and plain(b, a)}
    assert sum(i == j for i, j in got) > 20


def test_repeats(spark):
    rows = [("abc", "b"), ("abc", ""), (None, "b"), ("b", None), ("x" * 40 + "1" * 24 + "y" * 40, "x" * 40 + "2" * 24 + "y" * 40), ("x" * 40 + "1" * 25 + "y" * 40, "x" * 40 + "2" * 25 + "y" * 40)]
    df = spark.createDataFrame(rows, "t string, q string")
    assert [r[0] for r in df.select(co.repeats(F.col("t"), F.col("q"))).collect()] == [True, True, None, None, True, False]
