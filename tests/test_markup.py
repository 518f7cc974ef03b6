"""Markup of styles there and back, and links in nested JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import markup as mk
from lectern.operators import json_links as jl

KIND = "array<struct<text:string,marks:array<string>,atom:int>>"


def plain_canonical(runs):
    out = []
    for text, marks, atom in runs:
        marks = [s for s in mk.STYLES if s in marks]
        if atom is not None:
            out.append((mk.HELD, marks, atom))
        elif text:
            if out and out[-1][1] == marks and out[-1][2] is None:
                out[-1] = (out[-1][0] + text, marks, None)
            else:
                out.append((text, marks, None))
    return out


def test_round_trip(spark):
    r = random.Random(6)
    rows = []
    for k in range(300):
        atoms = 0
        runs = []
        for _ in range(r.randint(0, 7)):
            atom = atoms if r.random() < 0.2 else None
            atoms += atom is not None
            runs.append(("" if atom is not None else r.choice(["", "a", "x < y & z > w", "&lt;b&gt;", "é😀 ", "<strong>", "</em>", "\\n"]), r.sample([*mk.STYLES, "blink"], r.randint(0, 3)), atom))
        rows.append((k, runs, atoms))
    df = spark.createDataFrame(rows, f"k int, runs {KIND}, atoms int")
    out = df.withColumn("m", mk.encoded(F.col("runs"))).withColumn("d", mk.decoded(F.col("m"), F.col("atoms"))).collect()
    for x, (_, runs, _) in zip(sorted(out, key=lambda x: x["k"]), rows, strict=True):
        assert x["d"]["error"] is None, x["m"]
        assert [(d["text"], d["marks"], d["atom"]) for d in x["d"]["runs"]] == plain_canonical(runs)


@pytest.mark.parametrize("text, atoms, error", [
    ("<strong>a<em>b</em></strong>", 0, None), ("<strong>a<em>b</strong></em>", 0, "crossed"), ("a</em>", 0, "stray"), ("<em>a", 0, "unclosed"), ("<b>a</b>", 0, "unknown tag"), ("a < b", 0, "stray"), ("<em/>", 0, "unknown tag"),
    ("<t-atom-0/>x<t-atom-1/>", 2, None), ("<t-atom-1/>x<t-atom-0/>", 2, None), ("<t-atom-0/>", 2, "atoms"), ("<t-atom-0/><t-atom-0/>", 1, "atoms"), ("<t-atom-5/>", 1, "atoms"), ("", 0, None), ("", 1, "atoms"), ("a &lt;em&gt; b", 0, None)])
def test_tokens(spark, text, atoms, error):
    d = spark.range(1).select(mk.decoded(F.lit(text), F.lit(atoms)).alias("d")).first()["d"]
    assert d["error"] == error and (d["runs"] is None) == (error is not None)


def plain_links(value):
    out, seen = [], set()

    def walk(v, depth):
        if depth > jl.DEEPEST:
            return
        if isinstance(v, list):
            for x in v:
                walk(x, depth + 1)
        elif isinstance(v, dict):
            title = next((str(v[k]) for k in jl.TITLE_KEYS if isinstance(v.get(k), str)), None)
            for k in sorted(v):
                x = v[k]
                if k in jl.LINK_KEYS and isinstance(x, str) and x.lower().startswith(("http://", "https://")) and len(x) > 8:
                    if x not in seen:
                        seen.add(x)
                        out.append((x, title))
                else:
                    walk(x, depth + 1)

    walk(value, 0)
    return out[: jl.MOST_LINKS]


def test_links_in_nested_json(spark):
    r = random.Random(8)

    def make(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([1, None, True, "s", "http://in.text/x"])
        if r.random() < 0.4:
            return [make(depth - 1) for _ in range(r.randint(0, 3))]
        return {r.choice(["url", "uri", "title", "name", "a", "b"]): r.choice([f"https://h/{r.randint(0, 9)}", make(depth - 1), "T"]) for _ in range(r.randint(0, 4))}

    values = [make(6) for _ in range(60)] + [[{"url": f"http://h/{k}"} for k in range(40)], {"a": [{"b": {"url": "http://deep/x", "title": "D"}}]}]
    deep = {"url": "http://end/x"}
    for _ in range(23):
        deep = {"a": deep}
    values += [deep, {"a": deep}, {"a": {"a": deep}}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, "no {json"), (901, None), (902, "")], "k int, json string")
    got = {}
    for x in jl.links(df, "k").orderBy("k", "ord").collect():
        got.setdefault(x["k"], []).append((x["url"], x["title"]))
    assert got == {k: w for k, v in enumerate(values) if (w := plain_links(v))}
