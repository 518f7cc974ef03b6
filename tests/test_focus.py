"""Groups that are read together, against a plain walk."""

import random

from lectern.operators import focus as fc

SCHEMA = "s int, ord int, kind string, node string, depth int, list int, picture boolean, boundary boolean"


def plain(blocks):
    groups, start, depth, only = {}, None, None, False
    for i, (_, ord_, kind, node, d, li, picture, boundary) in enumerate(blocks):
        if boundary:
            start, depth, only = None, None, False
        if kind in fc.APART:
            continue
        members = groups.get(start, [])
        previous = members[-1] if members else None
        body = next((b for b in reversed(members) if b[2] in fc.TEXTS and not b[3].endswith(fc.COMPANION)), None)
        text, item = kind in fc.TEXTS, kind == "item"
        companion = bool(text and previous and previous[2] in fc.TEXTS and node == previous[3] + fc.COMPANION)
        joins = bool(previous) and (
            only or companion or (kind == "caption" and previous[2] == "image") or (item and depth is not None and d >= depth and li == (body[5] if body else None))
            or (item and depth is None and body is not None and body[2] == "paragraph" and not body[6]))
        if not joins:
            start, depth, only = ord_, None, kind == "heading"
            groups[start] = []
        groups[start].append(blocks[i])
        if kind != "heading" and not companion:
            only = False
        if item:
            depth = d if depth is None else depth
        elif not companion:
            depth = None
    return {b[1]: g for g, members in groups.items() for b in members}


def test_against_a_walk(spark):
    r = random.Random(5)
    rows = []
    for s in range(300):
        last = "n"
        for k in range(r.randint(1, 14)):
            kind = r.choice(["heading", "paragraph", "paragraph", "item", "item", "item", "caption", "image", "table", "separator", "page break", "quote"])
            node = f"{last}{fc.COMPANION}" if r.random() < 0.2 else f"n{k}"
            rows.append((s, k, kind, node, r.randint(0, 2) if kind == "item" else None, r.choice([1, 2, None]) if kind == "item" else None, r.random() < 0.2, r.random() < 0.1))
            last = node
    got = {}
    for x in fc.focus_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), "s").collect():
        got.setdefault(x["s"], {})[x["ord"]] = x["group"]
    for s in range(300):
        mine = [x for x in rows if x[0] == s]
        assert got.get(s, {}) == plain(mine), mine


def test_known_groups(spark):
    kinds = [("heading", "h", None, None), ("paragraph", "a", None, None), ("paragraph", "a@translation", None, None), ("item", "b", 0, None), ("item", "c", 1, None), ("item", "d", 0, None), ("paragraph", "e", None, None)]
    rows = [(1, k, kind, node, d, li, False, False) for k, (kind, node, d, li) in enumerate(kinds)]
    got = {x["ord"]: x["group"] for x in fc.focus_groups(spark.createDataFrame(rows, SCHEMA), "s").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6}
    assert fc.focus_groups(spark.createDataFrame([], SCHEMA), "s").count() == 0
