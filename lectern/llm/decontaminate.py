"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is ten
consecutive words of an item; an item with fewer words (but some) is one window. The
automaton reads each normalised document once; word offsets lead back to the original.

Defined cases: null or empty texts have no words and no hits; null or empty items have no
windows; repeated items and windows count once per item id; repeated documents are rows of
their own; null item ids take part in the scan but not in the list of ids; extra columns
are ignored. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import alnum_words, map_rows, stored

#: Words of a window.
WINDOW = 10
#: Benchmark characters in one automaton (some tens of MB of it); a larger benchmark is scanned in several blocks.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    """Space-joined windows of an item, each once."""
    words = [w.decode() for w in alnum_words(text)]
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))) if words else []


def scanner(items: list[tuple[object, str]], size: int = WINDOW) -> Callable[[str | None], tuple[int, np.ndarray, list[int]]]:
    """A function from a text to its number of words, a mask of hit words and the places in `items` that occur."""
    owners: dict[str, list[int]] = {}
    for at, (_, text) in enumerate(items):
        for window in windows(text, size):
            owners.setdefault(window, []).append(at)
    automaton = ahocorasick.Automaton()
    for window, at in owners.items():
        automaton.add_word(f" {window} ", (window.count(" ") + 1, at))
    automaton.make_automaton()

    def scan(text: str | None) -> tuple[int, np.ndarray, list[int]]:
        words = alnum_words(text)
        if not words or not owners:
            return len(words), np.zeros(0, bool), []
        normal = " " + b" ".join(words).decode() + " "
        found = list(automaton.iter(normal))
        if not found:
            return len(words), np.zeros(0, bool), []
        ends = np.cumsum([len(w.decode()) + 1 for w in words])  # offset of the space after each word
        edge = np.zeros(len(words) + 1, np.int64)
        hit: set[int] = set()
        last = np.searchsorted(ends, [end for end, _ in found])
        for word, (_, (n, at)) in zip(last, found, strict=True):
            edge[word - n + 1] += 1
            edge[word + 1] -= 1
            hit.update(at)
        return len(words), np.cumsum(edge[:-1]) > 0, sorted(hit)

    return scan


def spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the original text that runs of hit words cover."""
    out: list[tuple[int, int]] = []
    before = False
    for word, now in zip(WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)})), mask, strict=True):
        if now:
            out[-1:] = [(out[-1][0], word.end())] if before else [*out[-1:], word.span()]
        before = bool(now)
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about `chars` characters the benchmark has, and these, each collected when it is asked for."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // chars)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n))))
    return n, ([(r["item"], r["text"]) for r in dealt.where(F.col("block") == k).collect()] for k in range(n))


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hits_of(documents: DataFrame, text_col: str, sent: Broadcast, size: int) -> DataFrame:
    """Per text that one block of the benchmark hits: key (its hash), items (ids as strings) and hits (words); equal texts repeat."""
    def make() -> Callable:
        scan, items = scanner(sent.value, size), sent.value

        def one(cols: dict) -> dict:
            out = {"key": [], "items": [], "hits": []}
            for key, text in zip(cols["key"], cols["text"], strict=True):
                _, mask, found = scan(text)
                if found:
                    out["key"].append(key)
                    out["items"].append(sorted({str(items[i][0]) for i in found if items[i][0] is not None}))
                    out["hits"].append(np.flatnonzero(mask).tolist())
            return out

        return one

    rows = documents.where(F.length(text_col) > 0).select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "key string, items array<string>, hits array<int>")


def hits(documents: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each different text that the benchmark hits: key, items, hits.

    One block of the benchmark is in the driver and broadcast at a time. Of several, what each hits is written, which is little;
    the documents are only read again, and what the blocks say of a text is put together at the end.
    """
    n, each = blocks(benchmark, item_col, item_text_col)
    context, found = documents.sparkSession.sparkContext, []
    for block in each if n else [[]]:
        sent = context.broadcast(block)
        rows = hits_of(documents, text_col, sent, size)
        if n <= 1:
            found.append(rows)
        else:
            found.append(stored(rows, "benchmark-hits"))
            sent.destroy()
    whole = reduce(DataFrame.unionByName, found)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return whole.groupBy("key").agg(together("items").alias("items"), together("hits").alias("hits"))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids as strings)
    and spans (hit ranges of the original text, code points, end exclusive)."""
    kind = documents.schema[id_col].dataType.simpleString()
    df = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n, each = blocks(benchmark, item_col, item_text_col)
    if n <= 1:
        sent = documents.sparkSession.sparkContext.broadcast(next(each, []))
        return finished(df, kind, lambda: scanner(sent.value, size), lambda: sent.value)
    met = df.withColumn("key", text_key(F.col("text"))).join(hits(documents, benchmark, item_col, item_text_col, text_col, size), "key", "left")
    return finished(met.select("doc_id", "text", "items", "hits"), kind)


def finished(df: DataFrame, kind: str, scan_of: Callable | None = None, items_of: Callable | None = None) -> DataFrame:
    """The result rows of documents, whose hits are columns of df or are found here by a scanner."""
    def make() -> Callable:
        scan, known = (scan_of(), items_of()) if scan_of else (None, None)

        def one(cols: dict) -> dict:
            n_words, hit, items, ranges = [], [], [], []
            for k, text in enumerate(cols["text"]):
                if scan:
                    n, mask, found = scan(text)
                    names, mask = sorted({str(known[i][0]) for i in found if known[i][0] is not None}), mask if len(found) else np.zeros(0, bool)
                else:
                    n, names = len(alnum_words(text)), cols["items"][k] or []
                    mask = np.zeros(n, bool)
                    mask[cols["hits"][k] or []] = True
                n_words.append(n)
                items.append(names)
                hit.append(int(mask.sum()))
                ranges.append([{"start": a, "end": b} for a, b in spans(text, mask)] if hit[-1] else [])
            return {"doc_id": cols["doc_id"], "n_words": n_words, "n_hit": hit, "n_items": [len(i) for i in items], "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
                    "contaminated": [h > 0 for h in hit], "items": items, "spans": ranges}

        return one

    return map_rows(df, make, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: int, end: int>>")


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("text"))
    n, each = blocks(items)
    if n > 1:
        found = hits(documents, items, "item_id", "text", text_col, size).select(F.col("key").alias("_hit_key"))
        return documents.join(found, text_key(F.col(text_col)) == F.col("_hit_key"), "left_anti")
    sent = documents.sparkSession.sparkContext.broadcast(next(each, []))

    @F.pandas_udf("boolean")
    def occurs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner(sent.value, size)
        for texts in batches:
            yield pd.Series([bool(scan(t)[2]) for t in texts], dtype=bool)

    return documents.where(~occurs(F.col(text_col)))


#: DuckDB: the grams of each length that some window has, joined by their text.
ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
        FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
gram AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
         FROM dw, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, item_id, i, gram.n FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
