"""Packing, importance resampling and fill-in-middle against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import infill, packing, resample
from lectern.llm.common import table
from lectern.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.oracle import expected, rows as plain_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def clashing(docs):
    """The edge-case documents with columns named like those of the results."""
    more = [(20, "<P> stands in it, several words here"), (21, "<|endoftext|> a <|startoftext|>b c d"), (22, "x" * 30_000), (23, " \n" * 500), (24, "é İΣ ﬁ 12 a1b2 don't WON'T"), (25, "words " * 30)]
    df = docs.sparkSession.createDataFrame(more, "doc_id long, text string")
    df = docs.unionByName(df, allowMissingColumns=True)
    for name in ("start", "length", "ids", "rank", "score", "weight", "form", "n", "prefix", "block", "bucket", "output"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3, "text")


# Packing


def check_packed(rows, texts, capacity=4096):
    """Every id of every document lies in one piece of one sequence, sequences have no gaps and no padding."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter((i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
    got = Counter()
    for (i, n), pieces in by_doc.items():
        chains = defaultdict(list)
        for start, ids in sorted(pieces, key=lambda p: (p[0], -len(p[1]))):
            chains[start].append(ids)
        copies = len(chains[0])
        for k in range(copies):
            joined = b""
            while len(joined) < 4 * n:
                joined += chains[len(joined) // 4].pop()
            got[i, joined] += 1
    assert got == want
    return by_sequence


def test_packing_of_edge_cases(clashing, no_docs):
    packed = packing.pack(clashing, tokenizer_path("word_bpe_49k.json"))
    check_packed(packed.collect(), [(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert packing.pack(no_docs, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_of_documents(spark):
    docs = table(spark, SF, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for group in (3, 256):
        packed = packing.pack(docs.repartition(2, "doc_id"), tokenizer_path("word_bpe_49k.json"), group_windows=group)
        by_sequence = check_packed(packed.collect(), texts)
        total = sum(n for places in by_sequence.values() for _, n in places)
        assert len(by_sequence) <= total // 4096 + 2 * 12
    out = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in out) == total and all(len(r["ids"]) == sum(r["lengths"]) == r["n_tokens"] for r in out)
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(packed).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(r["ids"]) for r in packed.collect())


def test_padding_of_sequences(spark):
    df = spark.createDataFrame([(1, 3, 0, np.arange(3, dtype="<u4").tobytes()), (2, 2, 0, np.arange(2, dtype="<u4").tobytes()), (2, 2, 2, np.arange(2, dtype="<u4").tobytes())], "sequence_id long, length long, offset long, ids binary")
    out = {r["sequence_id"]: r for r in packing.sequences(df, capacity=8, pad_id=9).collect()}
    assert out[1]["ids"] == [0, 1, 2, 9, 9, 9, 9, 9] and out[2]["ids"] == [0, 1, 0, 1] and out[2]["lengths"] == [2, 2]


def spread(sizes, at, k):
    sums = np.bincount(at, sizes, k)
    return sums.max() - sums.min()


def test_differencing():
    # fixed values: the example usually given for the two-way method, whose difference is 2
    assert spread([8, 7, 6, 5, 4], packing.differencing(np.array([8, 7, 6, 5, 4]), 2), 2) == 2
    rng = np.random.default_rng(5)
    for _ in range(40):
        k = int(rng.integers(2, 4))
        sizes = rng.integers(1, 50, int(rng.integers(1, 8)))
        best = min(spread(sizes, at, k) for at in itertools.product(range(k), repeat=len(sizes)))
        assert best <= spread(sizes, packing.differencing(sizes, k), k) <= best + sizes.max()
    many = rng.integers(1, 4096, 3000)
    assert spread(many, packing.differencing(many, 100), 100) <= 60
    assert packing.differencing(np.zeros(0, np.int64), 3).tolist() == []


def test_window_count_rises():
    """Five items of 2,100 fit three windows by their sum, but no two of them fit one."""
    found = packing.windows(np.full(5, 2100))
    assert len(found) == 5 and sorted(itertools.chain(*found)) == [0, 1, 2, 3, 4]
    full, left = packing.levelled([[(i, 0, 2100) for i in w] for w in found])
    assert [sum(n for _, _, n in w) for w in full] == [4096, 4096] and sum(n for _, _, n in left) == 10_500 - 8192
    cut = packing.powers(left)
    assert [sum(n for _, _, n in w) for w in cut] == [2048, 256, 4]
    assert packing.levelled([[(0, 0, 4096)]]) == ([[(0, 0, 4096)]], []) and packing.powers([]) == []


def test_words_are_apart_only_by_the_file(tmp_path):
    assert packing.of_file(tokenizer_path("word_bpe_49k.json")).cuts and not packing.of_file(tokenizer_path("byte_bpe_50k.json")).cuts


# Resampling


def plain_resample(texts, items, percent=10, least=20, buckets=10_000, seed=2024):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(bucket(w) for _, x in texts for w in cut(x)), Counter(bucket(w) for x in items for w in cut(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for k, (i, x) in enumerate(texts):
        w = cut(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in w)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[4]))
    rank = {r[4]: n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[4])) for r in out), key=repr)


@pytest.mark.parametrize("percent,least", [(10, 20), (60, 3)])
def test_resampling_of_edge_cases(clashing, no_docs, benchmark, percent, least):
    got = resample.resample(clashing, benchmark.withColumn("bucket", F.lit("clash")), percent=percent, least_words=least)
    got = sorted((tuple(r)[:5] for r in got.collect()), key=repr)
    texts, items = [(r["doc_id"], r["text"]) for r in clashing.collect()], [r["text"] for r in benchmark.collect()]
    assert got == plain_resample(texts, items, percent, least)
    assert resample.resample(no_docs, benchmark).count() == 0
    alone = resample.resample(clashing, benchmark.where("false")).collect()
    assert sorted((tuple(r)[:5] for r in alone), key=repr) == plain_resample(texts, [])


def test_resampling_of_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = sorted((tuple(r)[:5] for r in resample.resample(docs.repartition(5, "doc_id"), items).collect()), key=repr)
    assert got == plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()])
    picked = {r[0] for r in got if r[4]}
    assert {r["doc_id"] for r in resample.drawn(docs, items).collect()} == picked and resample.drawn(docs, items).columns == docs.columns


def test_runs_of_words():
    texts = pa.array(["A b  c", None, "", "...", "b", "É é"])
    found, n, words = resample.stream(texts, 10_000, 2)
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    want = [["a", "b", "c", "a b", "b c"], [], [], [], ["b"], ["É", "é", "É é"]]
    assert n.tolist() == [len(w) for w in want] and words.tolist() == [3, 0, 0, 0, 1, 2]
    assert found.tolist() == [bucket(w) for some in want for w in some]
    with pytest.raises(ValueError):
        resample.streams(None, buckets=1 << 17)


def test_equal_scores_go_by_place(spark, benchmark):
    """One id on every row: all scores are equal, ranks are still 1, 2, 3 ..."""
    df = spark.range(0, 400, 1, 7).select(F.lit(5).cast("long").alias("doc_id"), F.lit("w " * 25).alias("text"))
    got = resample.resample(df, benchmark, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201)) and len({r["score"] for r in got}) == 1


# Fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(i, text):
    text = text or ""
    units = UNIT.findall(text)
    told = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[8 * k : 8 * k + 8], 16) for k in range(4))
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_infill(spark, clashing, no_docs):
    more = spark.createDataFrame([(k, t) for k, t in enumerate(["<", "a<", "P>", "<<P", " <P ><S", "a\x00b\x85c", "\x0b\x0c", "😀 é\n\n\nß "] * 12, 100)], "doc_id long, text string")
    every = clashing.unionByName(more, allowMissingColumns=True).unionByName(table(spark, SF, "documents").select("doc_id", "text"), allowMissingColumns=True)
    made = infill.transform(every).cache()
    got = sorted((tuple(r) for r in infill.digest(made).collect()), key=repr)
    assert got == sorted((plain_infill(r["doc_id"], r["text"]) for r in every.collect()), key=repr)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    assert infill.digest(infill.transform(no_docs)).count() == 0


def test_infill_options(spark):
    df = spark.createDataFrame([(k, "one two [m] three" if k % 5 == 0 else "one two three") for k in range(200)], "doc_id long, text string")
    made = infill.transform(df, seed=7, transformed=100, suffix_first=0, marks=("[p]", "[s]", "[m]")).collect()
    assert all(r["form"] == ("plain" if r["doc_id"] % 5 == 0 else "psm") for r in made)
    assert len({(len(r["prefix"]), len(r["middle"])) for r in made if r["form"] == "psm"}) == 10


@pytest.mark.parametrize("name", ["op12_resampling", "op13_fill_in_middle"])
def test_sql(spark, name):
    assert plain_rows(QUERIES[name](spark, SF).toPandas()) == plain_rows(expected(ORACLE_SQL[name], SF))
