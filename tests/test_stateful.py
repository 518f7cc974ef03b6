"""Streams with state: equal to the batch form, over restarts."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.streaming import stateful as sf


def run(spark, make, folder, out, checkpoint):
    sf.with_state_store(spark)
    df = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(df).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def plain_times(ticks):
    wall, counter, out = -1, 0, []
    for at in ticks:
        wall, counter = (at, 0) if at > wall else (wall, counter + 1)
        out.append((wall, counter))
    return out


def test_hybrid_steps():
    r = random.Random(1)
    for _ in range(50):
        ticks = [r.randint(0, 20) for _ in range(r.randint(1, 30))]
        cut = r.randint(0, len(ticks))
        state, got = (-1, 0), []
        for part in (ticks[:cut], ticks[cut:]):
            if part:
                walls, counters = sf.hybrid(np.array(part), *state)
                got += list(zip(walls.tolist(), counters.tolist(), strict=True))
                state = got[-1]
        assert got == plain_times(ticks)


def test_clock_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    ticks = {d: [r.randint(0, 30) for _ in range(40)] for d in "xyz"}
    df = spark.createDataFrame([(d, k, at) for d, v in ticks.items() for k, at in enumerate(v)], "device string, seq long, at long")
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for n, (a, z) in enumerate(((0, 15), (15, 40))):
        df.where((F.col("seq") >= a) & (F.col("seq") < z)).coalesce(1).write.mode("append").parquet(src)
        run(spark, sf.hybrid_times, src, out, f"file://{tmp_path}/cp")
    got = {}
    for x in spark.read.parquet(out).orderBy("seq").collect():
        got.setdefault(x["device"], []).append((x["wall"], x["counter"]))
    assert got == {d: plain_times(v) for d, v in ticks.items()}
    batch = sorted(map(tuple, sf.hybrid_times(df).collect()))
    assert batch == sorted(map(tuple, spark.read.parquet(out).select("device", "seq", "wall", "counter").collect()))


def test_search_stops(spark, tmp_path):
    texts = {s: ["ab ab " * 3, None, "no", "ab" * 50, "ab"] for s in ("p", "q")}
    rows = [(s, k, t, "ab" if s == "p" else "b a", k == 4) for s, v in texts.items() for k, t in enumerate(v)] + [("e", 0, "abc", "", True)]
    df = spark.createDataFrame(rows, "search string, section long, text string, words string, last boolean")
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(5):
        df.where(F.col("section") == k).coalesce(1).write.mode("append").parquet(src)
        if k in (1, 4):
            run(spark, lambda d: sf.search_hits(d, most=20), src, out, f"file://{tmp_path}/cp")
    got = sorted(map(tuple, spark.read.parquet(out).select("search", "section", "start", "end").collect()))
    want = []
    for s, v in texts.items():
        words, n = ("ab" if s == "p" else "b a"), 0
        for k, t in enumerate(v):
            at = (t or "").find(words)
            while at >= 0 and n < 20:
                want.append((s, k, at, at + len(words)))
                n, at = n + 1, t.find(words, at + len(words))
    assert got == sorted(want) and sum(s == "p" for s, *_ in got) == 20
