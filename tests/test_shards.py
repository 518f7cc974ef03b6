"""Shards as a data source, and scans of a library: what has not changed is not opened."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lectern.sources import scan as sc
from lectern.streaming.shards import ShardSource


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(ShardSource)
    return spark


def put(folder, name, *lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{x}\n" for x in lines))
    at = time.time_ns() + put.n * 10**9
    put.n += 1
    os.utime(path, ns=(at, at))


put.n = 1


def test_batches(source, tmp_path):
    put(tmp_path, "a/2024-01.jsonl", '{"id": 1}', "", '{"id": 2}')
    put(tmp_path, "b/2024-01.jsonl", *['{"id": 3}'] * 6)
    put(tmp_path, "c/2024-01.jsonl", '{"id": "' + "x" * 500 + '"}')
    put(tmp_path, "note.txt", "no shard")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = source.read.format("lectern-shards").option("path", path).option("mostEvents", 5).option("mostBytes", 400).load()
        got = [(r["shard"], r["line"], r["json"], r["refused"]) for r in df.orderBy("shard", "line").collect()]
        assert got == [("a/2024-01.jsonl", 0, '{"id": 1}', None), ("a/2024-01.jsonl", 1, '{"id": 2}', None), ("b/2024-01.jsonl", None, None, "too many events"), ("c/2024-01.jsonl", None, None, "too many bytes")]
    assert source.read.format("lectern-shards").option("path", f"{tmp_path}/none").load().count() == 0


def test_stream_opens_changed_shards_only(source, tmp_path):
    """Three rounds over one checkpoint: all shards, none, the two that are new or changed; a removed one is not missed."""
    folder = tmp_path / "in"
    put(folder, "a.jsonl", "1", "2")
    put(folder, "b.jsonl", "3")
    put(folder, "c.jsonl", "4")
    rounds = []

    def run():
        opened = []
        df = source.readStream.format("lectern-shards").option("path", str(folder)).load()
        q = df.writeStream.foreachBatch(lambda b, _: opened.extend((r["shard"], r["json"]) for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True)
        try:
            q = q.start()
            q.awaitTermination(120)
        finally:
            rounds.append(sorted(opened))

    run()
    run()
    put(folder, "b.jsonl", "3", "5")
    put(folder, "d.jsonl", "6")
    (folder / "c.jsonl").unlink()
    run()
    assert rounds == [[("a.jsonl", "1"), ("a.jsonl", "2"), ("b.jsonl", "3"), ("c.jsonl", "4")], [], [("b.jsonl", "3"), ("b.jsonl", "5"), ("d.jsonl", "6")]]


def test_scan_opens_what_changed(spark, tmp_path):
    folder, side = tmp_path / "books", f"{tmp_path}/side"
    seen = []

    def read(files):
        seen.append(sorted(os.path.basename(r["path"]) for r in files.select("path").collect()))
        return files.where(F.length("content") > 2).select("path", F.decode("content", "UTF-8").alias("title"))

    def titles():
        return {os.path.basename(r["path"]): r["title"] for r in sc.scanned(spark, str(folder), side, read, "*.txt").collect()}

    put(folder, "a.txt", "alpha")
    put(folder, "x/b.txt", "beta")
    put(folder, "e.txt", "")
    assert titles() == {"a.txt": "alpha\n", "b.txt": "beta\n", "e.txt": None} and seen[-1] == ["a.txt", "b.txt", "e.txt"]
    assert len(titles()) == 3 and seen[-1] == []
    put(folder, "a.txt", "gamma")
    put(folder, "c.txt", "delta")
    (folder / "x/b.txt").unlink()
    assert titles() == {"a.txt": "gamma\n", "c.txt": "delta\n", "e.txt": None} and seen[-1] == ["a.txt", "c.txt"]
