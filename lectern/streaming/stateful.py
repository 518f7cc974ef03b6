"""Streams with state per key: hybrid clocks of devices, and searches that stop at a number of hits.

Both need Spark's RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.search import SHOWN

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def hybrid(at: np.ndarray, wall: int, counter: int) -> tuple[np.ndarray, np.ndarray]:
    """Hybrid times of ticks at the physical times `at`, in order, after (wall, counter): the wall never goes back, and the
    counter counts the ticks since it last moved."""
    walls = np.maximum.accumulate(np.r_[wall, at])
    moved = np.r_[True, np.diff(walls) > 0]
    place = np.arange(len(walls))
    since = place - np.maximum.accumulate(np.where(moved, place, 0))
    # until the wall first moves the counter goes on from where it was
    return walls[1:], (since + np.where(np.cumsum(moved) == 1, counter, 0))[1:]


class HybridClock(StatefulProcessor):
    """One (wall, counter) per device; ticks of a batch are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "wall long, counter long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values("seq", kind="stable")
        wall, counter = self.last.get() if self.last.exists() else (-1, 0)
        walls, counters = hybrid(ticks["at"].to_numpy(np.int64), wall, counter)
        self.last.update((int(walls[-1]), int(counters[-1])))
        yield pd.DataFrame({"device": key[0], "seq": ticks["seq"].to_numpy(), "wall": walls, "counter": counters})

    def close(self) -> None:
        pass


def hybrid_times(ticks: DataFrame) -> DataFrame:
    """Stream or batch of (device, seq, at) to (device, seq, wall, counter); a late tick gets the next time, not an earlier one."""
    return ticks.select("device", "seq", "at").groupBy("device").transformWithStateInPandas(HybridClock(), "device string, seq long, wall long, counter long", "Append", "None")


class BoundedSearch(StatefulProcessor):
    """Hits of one search so far; nothing is looked at once there are `most`, and the state goes with the last section."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.found = handle.getValueState("found", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sections = pd.concat(list(rows)).sort_values("section", kind="stable")
        n = self.found.get()[0] if self.found.exists() else 0
        out = []
        for section, text, words in zip(sections["section"], sections["text"], sections["words"], strict=True):
            at = (text or "").find(words) if words and n < self.most else -1
            while at >= 0 and n < self.most:
                out.append((key[0], section, at, at + len(words)))
                n, at = n + 1, text.find(words, at + len(words))
        if sections["last"].any():
            self.found.clear()
        else:
            self.found.update((n,))
        yield pd.DataFrame(out, columns=["search", "section", "start", "end"])

    def close(self) -> None:
        pass


def search_hits(sections: DataFrame, most: int = SHOWN) -> DataFrame:
    """Stream or batch of (search, section, text, words, last) to hits (search, section, start, end), at most `most` for a search.

    Sections of a search must arrive in order over the batches; `last` marks its last. Empty words have no hits.
    """
    return sections.select("search", "section", "text", "words", "last").groupBy("search").transformWithStateInPandas(BoundedSearch(most), "search string, section long, start int, end int", "Append", "None")
