"""Reading streams: ticks to events, idempotent arrival, late clears, daily windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import events as ev, intervals as iv

#: Rest that ends charging, pending time that is written, longest gap between ticks.
IDLE_MS, FLUSH_MS, GAP_MS = 300_000, 15_000, 5_000
OUT = "device string, session int, start bigint, end bigint, offset int, to double"
STATE = "last bigint, activity bigint, pending bigint, start bigint, offset int, session int, active boolean, progress double"
NEW = (None, 0, 0, 0, 0, 0, False, 0.0)


def advance(state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """State after a device's ticks (at, activity, eligible, offset, progress, in order), and the readings they complete.

    Time between ticks counts while the reader was active, up to the idle limit, unless the
    gap is too long. Pending time is written once it is long enough or reading stops; a
    stop begins a new session.
    """
    last, activity, pending, start, offset, session, active, progress = state
    out = []
    for at, acts, eligible, off, to in zip(rows["at"], rows["activity"], rows["eligible"], rows["offset"], rows["progress"], strict=True):
        gap = 0 if last is None else at - last
        if last is None:
            activity = at
        if active and eligible and 0 <= gap <= GAP_MS:
            amount = min(gap, max(0, min(IDLE_MS, IDLE_MS - (last - activity))))
            if pending == 0:
                start, offset = at - amount, off
            pending += amount
        if acts:
            activity = at
        on = bool(eligible) and at - activity < IDLE_MS
        progress = min(1.0, max(0.0, to))
        if pending and (pending >= FLUSH_MS or not on or gap > GAP_MS):
            out.append((session, start, start + pending, offset, progress))
            pending = 0
        if active and (not on or gap > GAP_MS):
            session += 1
        active, last = on, at
    return (last, activity, pending, start, offset, session, active, progress), out


def _frame(device: str, readings: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(readings, columns=["session", "start", "end", "offset", "to"])
    df.insert(0, "device", device)
    return df


def readings_of(ticks: DataFrame) -> DataFrame:
    """All readings that the ticks (device, at, activity, eligible, offset, progress) of a finished table complete."""
    names = ["device", "at", "activity", "eligible", "offset", "progress"]
    rows = ticks.select(*names).repartition("device").sortWithinPartitions("device", "at")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, NEW
        for pdf in frames:
            for key, part in pdf.groupby("device", sort=False):
                state = state if key == device else NEW
                device = key
                state, out = advance(state, part)
                yield _frame(key, out)

    return rows.mapInPandas(scan, OUT)


def reading_stream(ticks: DataFrame) -> DataFrame:
    """The same for a stream: state per device, ticks of a micro-batch taken in order of time."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else NEW
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        now, out = advance(now, rows)
        state.update(now)
        yield _frame(key[0], out)

    return ticks.groupBy("device").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def append_new(batch: DataFrame, path: str) -> None:
    """Write a micro-batch's events that the store at path does not hold yet: arrival in any order, any number of times."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["id"])
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        fresh = ev.new_only(fresh, spark.read.parquet(path))
    fresh.write.mode("append").parquet(path)


def totals(store: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Daily totals per book from the whole store, or of the given books only: late clears rewrite history, so the
    books a batch touches are computed anew."""
    mine = store if books is None else store.join(books.select("book").distinct(), "book", "left_semi")
    return iv.daily(ev.readings(ev.visible(mine)), "book")


def daily_counts(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Events by kind and UTC day of a stream with bounded lateness."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")


def shard_stream(spark, folder: str) -> DataFrame:
    """JSON shards of a folder as they appear; the checkpoint remembers which were taken."""
    return spark.readStream.format("text").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", 100).load(folder).withColumnRenamed("value", "json")
