"""Reading events: decoding, validation, duplicates, clears, and the fold per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

READING = "struct<start:bigint,end:bigint,offset:int,session:string,from:double,to:double>"
STATUS = "struct<status:string,finished:string>"
METADATA = "struct<title:string,authors:string,added:bigint>"
# Limits of a valid event.
MOST_AT, MOST_TEXT, MOST_SPAN, MOST_OFFSET = 8_640_000_000_000_000, 128, 60_000, 86_400
STATUSES = ("NotStarted", "Reading", "Finished")
#: Milliseconds from which a session counts.
SESSION_MS = 30_000


def decode(events: DataFrame, json: str = "json", most_span: int | None = MOST_SPAN) -> DataFrame:
    """Columns id, device, book, at, kind, reading, status, metadata, valid from one JSON text per row.

    The union is tagged from outside: `"Clear"`, or an object with one member named by the kind. most_span: see `is_valid`.
    """
    # `inline` parses each text once; a projection would be copied into every filter on its fields
    head = F.from_json(json, "id string, device string, book string, at bigint, kind string")
    df = events.select("*", F.inline(F.array(head))).withColumnRenamed("kind", "raw")
    keys = F.json_object_keys("raw")
    kind = F.when(F.col("raw") == "Clear", "Clear").when(F.size(keys) == 1, keys[0])
    parsed = F.from_json("raw", f"Reading {READING}, Status {STATUS}, Metadata {METADATA}")
    df = df.select("*", F.inline(F.array(F.struct(kind.alias("kind"), parsed.alias("body"))))).drop("raw")
    df = df.withColumns({"reading": F.col("body.Reading"), "status": F.col("body.Status"), "metadata": F.col("body.Metadata")}).drop("body")
    return df.withColumn("valid", F.coalesce(is_valid(most_span), F.lit(False)))


def is_canonical_date(text: Column) -> Column:
    """Parses as a date and prints as the same text."""
    return F.coalesce(F.date_format(text.try_cast("date"), "yyyy-MM-dd") == text, F.lit(False))


def is_valid(most_span: int | None = MOST_SPAN) -> Column:
    """Whether an event of decoded columns keeps the limits; a reading may last most_span milliseconds, any time if that is None."""
    short = lambda c: F.length(c).between(1, MOST_TEXT)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    r, s, m = "reading.", "status.", "metadata."
    start, end = F.col(r + "start"), F.col(r + "end")
    reading = (start >= 0) & (start <= end) & (F.lit(True) if most_span is None else end - start <= most_span) & (F.abs(F.col(r + "offset")) <= MOST_OFFSET) & (F.length(r + "session") <= MOST_TEXT) & finite(F.col(r + "from")) & finite(F.col(r + "to"))
    status = F.col(s + "status").isin(*STATUSES) & (F.col(s + "finished").isNull() | is_canonical_date(F.col(s + "finished")))
    metadata = F.col(m + "title").isNotNull() & F.col(m + "authors").isNotNull() & F.col(m + "added").isNotNull()
    by_kind = F.when(F.col("kind") == "Clear", True).when(F.col("kind") == "Reading", reading).when(F.col("kind") == "Status", status).when(F.col("kind") == "Metadata", metadata).otherwise(False)
    return short(F.col("id")) & short(F.col("device")) & short(F.col("book")) & F.col("at").between(0, MOST_AT) & by_kind


def by_id(events: DataFrame, arrival: str, keep: str = "first") -> DataFrame:
    """One event per id: the first to arrive (as the store keeps it) or the last (as the fold takes it)."""
    order = F.col(arrival).asc() if keep == "first" else F.col(arrival).desc()
    return events.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n")


def new_only(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """Arriving events whose id is not known yet, each once: an insert that ignores repeats."""
    return arriving.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])


def visible(events: DataFrame) -> DataFrame:
    """Without clears and what they hide: per book, metadata stays, the rest only after the latest clear by (at, id)."""
    clears = events.where("kind = 'Clear'").groupBy("book").agg(F.max(F.struct("at", "id")).alias("_clear")).withColumnRenamed("book", "_book")
    shown = (F.col("kind") == "Metadata") | F.coalesce(F.struct("at", "id") > F.col("_clear"), F.lit(True))
    return events.where("kind <> 'Clear'").join(clears, F.col("book") == F.col("_book"), "left").where(shown).drop("_clear", "_book")


def readings(shown: DataFrame) -> DataFrame:
    """Reading events as columns, with the session's total of raw lengths and whether it counts."""
    df = shown.where("kind = 'Reading'").select("id", "device", "book", "at", F.col("reading.start").alias("start"), F.col("reading.end").alias("end"),
                                               F.col("reading.offset").alias("offset"), F.col("reading.session").alias("session"), F.col("reading.to").alias("to"))
    total = F.sum(F.col("end") - F.col("start")).over(W.partitionBy("book", "session"))
    return df.withColumn("session_ms", total).withColumn("qualified", F.col("session_ms") >= SESSION_MS)


def fold(shown: DataFrame) -> DataFrame:
    """Per book: status, finished, progress, started, last, title, authors, added, in the order (at, id).

    The last status stands; a counting session turns "not started" into "reading" if it comes
    later, and stands in where no status was set. `added` is the least of the metadata events
    after the last one that reset it to 0.
    """
    at = F.struct("at", "id")
    length = F.sum(F.when(F.col("kind") == "Reading", F.col("reading.end") - F.col("reading.start"))).over(W.partitionBy("book", "reading.session"))
    df = shown.withColumn("_counts", F.coalesce((F.col("kind") == "Reading") & (length >= SESSION_MS), F.lit(False)))
    zero = F.max(F.when(F.col("metadata.added") == 0, at)).over(W.partitionBy("book"))
    df = df.withColumn("_zero", zero)
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    added = F.when((F.col("kind") == "Metadata") & (F.col("metadata.added") > 0) & F.coalesce(at > F.col("_zero"), F.lit(True)), F.col("metadata.added"))
    out = df.groupBy("book").agg(
        F.max(when("Status", F.struct("at", "id", "status"))).alias("s"), F.max(F.when(F.col("_counts"), at)).alias("r"),
        F.max(when("Reading", F.struct("at", "id", F.least(F.greatest("reading.to", F.lit(0.0)), F.lit(1.0)).alias("to"))))["to"].alias("progress"),
        F.min(F.when(F.col("_counts"), F.col("reading.start"))).alias("started"), F.max(F.when(F.col("_counts"), F.col("reading.end"))).alias("last"),
        F.max(when("Metadata", F.struct("at", "id", "metadata"))).alias("m"), F.coalesce(F.min(added), F.lit(0)).cast("long").alias("added"))
    late = F.struct(F.col("r.at"), F.col("r.id")) > F.struct(F.col("s.at"), F.col("s.id"))
    status = (F.when(F.col("s").isNull(), F.when(F.col("r").isNotNull(), "Reading").otherwise("NotStarted"))
              .when((F.col("s.status.status") == "NotStarted") & F.col("r").isNotNull() & late, "Reading").otherwise(F.col("s.status.status")))
    return out.select("book", status.alias("status"), F.col("s.status.finished").alias("finished"), F.coalesce("progress", F.lit(0.0)).alias("progress"),
                      "started", "last", F.col("m.metadata.title").alias("title"), F.col("m.metadata.authors").alias("authors"), "added")


def changed_metadata(current: DataFrame, stated: DataFrame) -> DataFrame:
    """Books whose stated title or authors differ from the current ones, or that are new: what has to be registered."""
    c = current.select(F.col("book").alias("_b"), F.col("title").alias("_t"), F.col("authors").alias("_a"))
    same = F.col("title").eqNullSafe(F.col("_t")) & F.col("authors").eqNullSafe(F.col("_a"))
    return stated.join(c, F.col("book") == F.col("_b"), "left").where(F.col("_b").isNull() | ~same).drop("_b", "_t", "_a")


def shards(events: DataFrame) -> DataFrame:
    """Events with month (UTC) and the name of their shard, `device-month.json`."""
    month = F.date_format(F.timestamp_millis("at"), "yyyy-MM")
    return events.withColumn("month", month).withColumn("shard", F.concat("device", F.lit("-"), "month", F.lit(".json")))
