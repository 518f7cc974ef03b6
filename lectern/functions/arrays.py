"""Runs over long arrays in Column expressions, and the places of matches in a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lectern.functions.text import bound

#: Elements whose results are appended to one list: as an append copies its list, long arrays are run through in parts.
PART = 256


def scanned(array: Column, zero: Column, step: Callable[[Column, Column], Column], state: str, emit: Callable[[Column], Column] | None = None, kind: str | None = None) -> Column:
    """What emit makes (of type kind; the states themselves by default) of the state after each element, nulls left out, in time
    near proportion to the length. zero and step give states of type state."""
    emit, kind = emit or (lambda s: s), kind or state
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / PART).cast("int") - 1, F.lit(0))), lambda k: F.slice(array, k * PART + 1, PART))
    empty = F.array().cast(f"array<{kind}>")

    def one(held: Column, x: Column) -> Column:
        def add(new: Column) -> Column:
            made = emit(new).cast(kind)
            return F.struct(new.alias("last"), F.when(made.isNull(), held["all"]).otherwise(F.array_append(held["all"], made)).alias("all"))

        return bound(step(held["last"], x).cast(state), add)

    def part(held: Column, some: Column) -> Column:
        inside = F.aggregate(some, F.struct(held["last"].alias("last"), empty.alias("all")), one)
        return bound(inside, lambda r: F.struct(r["last"].alias("last"), F.array_append(held["all"], r["all"]).alias("all")))

    start = F.struct(zero.cast(state).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.aggregate(parts, start, part, lambda s: F.flatten(s["all"]))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of non-overlapping matches of a pattern, by code points: lengths of the pieces between
    matches and of the matches add up to the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value"))), lambda x: x["value"].isNotNull())
    kind = "struct<start:int,end:int,value:string>"
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))

    def add(last: Column, x: Column) -> Column:
        at = last["end"] + x["gap"]
        return F.struct(at.alias("start"), (at + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    return bound(both, lambda b: scanned(b, zero, add, kind))


def enclosed(text: Column, pairs: dict[str, str]) -> Column:
    """Array of (start, end) of the outermost bracketed passages, whatever is nested in them.

    A closing bracket counts only if it closes the bracket opened last; others are plain characters. What is opened
    and never closed holds all that follows.
    """
    closer = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    pattern = "[" + "".join("\\" + c for pair in pairs.items() for c in pair) + "]"
    state = "struct<open:string,start:int,end:int>"
    zero = F.struct(F.lit("").alias("open"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, x: Column) -> Column:
        own = F.try_element_at(closer, x["value"])
        opened = F.struct(F.concat(own, s["open"]).alias("open"), F.when(s["open"] == "", x["start"]).otherwise(s["start"]).alias("start"), F.lit(None).cast("int").alias("end"))
        left = F.substring(s["open"], 2, 2147483647)
        closed = F.struct(left.alias("open"), s["start"].alias("start"), F.when(left == "", x["end"]).alias("end"))
        other = F.struct(s["open"].alias("open"), s["start"].alias("start"), F.lit(None).cast("int").alias("end"))
        return F.when(own.isNotNull(), opened).when(F.substring(s["open"], 1, 1) == x["value"], closed).otherwise(other)

    whole = lambda s: F.when(s["end"].isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return bound(match_spans(text, pattern), lambda p: scanned(p, zero, step, state, whole, "struct<start:int,end:int>"))
