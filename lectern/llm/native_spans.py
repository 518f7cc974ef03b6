"""Spans of regular expressions, and runs over arrays, as Column expressions without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Elements of an array that are appended to one list: long arrays are run through in parts, as every append copies its list.
PART = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def running(array: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """States (of type kind) after each element of the array, from zero on, in time near proportion to its length."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / PART).cast("int") - 1, F.lit(0))), lambda k: F.slice(array, k * PART + 1, PART))

    def one(state: Column, x: Column) -> Column:
        return let(step(state["last"], x), lambda new: F.struct(new.alias("last"), F.array_append(state["all"], new).alias("all")))

    def part(state: Column, some: Column) -> Column:
        inside = F.aggregate(some, F.struct(state["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("all")), one)
        return let(inside, lambda r: F.struct(r["last"].alias("last"), F.array_append(state["all"], r["all"]).alias("all")))

    start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.aggregate(parts, start, part, lambda s: F.flatten(s["all"]))


def spans(text: Column, pattern: str, worth: Column | None = None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places. worth: a cheap test without which there is no match.
    context: how many characters between the last match and this one to give as `before`.

    The pieces between matches and the matches themselves, by length, add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    made = lambda piece, value: F.struct(F.length(piece).alias("gap"), value.alias("value"), *([F.right(piece, F.lit(context)).alias("before")] if context else []))
    both = F.filter(F.zip_with(pieces, found, made), lambda x: x["value"].isNotNull())
    kind = "struct<start:int,end:int,value:string" + (",before:string>" if context else ">")
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"), *([F.lit("").alias("before")] if context else []))

    def add(last: Column, x: Column) -> Column:
        at = last["end"] + x["gap"]
        return F.struct(at.alias("start"), (at + F.length(x["value"])).alias("end"), x["value"].alias("value"), *([x["before"].alias("before")] if context else []))

    out = let(both, lambda b: running(b, zero, add, kind))
    return F.when(worth, out).otherwise(F.array().cast(f"array<{kind}>")) if worth is not None else out


def apart_from(candidates: Column, base: Column, kind: str) -> Column:
    """The candidates (array type kind), by start, that no base span overlaps.

    In order of start, a candidate is free if no base span before it ends behind its start and
    the next base span does not start before its end: one run in each direction.
    """
    def entry(x: Column, k: int, whole: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), whole.alias("whole"))

    both = F.sort_array(F.concat(F.transform(base, lambda x: entry(x, 0, F.lit(None).cast(kind[6:-1]))), F.transform(candidates, lambda x: entry(x, 1, x))))

    def free(every: Column) -> Column:
        before = running(every, F.lit(0), lambda last, x: F.when(x["k"] == 0, F.greatest(last, x["end"])).otherwise(last), "int")
        behind = running(F.reverse(every), F.lit(2**31 - 1), lambda last, x: F.when(x["k"] == 0, x["start"]).otherwise(last), "int")
        edges = F.zip_with(before, F.reverse(behind), lambda a, z: F.struct(a.alias("a"), z.alias("z")))
        told = F.zip_with(every, edges, lambda x, e: F.when((x["k"] == 1) & (e["a"] <= x["start"]) & (e["z"] >= x["end"]), x["whole"]))
        return F.filter(told, lambda x: x.isNotNull())

    return F.when(F.size(base) == 0, F.sort_array(candidates)).otherwise(let(both, free)).cast(kind)


def listed(kinds: dict[str, Column]) -> Column:
    """All spans as `kind:start:end` by start, then kind in the given order, then end, joined by commas."""
    def tagged(k: int, name: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(name).alias("name")))

    every = [tagged(k, name, c) for k, (name, c) in enumerate(kinds.items())]
    return F.array_join(F.transform(F.sort_array(F.concat(*every)), lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
