"""Style runs as markup for a translator, and back, with every token checked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions.arrays import scanned
from lectern.functions.text import bound

# Tags of styles, outermost first, and what stands for something that is no text.
STYLES = ("noteref", "noteback", "strong", "em", "i", "cite", "t-italic", "u", "s", "sup", "sub")
ATOM, HELD = "t-atom", "￼"
TOKEN = r"</?[a-z][a-z0-9-]*/?>"
RUNS = "array<struct<text:string,marks:array<string>,atom:int>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def canonical(runs: Column) -> Column:
    """Runs (text, marks, atom) with marks in the order of STYLES, each once, unknown ones left out; empty ones go, equal neighbours join."""
    tidy = F.transform(runs, lambda r: F.struct(r["text"].alias("text"), F.filter(F.array(*[F.lit(s) for s in STYLES]), lambda s: F.array_contains(r["marks"], s)).alias("marks"), r["atom"].alias("atom")).cast(RUNS[6:-1]))
    some = F.filter(tidy, lambda r: r["atom"].isNotNull() | (F.length(r["text"]) > 0))
    # the number of the run that each belongs to; texts of one number are joined
    state = "struct<n:int,marks:array<string>,atom:boolean,text:string>"
    zero = F.struct(F.lit(-1).alias("n"), F.array().cast("array<string>").alias("marks"), F.lit(True).alias("atom"), F.lit("").alias("text"))

    def step(s: Column, r: Column) -> Column:
        goes_on = ~s["atom"] & r["atom"].isNull() & (s["marks"] == r["marks"])
        return F.struct(F.when(goes_on, s["n"]).otherwise(s["n"] + 1).alias("n"), r["marks"].alias("marks"), r["atom"].isNotNull().alias("atom"), r["text"].alias("text"))

    def joined(list_: Column) -> Column:
        numbers = scanned(list_, zero, step, state, lambda s: s["n"], "int")

        def whole(n: Column) -> Column:
            both = F.zip_with(list_, n, lambda r, k: F.struct(k.alias("k"), r.alias("r")))
            first = F.filter(F.transform(both, lambda b, i: F.struct(b["k"].alias("k"), b["r"].alias("r"), ((i == 0) | (F.get(n, i - 1) != b["k"])).alias("first"), i.alias("i"))), lambda b: b["first"])
            ends = F.concat(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda b: b["i"]), F.array(F.size(list_)))
            text = lambda a, z: F.array_join(F.transform(F.slice(list_, a + 1, z - a), lambda r: r["text"]), "")
            made = F.zip_with(first, ends, lambda b, z: F.struct(F.when(b["r"]["atom"].isNull(), text(b["i"], z)).otherwise(HELD).alias("text"), b["r"]["marks"].alias("marks"), b["r"]["atom"].alias("atom")))
            return F.when(F.size(list_) == 0, F.array().cast(RUNS)).otherwise(made.cast(RUNS))

        return bound(numbers, whole)

    return bound(some, joined)


def encoded(runs: Column) -> Column:
    """Markup of runs: tags of a run's marks around its text, or around a token for its atom."""
    open_ = lambda m: F.array_join(F.transform(m, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    close = lambda m: F.array_join(F.transform(F.reverse(m), lambda s: F.concat(F.lit("</"), s, F.lit(">"))), "")
    inner = lambda r: F.when(r["atom"].isNull(), escaped(r["text"])).otherwise(F.concat(F.lit(f"<{ATOM}-"), r["atom"].cast("string"), F.lit("/>")))
    return F.array_join(F.transform(canonical(runs), lambda r: F.concat(open_(r["marks"]), inner(r), close(r["marks"]))), "")


def decoded(markup: Column, atoms: Column) -> Column:
    """Struct of runs and error. atoms: how many atoms there must be, numbered from 0, each once.

    error, the first from the left: `unknown tag`, `crossed` (an end that does not end what began last), `stray` (an end of
    nothing, or a bare angle bracket), `unclosed`, `atoms`; runs are null if there is one.
    """
    gaps, found = F.split(markup, TOKEN, -1), F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("tag"))
    state = "struct<open:array<string>,error:string,gap:string,inside:array<string>,atom:int>"
    none = F.lit(None).cast("string")
    zero = F.struct(F.array().cast("array<string>").alias("open"), none.alias("error"), F.lit("").alias("gap"), F.array().cast("array<string>").alias("inside"), F.lit(None).cast("int").alias("atom"))
    known = F.array(*[F.lit(s) for s in STYLES])

    def step(s: Column, x: Column) -> Column:
        tag = F.coalesce(x["tag"], F.lit(""))
        name, ends = F.regexp_replace(tag, "[</>]", ""), tag.startswith("</")
        atom = F.when(tag.endswith("/>"), F.regexp_extract(tag, f"^<{ATOM}-([0-9]{{1,9}})/>$", 1).try_cast("int"))
        top = F.try_element_at(s["open"], F.lit(-1))
        wrong = (F.when(x["gap"].rlike("[<>]"), "stray").when(tag == "", F.when(F.size(s["open"]) > 0, "unclosed")).when(atom.isNotNull(), none).when(~F.array_contains(known, name) | tag.endswith("/>"), "unknown tag")
                 .when(ends & top.isNull(), "stray").when(ends & (top != name), "crossed"))
        open_ = (F.when((tag == "") | atom.isNotNull() | wrong.isNotNull(), s["open"]).when(ends, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(F.array_append(s["open"], name)))
        return F.struct(open_.alias("open"), F.coalesce(s["error"], wrong).alias("error"), x["gap"].alias("gap"), s["open"].alias("inside"), atom.alias("atom"))

    emit = lambda s: F.struct(s["error"].alias("error"), s["gap"].alias("gap"), s["inside"].alias("inside"), s["atom"].alias("atom"))

    def told(steps: Column) -> Column:
        texts = F.transform(steps, lambda e: F.struct(unescaped(e["gap"]).alias("text"), e["inside"].alias("marks"), F.lit(None).cast("int").alias("atom")).cast(RUNS[6:-1]))
        held = F.transform(steps, lambda e: F.struct(F.when(e["atom"].isNotNull(), HELD).otherwise("").alias("text"), e["inside"].alias("marks"), e["atom"].alias("atom")).cast(RUNS[6:-1]))
        every = F.flatten(F.zip_with(texts, held, lambda a, b: F.array(a, b)))
        numbers = F.array_sort(F.array_compact(F.transform(steps, lambda e: e["atom"])))
        whole = F.when(atoms > 0, F.sequence(F.lit(0), F.greatest(atoms - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        error = F.coalesce(F.try_element_at(steps, F.lit(-1))["error"], F.when(numbers != whole, "atoms"))
        return bound(error, lambda e: F.struct(F.when(e.isNull(), canonical(every)).alias("runs"), e.alias("error")))

    return bound(scanned(pieces, zero, step, state, emit, "struct<error:string,gap:string,inside:array<string>,atom:int>"), told)
