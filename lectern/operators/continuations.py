"""Quotes that a text repeats, word for word or with one change inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.arrays import scanned
from lectern.functions.text import bound
from lectern.operators.search import quote_pairs

#: Characters at either end of a quote that must agree, characters that may differ between them, quotes that may differ at all, and
#: how many places of a quote's beginning are looked at.
END, CHANGED, LONG, TRIED = 32, 24, 96, 32
#: Lengths by which agreeing ends are felt for, largest first.
STEPS = [1 << k for k in range(20, -1, -1)]


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def agreeing(a: Column, b: Column) -> Column:
    """Number of characters at the beginning in which two texts agree (up to two million)."""
    most = F.least(F.length(a), F.length(b))
    longer = lambda k, step: F.when((k + step <= most) & (F.substring(a, k + 1, step) == F.substring(b, k + 1, step)), k + step).otherwise(k)
    return F.aggregate(F.array(*[F.lit(s) for s in STEPS]), F.lit(0), longer)


def beginnings(text: Column, head: Column) -> Column:
    """Places (from 0) of head in text, without overlaps."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(head, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    ends = lambda p: scanned(p, -F.length(head), lambda s, x: s + F.length(x) + F.length(head), "int")
    return bound(pieces, lambda p: F.slice(ends(p), 1, F.greatest(F.size(p) - 1, F.lit(0))))


def repeats(text: Column, quote: Column) -> Column:
    """Whether text holds quote, or, if the quote has LONG characters, a passage that begins and ends with END of its characters
    and differs in between in at most CHANGED characters of either. Null if one of them is null."""
    head, n = F.substring(quote, 1, END), F.length(quote)
    backwards = F.reverse(quote)

    def at(start: Column) -> Column:
        def passage(w: Column) -> Column:
            def of_length(size: Column, a: Column) -> Column:
                def fits(z: Column) -> Column:
                    return (z >= END) & (n - a - z <= CHANGED) & (size - a - z <= CHANGED)

                same = agreeing(F.reverse(F.substring(w, F.lit(1), size)), backwards)
                return (size <= F.length(w)) & (a >= END) & bound(F.least(same, n - a, size - a), fits)

            lengths = F.sequence(n - CHANGED, n + CHANGED)
            return bound(agreeing(w, quote), lambda a: F.exists(lengths, lambda size: of_length(size, F.least(a, size))))

        return bound(F.substring(text, start + 1, n + CHANGED), passage)

    return text.contains(quote) | F.when(n >= LONG, F.exists(F.slice(beginnings(text, head), 1, TRIED), at)).otherwise(F.lit(False))


def near_quotes(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (quote_id, doc_id) where the document repeats the quote. Only documents that hold a whole quote, or the beginning of
    a long one, are compared with it; both are found by hashes of pieces."""
    asked = quotes.where("quote is not null").select("quote_id", "quote")
    heads = asked.where(F.length("quote") >= LONG).select("quote_id", F.substring("quote", 1, END).alias("quote"))
    exact = quote_pairs(asked.where("quote <> ''"), documents)
    met = quote_pairs(heads, documents).join(exact, ["quote_id", "doc_id"], "left_anti")
    changed = met.join(asked, "quote_id").join(documents.where("text is not null").select("doc_id", "text"), "doc_id").where(repeats(F.col("text"), F.col("quote")))
    return exact.unionByName(changed.select("quote_id", "doc_id")).distinct()
