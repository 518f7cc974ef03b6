"""Paragraphs that only part others: lines of symbols, and lines left blank on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Symbols that part if they are repeated, ornaments, strokes of a rule, what may end one, characters that are no width, blanks
# that are set on purpose; repetitions that count, most symbols of a line, characters of prose, and the margin that sets a line apart.
REPEATED = ("*", "＊", "※", "•", "⁂", "⁎", "✻", "✽")
ORNAMENTS = ("▲", "◆", "❦", "❧")
STROKES, ENDED_STROKES, RULE_END = ("-", "—", "–", "─", "━", "_"), ("-", "—", "─"), "▲"
NO_WIDTH, SET_BLANKS = ("​", "⁠", "﻿"), (" ", "　")
TIMES, MOST_SYMBOLS, PROSE, APART = 3, 32, 40, 8.0


def symbols(text: Column) -> Column:
    """What a line shows: `repeated` for one symbol three times or more, `weak` for an ornament or a rule of strokes, else null."""
    bare = F.regexp_replace(F.translate(text, "".join(NO_WIDTH), ""), r"[\s 　]", "")
    kinds = F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != ""))
    n = F.length(bare)
    within = lambda chars: F.forall(kinds, lambda c: c.isin(*chars))
    repeated = (n >= TIMES) & (F.size(kinds) == 1) & within(REPEATED)
    strokes = (n >= TIMES) & within(STROKES)
    ended = (n > TIMES) & bare.endswith(RULE_END) & (F.instr(bare, RULE_END) == n) & F.forall(kinds, lambda c: c.isin(*ENDED_STROKES, RULE_END))
    return F.when(n.between(1, MOST_SYMBOLS), F.when(repeated, "repeated").when(bare.isin(*ORNAMENTS) | strokes | ended, "weak"))


def is_set_blank(raw: Column, breaks: Column) -> Column:
    """Whether a paragraph without pictures is blank on purpose: nothing but blanks, and a line break or a blank that does not collapse."""
    blank = F.regexp_replace(raw, r"[\s 　]", "") == ""
    return F.coalesce(blank & ((breaks > 0) | F.exists(F.array(*[F.lit(b) for b in SET_BLANKS]), raw.contains)), F.lit(False))


def separated(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, ord, kind, text, held: in a list, table, quote, note or link; centered, margin: the larger one above or below)
    with part: `symbols` for paragraphs that only part others.

    Repeated symbols part by themselves. An ornament or a rule of strokes does if it is centered and stands at a drawn rule (kind
    rule), or apart between two paragraphs of prose.
    """
    line = W.partitionBy(key).orderBy("ord")
    prose = lambda way: F.coalesce((way("kind").over(line) == "paragraph") & (F.length(F.trim(way("text").over(line))) >= PROSE), F.lit(False))
    rule = lambda way: F.coalesce(way("kind").over(line) == "rule", F.lit(False))
    shows = symbols(F.col("text"))
    apart = (prose(F.lag) & prose(F.lead) & (F.coalesce("margin", F.lit(0.0)) >= APART)) | rule(F.lag) | rule(F.lead)
    parts = (F.col("kind") == "paragraph") & ~F.coalesce("held", F.lit(False)) & ((shows == "repeated") | ((shows == "weak") & F.coalesce("centered", F.lit(False)) & apart))
    return blocks.withColumn("part", F.when(F.coalesce(parts, F.lit(False)), "symbols"))
