"""Sentences of lines in Column expressions: marks read from left to right with what is open, what may end, and what is undecided.

A mark may end a sentence at once only if nothing is open. An end stays undecided until what follows is known: a comma takes it
back, a remark in brackets moves it behind the brackets, and an end after a colon goes if one whole sentence follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.arrays import scanned
from lectern.functions.text import bound

# Pairs of quotes and brackets, which of them quote and which set a remark apart, ends of sentences, and marks after which a sentence goes on.
PAIRS = {"“": "”", "‘": "’", "《": "》", "〈": "〉", "（": "）", "(": ")", "【": "】", "[": "]", "〔": "〕", "「": "」", "『": "』", "{": "}"}
QUOTED, CURLY, REMARKS = ("”", "’", "」", "』", '"'), ("”", "’", "」", "』"), ("）", ")", "】", "]", "〕")
ENDS, STOPS, DIVIDES = ".!?。！？", "，、,…", ";；:："
# Words that a full stop shortens, and schemes before a colon.
SHORT = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc")
SCHEMES = ("mailto", "tel", "urn", "data")
# (letters, which are most of a text, are passed over first)
MARK = r"""(?![A-Za-z\x20\u00c0-\u024f])(?:(?<!\\)\\(?:\\\\)*["']|[""" + ENDS + "]+|[" + STOPS + DIVIDES + "\"'" + "".join(f"\\{a}\\{z}" for a, z in PAIRS.items()) + "])"
#: Lines with any of these are read mark by mark; in others an end stands where this expression matches.
HARD = r"(?![A-Za-z\x20\u00c0-\u024f])(?:[\\\";；:：…" + "".join(f"\\{a}\\{z}" for a, z in PAIRS.items()) + r"]|(?<![A-Za-z0-9])'|'(?![A-Za-z0-9]))"
EASY = (rf"(?=[{ENDS}])(?>[{ENDS}]*[!?。！？][{ENDS}]*|(?<![{ENDS}])(?<!(?i:(?:^|[^\p{{L}}])(?:[a-z]|{'|'.join(SHORT)})))\.+(?![{ENDS}A-Za-z0-9])(?![ \t\r\x0b\x0c\xa0\u3000]*\p{{Ll}}))"
        rf"[ \t\r\x0b\x0c\xa0\u3000]*+(?![，、,{ENDS}])(?=.)")
#: White space in a line.
BLANKS = " \t\r\x0b\x0c\xa0\u3000"
STATE = "struct<end:int,open:string,p:int,quoted:boolean,colon:int,aside:boolean,fresh:boolean,inner:boolean,content:boolean,cut:int>"


def _blank(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS)) == ""


def _technical(gap: Column, next_: Column) -> Column:
    """Whether a colon stands in a time, an address or a path."""
    after = F.substring(next_, 1, 1)
    word = F.lower(F.element_at(F.split(gap, r"\s+"), -1))
    return (F.right(gap, F.lit(1)).rlike("[0-9]") & after.rlike("[0-9]")) | after.isin("/", "\\") | word.isin(*SCHEMES) | word.contains("://")


def _ends(x: Column) -> Column:
    """Whether an end mark ends a sentence: a full stop does if it shortens no word, a blank or a letter without cases follows,
    and then no small letter."""
    word = F.lower(F.element_at(F.split(F.right(x["gap"], F.lit(8)), r"\P{L}+"), -1))
    short = word.rlike("^[a-z]$") | word.isin(*SHORT)
    stop = ~short & ~F.substring(x["next"], 1, 1).rlike("[A-Za-z0-9]") & ~_small(x["next"])
    return F.when(F.translate(x["value"], ".", "") != "", True).otherwise(stop)


def _small(next_: Column) -> Column:
    return F.substring(F.ltrim(next_, F.lit(BLANKS)), 1, 1).rlike(r"^\p{Ll}")


def _tokens(line: Column, divide: bool) -> Column:
    """Every mark with what its surroundings say; the last is the end of the line, with what stands before it."""
    closer = F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair])
    pieces = F.split(line, MARK, -1)
    found = F.regexp_extract_all(line, F.lit(MARK), F.lit(0))
    after = F.slice(pieces, F.lit(2), F.size(pieces))
    raw = F.zip_with(F.arrays_zip(pieces.alias("gap"), found.alias("value")), after, lambda a, n: F.struct(a["gap"].alias("gap"), a["value"].alias("value"), n.alias("next")))

    def told(x: Column) -> Column:
        v = F.coalesce(x["value"], F.lit(""))
        one_of = lambda chars: F.lit("".join(chars)).contains(v)
        divides = F.lit("semi" if divide else "comma")
        kind = (F.when(x["value"].isNull(), "end").when(one_of(STOPS), "comma").when(F.lit(ENDS).contains(F.right(v, F.lit(1))), "term").when(one_of(PAIRS), "open").when(one_of(PAIRS.values()), "close")
                .when(v.isin('"', "'"), "straight").when(v.isin(":", "："), F.when(_technical(x["gap"], x["next"]), "skip").otherwise(divides)).when(one_of(DIVIDES), divides).otherwise("skip"))
        closes = F.when(kind == "open", F.try_element_at(closer, v)).otherwise(v)
        return F.struct(kind.alias("kind"), v.alias("value"), closes.alias("closer"), x["gap"].alias("gap"), F.coalesce(x["next"], F.lit("")).alias("next"))

    return F.transform(raw, told)


def cuts(line: Column, divide: bool = True) -> Column:
    """Array of the places (code points) at which sentences after the first begin. divide: whether semicolons and colons end one."""
    none, no, yes = F.lit(-1), F.lit(False), F.lit(True)
    zero = F.struct(*[c.alias(n) for n, c in zip(("end", "open", "p", "quoted", "colon", "aside", "fresh", "inner", "content", "cut"), (F.lit(0), F.lit(""), none, no, F.lit(0), no, no, no, no, none), strict=True)])

    def step(s: Column, x: Column) -> Column:
        top = F.substring(s["open"], 1, 1)
        before, after = F.right(x["gap"], F.lit(1)).rlike("[A-Za-z0-9]"), F.substring(x["next"], 1, 1).rlike("[A-Za-z0-9]")
        straight = (F.when((x["value"] == "'") & before & after, "skip").when(top == x["value"], "close")
                    .when((x["value"] == "'") & before, "skip").otherwise("open"))
        place = F.instr(s["open"], x["value"])
        act = F.when(x["kind"] == "straight", straight).when((x["kind"] == "close") & (place == 0), "stray").otherwise(x["kind"])
        end = s["end"] + F.length(x["gap"]) + F.length(x["value"])
        lead = F.length(x["next"]) - F.length(F.ltrim(x["next"], F.lit(BLANKS)))
        first = F.struct(
            act.alias("act"), end.alias("end"), (end + lead).alias("here"), (s["open"] == "").alias("flat"), _blank(x["gap"]).alias("blank"), (s["fresh"] & _blank(x["gap"])).alias("fresh"),
            (s["content"] | ((s["colon"] == 1) & x["gap"].rlike(r"[\p{L}\p{N}]"))).alias("content"), F.when(x["kind"] == "term", _ends(x)).otherwise(F.lit(False)).alias("ends"),
            F.when(act == "open", F.concat(x["closer"], s["open"])).when(act == "close", F.substring(s["open"], F.when(x["kind"] == "straight", 1).otherwise(place) + 1, F.lit(2147483647))).otherwise(s["open"]).alias("open"))

        def decide(t: Column) -> Column:
            """What becomes of the undecided end: kept (a cut now), dropped, or undecided still."""
            kept, dropped, still = F.lit("kept"), F.lit("dropped"), F.lit("still")
            act, shut = t["act"], (t["act"] == "close") & (t["open"] == "")
            colon_1 = (F.when(act.isin("comma", "semi", "end"), kept).when(act == "term", F.when(F.length(x["value"]) > 1, F.when(x["value"].startswith(".."), kept).otherwise(F.when(t["flat"], dropped).otherwise("ended")))
                       .when(~t["content"], kept).when(~t["ends"], still).when(t["flat"], dropped).otherwise("ended")).otherwise(still))
            colon_2 = F.when(~t["blank"] | act.isin("open", "comma", "semi", "end"), kept).when(shut, dropped).otherwise("ended")
            aside = (F.when(act == "end", dropped).when(shut, F.when(t["fresh"] | s["quoted"] | (x["last"] & (x["value"] != "") & _blank(x["next"])), dropped).otherwise(kept)).otherwise(still))
            plain = (F.when(~t["blank"], kept).when(act.isin("term", "semi", "comma", "stray"), dropped).when((act == "open") & x["closer"].isin(*REMARKS), "aside").when(act == "end", dropped).otherwise(kept))
            fate = F.when(s["p"] < 0, dropped).when(s["colon"] == 1, colon_1).when(s["colon"] == 2, colon_2).when(s["aside"], aside).otherwise(plain)
            return F.struct(t["act"], t["end"], t["here"], t["flat"], t["blank"], t["fresh"], t["content"], t["ends"], t["open"], fate.alias("fate"), shut.alias("shut"))

        def new(t: Column) -> Column:
            act, fate = t["act"], t["fate"]
            undecided = fate.isin("still", "ended", "aside")
            inner = F.when((act == "open") & t["flat"], no).when((act == "term") & t["ends"], yes).otherwise(s["inner"])
            quote, remark = x["value"].isin(*QUOTED), x["value"].isin(*REMARKS)
            behind_remark = (t["fresh"] | (s["aside"] & s["quoted"])) & ~_small(x["next"])
            shut_ends = F.when(remark, behind_remark).when(quote, t["fresh"] | s["inner"]).otherwise(s["inner"])
            ends = F.when((act == "term") & t["flat"], t["ends"]).when((act == "semi") & t["flat"], yes).when(t["shut"], shut_ends).when((act == "stray") & (s["p"] >= 0) & t["blank"] & (fate == "dropped"), yes).otherwise(no)
            set_ = ends & ~undecided
            return F.struct(
                t["end"].alias("end"), t["open"].alias("open"), F.when(undecided, s["p"]).when(set_, t["here"]).otherwise(none).alias("p"),
                F.when(undecided, s["quoted"]).otherwise(set_ & t["shut"] & x["value"].isin(*CURLY)).alias("quoted"),
                F.when(fate == "ended", 2).when(undecided, s["colon"]).when(set_ & (act == "semi") & x["value"].isin(":", "："), 1).otherwise(0).alias("colon"),
                ((fate == "aside") | (s["aside"] & undecided)).alias("aside"),
                F.when(act == "term", yes).when(act.isin("close", "stray", "skip"), t["fresh"]).otherwise(no).alias("fresh"), inner.alias("inner"),
                F.when(set_ & (act == "semi"), no).otherwise(t["content"]).alias("content"), F.when(fate == "kept", s["p"]).otherwise(none).alias("cut"))

        return bound(bound(first, decide), new)

    marked = bound(_tokens(line, divide), lambda t: F.transform(t, lambda x, i: x.withField("last", i >= F.size(t) - 2)))
    found = bound(marked, lambda t: scanned(t, zero, step, STATE, lambda s: F.when(s["cut"] >= 0, s["cut"]), "int"))
    return F.filter(found, lambda c: (c > 0) & (c < F.length(F.rtrim(line))))


def sentences(rows: DataFrame, key: str, text: str = "text", divide: bool = True) -> DataFrame:
    """key, ord, start, end, sentence: offsets in code points, white space around sentences left out. A new line begins a sentence.

    Null and empty texts have none; a text of one unbroken line is read as one.
    """
    pieces = F.split(F.col(text), "\n")
    starts = lambda p, first, more: scanned(p, F.struct(F.lit(0).alias("at"), first.alias("next")), lambda s, x: F.struct(s["next"].alias("at"), (s["next"] + F.length(x) + more).alias("next")), "struct<at:int,next:int>", lambda s: s["at"], "int")

    def of_line(line: Column) -> Column:
        def parted(c: Column) -> Column:
            bounds = F.zip_with(F.concat(F.array(F.lit(0)), c), F.concat(c, F.array(F.length(line["line"]))), lambda a, z: F.struct(a.alias("a"), z.alias("z")))
            return F.transform(bounds, lambda b: F.substring(line["line"], b["a"] + 1, b["z"] - b["a"]))

        easy = F.split(F.regexp_replace(line["line"], EASY, "$0\n"), "\n", -1)
        texts = F.when(line["line"].rlike(HARD), bound(cuts(line["line"], divide), parted)).otherwise(easy)
        placed = lambda t: F.zip_with(t, starts(t, line["at"], 0), lambda x, at: F.struct(at.alias("at"), x.alias("t")))
        return bound(texts, placed)

    lines = bound(pieces, lambda p: F.arrays_zip(p.alias("line"), starts(p, F.lit(0), 1).alias("at")))
    parts = F.filter(F.flatten(F.transform(lines, of_line)), lambda x: ~_blank(x["t"]))
    # outer: otherwise Spark works the sentences out a second time to see whether there are any
    each = rows.select(F.col(key), F.posexplode_outer(parts).alias("ord", "_p")).where("_p is not null")
    bare, led = F.trim("_p.t", F.lit(BLANKS)), F.length("_p.t") - F.length(F.ltrim("_p.t", F.lit(BLANKS)))
    start = F.col("_p.at") + led
    return each.select(key, "ord", start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("sentence"))
