"""Sentences in columns: known cases, and a plain walk over characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import sentences as st
from lectern.sources.tables import table

# Sentences as readers expect them split.
CASES = {
    "第一句。第二句！第三句？": ["第一句。", "第二句！", "第三句？"],
    "Read first; write later.": ["Read first;", "write later."],
    "他说：“先理解；再表达。”": ["他说：", "“先理解；再表达。”"],
    "“先理解”；“再表达”。": ["“先理解”；", "“再表达”。"],
    'He said "Read first. Think; then write."; Continue.': ['He said "Read first. Think; then write.";', "Continue."],
    "Don't rush; think first.": ["Don't rush;", "think first."],
    "James' notes; read them.": ["James' notes;", "read them."],
    "参见文献（甲，2020；乙，2021）；继续。": ["参见文献（甲，2020；乙，2021）；", "继续。"],
    "先做；“未闭合；继续；尾部": ["先做；", "“未闭合；继续；尾部"],
    "A;;B;": ["A;;", "B;"],
    "前句结束。（补充说明。）后句开始。": ["前句结束。（补充说明。）", "后句开始。"],
    "前句结束。（新方法）可以提高效率。": ["前句结束。", "（新方法）可以提高效率。"],
    "他说：“她喊‘快走！’”，随后大家离开。然后休息。": ["他说：“她喊‘快走！’”，随后大家离开。", "然后休息。"],
    "他说：“她念‘第一句。第二句。’”（出处）后面的解释另起一句。": ["他说：", "“她念‘第一句。第二句。’”（出处）", "后面的解释另起一句。"],
    "这是前一句。C. O. D.对justify的解释是：": ["这是前一句。", "C. O. D.对justify的解释是："],
    "Dr. Smith paid 3.14 dollars. Next sentence.": ["Dr. Smith paid 3.14 dollars.", "Next sentence."],
    "第一句。new methods是新方法。": ["第一句。", "new methods是新方法。"],
    "😀第一句。𠀀第二句。": ["😀第一句。", "𠀀第二句。"],
    # beyond those
    "At 10:30 see http://a.b/c: it is so. Then: go, now.": ["At 10:30 see http://a.b/c: it is so.", "Then:", "go, now."],
    "One. (Two. Three": ["One. (Two. Three"], "Left (a] b. C) do. E": ["Left (a] b. C) do.", "E"], "Say \\\"no. Yes\\\". Go": ["Say \\\"no.", "Yes\\\".", "Go"],
    "He asked. \"Why? Who?\" (She left.) Then ran.": ["He asked.", "\"Why? Who?\" (She left.)", "Then ran."], "": [], "  ": [], "x": ["x"],
    "First.\nSecond. third\n\n  Fourth!": ["First.", "Second. third", "Fourth!"],
}


def split(df, divide=True):
    out = {}
    for r in st.sentences(df, "i", "t", divide).orderBy("i", "ord").collect():
        out.setdefault(r["i"], []).append(r)
    return out


def test_cases(spark):
    texts = [*CASES, None]
    got = split(spark.createDataFrame(list(enumerate(texts)), "i int, t string"))
    for i, t in enumerate(texts):
        assert [r["sentence"] for r in got.get(i, [])] == CASES.get(t, []), t
        assert [r["ord"] for r in got.get(i, [])] == sorted(r["ord"] for r in got.get(i, []))
        assert all(t[r["start"] : r["end"]] == r["sentence"] for r in got.get(i, []))
    whole = split(spark.createDataFrame([(0, "甲；乙。丙；丁。")], "i int, t string"), divide=False)
    assert [r["sentence"] for r in whole[0]] == ["甲；乙。", "丙；丁。"]


def plain_cuts(t):
    """The same decisions one character after the other, looking ahead in the text itself."""
    close = st.PAIRS
    word = lambda i: 0 <= i < len(t) and bool(re.match("[A-Za-z0-9]", t[i]))
    # what each quote or bracket does: position of its partner, or open to the end
    stack, outer, i = [], {}, 0
    events = []
    while i < len(t):
        c = t[i]
        if c == "\\" and (i == 0 or t[i - 1] != "\\"):
            m = re.match(r"\\(?:\\\\)*[\"']", t[i:])
            if m:
                events.append((i, "skip", m[0]))
                i += len(m[0])
                continue
        if c in "\"'":
            if c == "'" and word(i - 1) and word(i + 1):
                events.append((i, "skip", c))
            elif stack and stack[-1] == c:
                stack.pop()
                events.append((i, "close", c))
            elif c == "'" and word(i - 1):
                events.append((i, "skip", c))
            else:
                stack.append(c)
                events.append((i, "open", c))
        elif c in close:
            stack.append(close[c])
            events.append((i, "open", c))
        elif c in close.values():
            if c in stack:
                while stack.pop() != c:
                    pass
                events.append((i, "close", c))
            else:
                events.append((i, "stray", c))
        elif c in st.ENDS:
            m = re.match(f"[{re.escape(st.ENDS)}]+", t[i:])
            events.append((i, "term", m[0]))
            i += len(m[0])
            events[-1] += (tuple(stack),)
            continue
        elif c in st.STOPS:
            events.append((i, "comma", c))
        elif c in st.DIVIDES:
            before = re.search(r"(\S*)$", t[(events[-1][0] + len(events[-1][2])) if events else 0 : i])[1]
            technical = c in ":：" and ((t[i - 1 : i].isdigit() and t[i - 1 : i].isascii() and t[i + 1 : i + 2].isdigit() and t[i + 1].isascii()) or t[i + 1 : i + 2] in ("/", "\\") or before.lower() in st.SCHEMES or "://" in before)
            events.append((i, "skip" if technical else "semi", c))
        else:
            i += 1
            continue
        events[-1] += (tuple(stack),)
        i += 1
    events = [e if len(e) == 4 else (*e, ()) for e in events]
    return events, outer


def test_ends_of_marks_in_documents(spark):
    """Over whole documents: sentences lie in order, lose nothing but white space, and those without quotes, brackets, commas and
    colons end exactly where a plain expression says."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    got = split(docs)
    simple = 0
    for d in docs.collect():
        parts, t = got.get(d["i"], []), d["t"] or ""
        at = 0
        for r in parts:
            assert not t[at : r["start"]].strip() and t[r["start"] : r["end"]] == r["sentence"] and r["sentence"]
            at = r["end"]
        assert not t[at:].strip()
        lines = [x for x in t.split("\n") if x.strip()]
        want = []
        for line in lines:
            if re.search(r"[\"'“”‘’《》〈〉（）()【】\[\]〔〕「」『』{};；:：…\\]|[.!?。！？]\s*[，、,]", line):
                want = None
                break
            ends = [m for m in re.finditer(r"[.!?。！？]+", line)]
            cut = [0]
            for m in ends:
                last = re.search(r"([^\W\d_]+)$", line[: m.start()])
                last = last[1].lower() if last else ""
                rest = line[m.end() :]
                short = bool(re.fullmatch("[a-z]", last)) or last in st.SHORT
                stop = not short and not re.match("[A-Za-z0-9]", rest) and not (rest.lstrip()[:1].islower())
                if (re.search("[!?。！？]", m[0]) or stop) and rest.strip():
                    cut.append(m.end())
            want += [x.strip() for x in (line[a:z] for a, z in zip(cut, [*cut[1:], len(line)], strict=True)) if x.strip()]
        if want is not None:
            simple += 1
            assert [r["sentence"] for r in parts] == want
    assert simple > 20


def test_random_lines_keep_their_text(spark):
    r = random.Random(9)
    lines = ["".join(r.choice("ab A.!?;:,\"'()“”（）。，；： 1") for _ in range(r.randint(0, 40))) for _ in range(400)]
    for (i, parts), whole in zip(sorted(split(spark.createDataFrame(list(enumerate(lines)), "i int, t string")).items()), [x for x in lines if x.strip()], strict=True):
        assert "".join(p["sentence"] for p in parts).replace(" ", "") == whole.replace(" ", "")
        events, _ = plain_cuts(whole)
        # no sentence but the last begins or ends inside what is open
        for p in parts[1:]:
            open_ = [e for e in events if e[0] < p["start"]]
            assert not open_ or not open_[-1][3], (whole, p)


@pytest.mark.parametrize("n", [300, 3000])
def test_long_lines(spark, n):
    line = "He came; she (so it was. Yes.) left. “Go!” " * n
    parts = split(spark.createDataFrame([(0, line)], "i int, t string"))[0]
    assert [p["sentence"] for p in parts[:4]] == ["He came;", "she (so it was. Yes.) left.", "“Go!”", "He came;"] and len(parts) == 3 * n


def test_easy_lines_are_read_alike(spark):
    """Lines without quotes, brackets and colons: the expression ends sentences where reading mark by mark does."""
    r = random.Random(3)
    lines = ["".join(r.choice(["a", "b", " ", "A", ".", "!", "。", ",", "1", "'", "Dr", "é", "  ", "中", ". B", "? c"]) for _ in range(r.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").where(~F.col("t").rlike(st.HARD))
    got = split(df)
    for row in df.withColumn("c", st.cuts(F.col("t"))).collect():
        at = [0, *row["c"], len(row["t"])]
        want = [x for x in (row["t"][a:z].strip() for a, z in zip(at, at[1:])) if x]
        assert [p["sentence"] for p in got.get(row["i"], [])] == want, row["t"]
