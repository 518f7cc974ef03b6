"""Replicas, text functions, batches, books and streams."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import batching as bt, html_blocks as hb, language as lg, replica as rp, search as se, shelf as sh, toc as tc
from lectern.sources import books
from lectern.streaming import reading as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("left, right, order", [({"a": 1}, {"a": 1}, "equal"), ({"a": 2}, {"a": 1, "b": 0}, "after"), ({}, {"b": 1}, "before"), ({"a": 1}, {"b": 1}, "concurrent")])
def test_clock_order(spark, left, right, order):
    df = spark.createDataFrame([(left, right)], "l map<string,bigint>, r map<string,bigint>")
    assert df.select(rp.compare_clocks(F.col("l"), F.col("r"))).first()[0] == order


def test_concurrent_annotations_leave_a_copy(spark):
    rows = [("n", {"mobile": 1}, 100, 0, "mobile", False, None, "m"), ("n", {"desktop": 1}, 110, 0, "desktop", False, None, "d")]
    kind = "id string, clock map<string,bigint>, wall long, counter long, device string, deleted boolean, conflict_of string, payload string"
    out = {r["id"]: r for r in rp.merge_annotations(spark.createDataFrame(rows, kind)).collect()}
    assert out["n"]["payload"] == "d" and out["n"]["clock"] == {"mobile": 1, "desktop": 1} and len(out) == 2
    assert out["n:conflict:mobile:100:0"]["conflict_of"] == "n"
    later = [*rows, ("n", {"desktop": 2, "mobile": 1}, 120, 0, "desktop", True, None, "x")]
    assert {r["id"]: r["payload"] for r in rp.merge_annotations(spark.createDataFrame(later, kind)).collect()}["n"] == "x"


def test_equal_clock_changes_nothing(spark):
    kind = "book string, value int, wall long, counter long, device string"
    cur, new = spark.createDataFrame([("a", 1, 5, 0, "d")], kind), spark.createDataFrame([("a", 2, 5, 0, "d")], kind)
    assert rp.upsert(cur, new, "book").first()["value"] == 1


@pytest.mark.parametrize("text, query, want", [("aaaa", "aa", [(0, 2), (2, 4)]), ("İstanbul x", "x", [(9, 10)]), ("😀the The", "the", [(1, 4), (5, 8)]), ("a.b", ".", [(1, 2)]), ("x", "", []), ("", "a", [])])
def test_places(spark, text, query, want):
    assert [tuple(p) for p in one(spark, se.places(F.lit(text), query))] == want


def test_unicode_space_and_terms(spark):
    assert one(spark, tx.normalized(F.lit("  A　B \n"))) == "a b"
    assert one(spark, tx.collapse_html_space(F.lit("a \n b\xa0c"))) == "a b\xa0c"
    assert one(spark, tx.contains_term(F.lit("The cat's hat"), F.lit("cat"))) and not one(spark, tx.contains_term(F.lit("concat"), F.lit("cat")))
    assert one(spark, tx.footnote_marker(F.lit(" [12] "))) == "12" and one(spark, tx.footnote_marker(F.lit("long marker"))) is None
    assert one(spark, tx.decoded_bytes(F.lit(b"caf\xe9").cast("binary"))) == "café"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (7).to_bytes(4, "big")
    assert tuple(one(spark, tx.image_size(F.lit(png).cast("binary")))) == ("png", 300, 7)


def test_greedy_resets(spark):
    rows = [("a", i, n) for i, n in enumerate((9, 3, 3, 4, 1, 20, 1))] + [("b", 0, 1)]
    got = bt.greedy(spark.createDataFrame(rows, "k string, o int, n int"), "k", "o", "n", 10).orderBy("k", "o").collect()
    assert [r["batch"] for r in got] == [0, 1, 1, 1, 2, 3, 4, 0]


def test_pick_skips(spark):
    picked = one(spark, bt.pick_skipping(F.array(*[F.lit(x) for x in ("aaaaa", "bbbb", "c", "dd")]), F.length, 8, 3))
    assert picked == ["aaaaa", "c", "dd"]


def test_shelf_ties(spark):
    shelf = sh.shelf(spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "book string, added long"), spark.createDataFrame([("c", 9)], "book string, activity long"))
    assert [r["book"] for r in shelf.collect()] == ["c", "a", "b"]
    assert sh.newest_version(spark.createDataFrame([("v1.9.0",), ("v1.10.0",)], "tag string")).first()["tag"] == "v1.10.0"


def test_toc(spark):
    rows = spark.createDataFrame([("b", k, d) for k, d in enumerate((0, 1, 2, 1, 0, 1))], "book string, ord int, depth int")
    got = {r["ord"]: (r["parent"], r["ancestors"]) for r in tc.ancestors(rows).collect()}
    assert got == {0: (None, []), 1: (0, [0]), 2: (1, [0, 1]), 3: (0, [0]), 4: (None, []), 5: (4, [4])}


def test_blocks(spark):
    html = "<head><title>T</title></head><body><nav>x</nav><h2>A &amp; B</h2><p>One <b>two</b><br>three<p>Four&#8217;s &#x1F600;<ul><li><a href='#n'>five</a></ul><hr><script>var a='<p>';</script>"
    got = hb.blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).orderBy("id", "ord").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("heading", "A & B"), ("paragraph", "One two\nthree"), ("paragraph", "Four’s 😀"), ("item", "five"), ("separator", "")]


def test_sentences(spark):
    text = "Dr. Smith came (at 5. Really!) home. \"Yes!\" he said. J. R. left… and came。再见！End"
    got = lg.sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id").orderBy("ord").collect()
    assert all(text[r["start"] : r["end"]] == r["sentence"] for r in got)
    assert [r["sentence"] for r in got][0] == "Dr. Smith came (at 5. Really!) home."
    assert [r["sentence"] for r in got][-2:] == ["再见！", "End"]


def epub_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='OPS/p.opf'/></rootfiles></container>")
        z.writestr("OPS/p.opf", "<package xmlns:dc='d'><metadata><dc:title>My Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id='a' href='t/a.xhtml'/><item id='b' href='t/b.xhtml'/><item id='n' href='nav.xhtml' properties='nav'/></manifest><spine><itemref idref='b'/><itemref idref='a'/></spine></package>")
        z.writestr("OPS/nav.xhtml", "<html><nav><ol><li><a href='t/a.xhtml#x'>First</a></li></ol></nav></html>")
        z.writestr("OPS/t/a.xhtml", "<html><body><p>a</p></body></html>")
        z.writestr("OPS/t/b.xhtml", "<html><body><p>b</p></body></html>")
    return out.getvalue()


def test_books(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub_bytes())
    (tmp_path / "y.fb2").write_text("<FictionBook xmlns='f'><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>F</book-title></title-info></description><body><section><title><p>One</p></title><p>text</p></section></body></FictionBook>")
    (tmp_path / "bad.cbz").write_bytes(b"no archive")
    (tmp_path / "skip.txt").write_text("x")
    got = sorted(books.sections(books.files(spark, f"file://{tmp_path}")).collect(), key=lambda r: (r["format"], r["spine"] or 0))
    assert [(r["format"], r["title"], r["author"], r["label"]) for r in got] == [("cbz", None, None, None), ("epub", "My Book", "Me", None), ("epub", "My Book", "Me", "First"), ("fb2", "F", "A B", "One")]
    assert got[0]["error"].startswith("BadZipFile") and "<p>b</p>" in got[1]["html"]


def ticks(spans):
    return pd.DataFrame([{"device": "d", "at": t, "activity": a, "eligible": True, "offset": 0, "progress": 0.1} for t, a in spans])


def test_tracker_idle_and_gap():
    rows = ticks([(t * 1000, t == 0) for t in range(303)] + [(400_000, True), (401_000, True)])
    state, out = st.advance(st.NEW, rows)
    assert sum(e - s for _, s, e, *_ in out) == 300_000
    assert state[2] == 1000 and {s for s, *_ in out} == {0} and state[5] >= 1


def test_stream_equals_batch(spark, tmp_path):
    rows = pd.concat([ticks([(t * 1000, t % 50 == 0) for t in range(200)]).assign(device=d) for d in ("x", "y")])
    df = spark.createDataFrame(rows, "device string, at long, activity boolean, eligible boolean, offset int, progress double")
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    df.where("at < 100000").coalesce(1).write.mode("append").parquet(src)
    stream = st.reading_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))

    def run():
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    df.where("at >= 100000").coalesce(1).write.mode("append").parquet(src)
    run()
    want = sorted(map(tuple, st.readings_of(df).collect()))
    assert want and sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_idempotent_arrival(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    batch = spark.createDataFrame([("1", 1), ("1", 1), ("2", 2)], "id string, v int")
    st.append_new(batch, path)
    st.append_new(batch.unionAll(spark.createDataFrame([("3", 3)], "id string, v int")), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["1", "2", "3"]


def test_contents_deeper_than_eight(spark):
    from lectern.operators import toc

    df = spark.createDataFrame([("b", k, k) for k in range(12)], "book string, ord int, depth int")
    got = {r["ord"]: (r["parent"], r["ancestors"]) for r in toc.ancestors(df).collect()}
    assert got == {k: (k - 1 if k else None, list(range(k))) for k in range(12)}


def test_list_depths(spark):
    """The levels of indents against a plain stack."""
    import random

    from lectern.operators import structure as sr

    def plain(indents):
        stack, out = [], []
        for v in indents:
            if not stack or v > stack[-1] + sr.SAME_INDENT:
                stack.append(v)
            else:
                known = [i for i, x in enumerate(stack) if abs(v - x) <= sr.SAME_INDENT]
                under = [i for i, x in enumerate(stack) if x < v]
                stack = stack[: known[-1] + 1] if known else stack[: under[-1] + 1 if under else 0] + [v]
            out.append(len(stack) - 1)
        return out

    r = random.Random(3)
    lists = [[float(r.randint(0, 40)) for _ in range(r.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, v array<double>")
    assert [x["d"] for x in df.orderBy("i").select(sr.list_depths(F.col("v")).alias("d")).collect()] == [plain(v) for v in lists]


@pytest.mark.parametrize("text, want", [
    ("• a", ("bullet", 1)), ("③ x", ("circled", 3)), ("(12) x", ("arabic", 12)), ("（３） x", None), ("十二、x", ("chinese", 12)), ("IV. x", ("roman", 4)), ("b) x", ("alpha", 2)),
    ("i. x", ("alpha", 9)), ("1900. x", None), ("3.5 x", None), ("3.", None), ("abc. x", None), ("  7) x", ("arabic", 7)), ("", None)])
def test_list_marks(spark, text, want):
    mark = one(spark, lg.list_marker(F.lit(text)))
    assert (mark and (mark["family"], mark["value"])) == want
    if text == "i. x":
        assert mark["values"] == {"alpha": 9, "roman": 1} and mark["prefix"] == 3


@pytest.mark.parametrize("text, want", [
    ("Figs 1, 2 and 3", ["figure/1", "figure/2", "figure/3"]), ("misfigure 2", []), ("表一百二a与三", ["table/102a", "table/3"]), ("Fig. 2(b), 4–5", ["figure/2b", "figure/4-5"]), ("tab. A.3; chart 9; plate 2", ["table/a.3"])])
def test_media_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert [f"{r['kind']}/{r['number']}" for r in lg.media_references(df).collect()] == want


def test_quotes_of_all_lengths(spark):
    """Quotes in documents against `in`, lengths around the pieces', repeats and empty ones included."""
    import random

    r = random.Random(8)
    texts = ["".join(r.choice("ab \\n.") for _ in range(r.randint(0, 120))) for _ in range(60)] + [None]
    quotes = [(t[k : k + n]) for t in texts if t for k, n in ((3, 1), (0, 11), (5, 12), (2, 23), (4, 24), (1, 25), (0, 60))] + ["zz", "", None]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    got = {tuple(x) for x in se.quote_pairs(asked, docs).collect()}
    assert got == {(q, d) for q, quote in enumerate(quotes) if quote is not None for d, t in enumerate(texts) if t is not None and quote in t}


def test_union_in_buckets_is_the_union(spark):
    """Cut at hours, every moment keeps the interval, and so the offset, that owns it without the cut."""
    import random

    from lectern.operators import intervals as iv

    r = random.Random(6)
    rows = []
    for _ in range(300):
        start = r.randint(0, 8 * 3_600_000)
        rows.append((r.choice("ab"), start, start + r.randint(0, 5_000_000), r.choice((-3600, 0, 7200, 39600))))
    df = spark.createDataFrame(rows, "k string, start long, end long, offset int")
    whole = iv.by_local_day(iv.union(df, "k")).groupBy("k", "day").agg(F.sum(F.col("end") - F.col("start")).alias("ms"))
    assert sorted(map(tuple, iv.daily(df, "k").collect())) == sorted(map(tuple, whole.collect()))


def test_files(spark, tmp_path):
    """Listings, changed tables, day folders of diagnostics, keyed reads, blocks as JSON."""
    from lectern.sources import files as fl

    for name in ("b.json", "a.json", "c.txt"):
        (tmp_path / name).write_text("{}")
    assert [r["name"] for r in fl.json_files(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    df, place = spark.range(10).withColumn("x", F.col("id") * 2), f"{tmp_path}/t"
    assert fl.write_if_changed(df, place) and not fl.write_if_changed(df.repartition(3), place) and fl.write_if_changed(df.where("id > 2"), place)
    assert spark.read.parquet(f"{place}/rows").count() == 7
    assert fl.keyed(spark.read.parquet(f"{place}/rows"), id=5).first()["x"] == 10
    log = f"{tmp_path}/log"
    for day in ("2024-01-01", "2024-01-02"):
        fl.log_events(spark.createDataFrame([("open", 1), ("close", 2)], "event string, n int"), log, F.lit(day))
    assert fl.recent_log(spark, log, "2024-01-02", "event string, n int").count() == 2
    blocks = hb.blocks(spark.createDataFrame([(1, "<h1>A</h1><p>b &amp; <a href=x>c</a></p>")], "page_id long, html string"))
    back = fl.decoded_blocks(fl.encoded_blocks(blocks))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, blocks.select(*back.columns).collect()))


@pytest.mark.parametrize("text, want", [
    ("Table 3", True), ("TABLE 3.", True), ("表格 十二：", True), ("表3–2", True), ("Table 1.2-3:", True), ("table一.4", True), ("Table 1.", True),
    ("Table", False), ("Table 3 shows", False), ("Table 1..2", False), ("Table 1.:", False), ("Tables 3", False), ("Table 2.b", False), ("Table 3 .", False), ("表一.二", False), ("", False), ("4 Table", False), ("Table 3::", False)])
def test_table_labels(spark, text, want):
    assert one(spark, tx.standalone_table_label(F.lit(text))) is want


@pytest.mark.parametrize("tail, head, joins", [
    ("the long road and", "then home", True), ("the long road.", "Then home", False), ("as Mr.", "smith said", True), ("as Mr.", "Smith said", False), ("half a hy-", "phen", True), ("half­", "Way", True),
    ("he said “yes.”", "and left", True), ("he said “yes!”", "and left", False), ("说完了。", "他走了", False), ("说完了", "他走了", True), ("(so it was)", "Then", True), ("these:", "one", False), ("ends in digits 12", "34 more", True)])
def test_paragraphs_over_pages(spark, tail, head, joins):
    from lectern.operators import structure as sr

    assert (one(spark, sr.joining_score(F.lit(tail), F.lit(head))) > 0) is joins


@pytest.mark.parametrize("text, want", [
    ("plain words", True), ("two\nlines", True), ("#hashtag stays", True), ("# heading", False), ("####### seven", True), ("- item", False), ("-5 degrees", True), ("12) item", False), ("12) ", False), ("3.14 is pi", True), ("a\n> said", False),
    ("| a | b |", False), ("x <b>y</b>", False), ("see ![p](q)", False), ("costs $5", True), ("$$x$$", False), ("", False)])
def test_prose_paragraphs(spark, text, want):
    from lectern.operators import structure as sr

    assert one(spark, sr.is_prose(F.lit(text))) is want


@pytest.mark.parametrize("text, want", [("[12]", "note"), (" † ", "note"), ("（*）.", "note"), ("12 13", "normal"), ("123456789", "normal"), ("12345678", "note"), ("1a", "normal"), ("[]", "normal"), ("", "normal"), ("§§", "note"), ("1-2", "normal")])
def test_note_marks(spark, text, want):
    from lectern.operators import structure as sr

    run = F.array(F.struct(F.lit(text).alias("text"), F.lit("n#1").alias("link"), F.lit(0.8).alias("scale"), F.lit(False).alias("raised"), F.lit("normal").alias("role")))
    assert one(spark, sr.marked_references(run, F.array(F.lit("n"))))[0]["role"] == want


@pytest.mark.parametrize("label, want", [
    ("Part Two: The Sea", ("Two", "The Sea")), ("chapter 3 — Rain", ("3", "Rain")), ("IV. On Trees", ("IV", "On Trees")), ("Prologue", ("", "")), ("Book One", ("", "")), ("", ("", "")), (" : 7 : Don't go", ("7", "Don't go")), ("第一章 海", ("第一章", "海"))])
def test_numbered_labels(spark, label, want):
    from lectern.operators import structure as sr

    number, title = sr.numbered_label(F.lit(label))
    assert (one(spark, number), one(spark, title)) == want


@pytest.mark.parametrize("text, want", [
    ("(see Fig. 2 and Table 3)", True), ("（图一、表二；图3）", True), ("[cf. figs 1, 2 and 3 & table 4]", True), ("[cf. figs 1, 2 & 3]", False), ("(Fig. 2 shows it)", False), ("(band Fig. 1)", False), ("(Fig. 1 AND fig. 2 / table 4)", True), ("(none)", False), ("Fig. 1", False), ("(Fig. 1]", False), ("()", False)])
def test_media_citations(spark, text, want):
    assert one(spark, lg.is_media_citation(F.lit(text))) is want
