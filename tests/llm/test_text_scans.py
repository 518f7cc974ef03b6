"""Scans against brute force: decontamination, secrets, personal data, licenses."""

import hashlib
import math
import re

import pytest

from lectern.llm import decontaminate, licences, pii, secrets

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def by_row(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def brute_windows(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for a in range(len(iw) - n + 1) if iw else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[a : a + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(docs, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    short = docs.where("doc_id is null or doc_id <> 10")
    got = by_row(decontaminate.decontaminate(short, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((r["doc_id"], *brute_windows(r["text"], items)) for r in short.collect()), key=repr)
    assert got == want
    assert {r[0] for r in got if r[5]} == {1, 2, 7, 9}


def test_decontamination_spans_and_blocks(docs, benchmark, monkeypatch):
    found = {r["doc_id"]: r for r in decontaminate.decontaminate(docs.where("doc_id = 7"), benchmark).collect()}[7]
    text = docs.where("doc_id = 7").first()["text"]
    assert [text[s["start"] : s["end"]] for s in found["spans"]] == ["ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE"]
    one = by_row(decontaminate.decontaminate(docs, benchmark), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", 20))
    assert by_row(decontaminate.decontaminate(docs, benchmark), "doc_id", "n_hit", "items_sha256") == one


def test_decontamination_empty(docs, no_docs, benchmark):
    assert decontaminate.decontaminate(no_docs, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).where("contaminated").count() == 0
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 7, 9}) and kept.count() == docs.count() - 5


def digest(found):
    joined = ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted((a, n, k, z) for n, (k, spans) in enumerate(found.items()) for a, z in spans))
    return hashlib.sha256(joined.encode()).hexdigest()


def counted(found):
    return *map(len, found.values()), digest(found)


def brute_secrets(text):
    text = text or ""
    assign = [m.span() for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return {"assign": assign, "access": access, "hex": hexes}


def test_secrets(docs, no_docs):
    scanned = secrets.scan(docs)
    got = by_row(secrets.digest(scanned), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = sorted(((r["doc_id"], *counted(brute_secrets(r["text"]))) for r in docs.collect()), key=repr)
    assert got == want
    found = {r["doc_id"]: r for r in scanned.where("size(entropy) > 0").collect()}
    assert [s["value"] for s in found[13]["entropy"]] == ["q7Rt9LmZ2xWv8KpB4nYc6Hd"] and set(found) == {13}
    assert secrets.scan(no_docs).count() == 0


@pytest.mark.parametrize("value", ["q7Rt9LmZ2xWv8KpB4nYc6Hd", "aaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababab0123456789", "short"])
def test_entropy(spark, value):
    def entropy(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    want = max([0.0, *(entropy(value[i : i + 20]) for i in range(len(value) - 19))])
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(value,)], "v string").select(secrets.best_entropy(F.col("v"))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_entropy_classes_and_samples(spark):
    secret = ["k3v9x0qz7m2w8r5t1b6n4j", "MZ4X7QK2VB6TPL5RWG3CNH", "kqXvTzBnWrLmHsPdGjFcYt", "xqzkvbtrwplmhsdnjgfcyt", "example/path/key=q7Rt9LmZ2xWv8KpB4nYc6Hd", "key-k3v9x0qz7m2w8r5t1b6n4j"]
    plain = ["internationalization_and_localization", "Versicherungsgesellschaften", "getElementsByTagNameNamespace", "some-example-path/with-many-words", "abcdefghijklmnopqrstuvwxyz0123", "123e4567-e89b-12d3-a456-426614174000", "placeholderk3v9x0qz7m2w8r5t1b"]
    df = spark.createDataFrame(list(enumerate(secret + plain)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in secrets.scan(df).where("size(entropy) > 0").collect())
    assert got == list(range(len(secret)))


def test_keys_with_prefixes_and_signed_tokens(spark):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkFubiJ9.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    texts = ["x ghp_16C7e42F292c6912E7710c838347Ae178B4a y", token, "/usr/share/doc/some-package/examples/long-name/", "a/" * 40, "-" * 60 + "1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["entropy"]] for r in secrets.scan(df).collect()}
    assert got == {0: ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"], 1: token.split("."), 2: [], 3: [], 4: []}


def test_one_very_long_candidate(spark):
    """Time grows with the length of one unbroken string, whatever it holds, and stays within seconds."""
    import random
    import time

    r = random.Random(2)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n))

    def seconds(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        out = secrets.scan(df).collect()
        return time.perf_counter() - began, out

    seconds(key(1000))
    half, _ = seconds(key(100_000))
    whole, out = seconds(key(200_000))
    assert out[0]["entropy"] and whole < 15 and whole < 3 * half + 1
    for text in ("/abc1" * 40_000, "-" * 200_000 + "1", "a_" * 100_000, "x" * 200_000, "0123456789" * 20_000):
        took, _ = seconds(text)
        assert took < 15, text[:10]


def brute_entropy_spans(text):
    """The added spans of the secret scan, step by step in plain Python."""
    base = [b for spans in brute_secrets(text).values() for b in spans]

    def best(v):
        windows = [v[i : i + secrets.WINDOW] for i in range(len(v) - secrets.WINDOW + 1)]
        return max((-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) for w in windows), default=0.0)

    def part(p):
        vowels = sum(c in "aeiouyAEIOUY" for c in p) / max(1, len(p))
        kinds = (any(c.islower() for c in p), any(c.isupper() for c in p), sum(c.isdigit() for c in p))
        least = None
        if kinds[0] and not kinds[1] and kinds[2] >= 2 and any(c in "ghijklmnopqrstuvwxyz" for c in p):
            least = secrets.ENTROPY["lower"]
        elif kinds[1] and not kinds[0] and kinds[2] >= 2 and any(c in "GHIJKLMNOPQRSTUVWXYZ" for c in p):
            least = secrets.ENTROPY["upper"]
        elif re.fullmatch("[0-9A-Fa-f]+", p) and kinds[2] and (kinds[0] or kinds[1]):
            least = secrets.ENTROPY["hex"]
        elif p.isalpha() and (p.islower() or p.isupper() or p[1:].islower()) and vowels <= secrets.VOWELS["one case"]:
            least = secrets.ENTROPY["one case"]
        elif p.isalpha() and kinds[0] and sum(c.isupper() for c in p) >= 2 and vowels <= secrets.VOWELS["letters"]:
            least = secrets.ENTROPY["letters"]
        return len(p) >= secrets.WINDOW and least is not None and best(p) >= least - 1e-9

    def secret(candidate):
        v = re.sub(secrets.SAMPLE.replace("(?i:", "(?:"), "", candidate, flags=re.I)
        hexa = bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v))
        allowed = any(re.search(a, v) for a in secrets.ALLOWED)
        mixed = re.search("[0-9]", v) and (re.search("[A-Fa-f]", v) if hexa else re.search("[A-Z]", v) and re.search("[a-z]", v))
        if mixed and not allowed and best(v) >= secrets.ENTROPY["hex" if hexa else "signed" if v.startswith("eyJ") else "mixed"] - 1e-9:
            return True
        return not re.search(secrets.ALLOWED[0], v) and any(part(p) for p in re.split("[/_=+-]+", v) if p)

    found = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if secret(m[0])]
    return [(a, z) for a, z in found if all(z <= x or y <= a for x, y in base)]


def test_added_secrets_against_brute_force(spark):
    import random

    r = random.Random(5)
    alphabets = ["0123456789abcdef", "ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "aeiou bcd", "abcXYZ012+/=", "ab1", "KQXVZBWRLkqxvzbwrl"]
    pieces = ["token=", "secret: ", " ", "\n", "/", "-", "_", "=", "example", "0123456789", "word", "éß", "AKIA"]
    texts = []
    for _ in range(150):
        out = []
        for _ in range(r.randint(1, 14)):
            out.append(r.choice(pieces) if r.random() < 0.5 else "".join(r.choice(r.choice(alphabets)) for _ in range(2)) + "".join(map(r.choice, [r.choice(alphabets)] * r.randint(5, 45))))
        texts.append("".join(out))
    scanned = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["entropy"]] for x in scanned.collect()}
    assert got == {k: brute_entropy_spans(t) for k, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 30


def test_many_spans_in_one_text(spark):
    """Time grows in proportion to the spans of a text, and places stay right beyond the parts that arrays are run in."""
    from lectern.llm import native_spans

    n = 3 * native_spans.PART + 7
    text = " é ".join(f"token=abcdefgh{k} +49 30 {1000000 + k}" for k in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    one = secrets.digest(secrets.scan(df)).first()
    assert (one["n_assign"], one["base_sha256"]) == (n, digest(brute_secrets(text)))
    two = pii.digest(pii.scan(df)).first()
    assert (two["n_phone"], two["base_sha256"]) == (n, digest(brute_pii(text)))


def brute_pii(text):
    text = text or ""

    def luhn(v):
        d = [int(c) for c in v if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    n = lambda v: sum(c.isdigit() for c in v)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= n(m[0]) <= 19 and luhn(m[0])],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= n(m[0]) <= 15],
    }


def brute_added(text, model):
    """Proposals, features, trees and the choice among overlapping spans of the personal-data scan in plain Python."""
    trees, weights, limits = model
    base = [b for spans in brute_pii(text).values() for b in spans]
    proposed = []
    for kind, p in enumerate(pii.GENERATORS.values()):
        last = 0
        for m in re.finditer(p, text):
            proposed.append((m.start(), m.end(), kind, text[max(last, m.start() - pii.CONTEXT) : m.start()], m[0]))
            last = m.end()

    def features(kind, before, v):
        count = lambda chars: sum(c in chars for c in v)
        near = before[-pii.NEAR :]
        some = lambda p, x: float(bool(re.search(p, x)))
        digits = [c for c in v if c in "0123456789"]
        first, last = re.search("^[^0-9A-Za-z]?([0-9A-Za-z]+)", v), re.search("([0-9A-Za-z]+)[^0-9A-Za-z]*$", v)
        return {
            "kind": kind, "digits": len(digits), "letters": len(re.findall("[A-Za-z]", v)), "length": len(v), "groups": len(re.split("[^0-9A-Za-z]+", v)), "blanks": count(" "),
            "hyphens": count("-"), "dots": count("."), "slashes": count("/"), "parens": count("()"), "first": len(first[1]) if first else 0, "distinct": len(set(digits)) or 1,
            "year": some("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)", v), "for_near": some(pii.FOR, near), "against_near": some(pii.AGAINST, near), "for_far": some(pii.FOR, before),
            "domain": some(pii.DOMAIN, v), "last": len(last[1]) if last else 0,
        }

    def grow(tree, x):
        return tree if not isinstance(tree, tuple) else grow(tree[2] if x[pii.FEATURES[tree[0]]] <= tree[1] else tree[3], x)

    accepted = []
    for a, z, kind, before, v in proposed:
        if all(z <= x or y <= a for x, y in base):
            x = features(kind, before, v)
            p = 1 / (1 + math.exp(-2 * sum(w * grow(t, x) for t, w in zip(trees, weights, strict=True))))
            if p >= limits[kind]:
                accepted.append((a, z, kind, p))
    stays = []
    for one in sorted(accepted):
        if stays and one[0] < stays[-1][1]:
            last = stays[-1]
            covers, covered = (a[0] <= b[0] and a[1] >= b[1] and a[1] - a[0] > b[1] - b[0] for a, b in ((one, last), (last, one)))
            if covers or not covered and (one[3], one[2]) > (last[3], last[2]):
                stays[-1] = one
        else:
            stays.append(one)
    return sorted((list(pii.GENERATORS)[k], a, z) for a, z, k, _ in stays)


def test_added_pii_against_brute_force(spark):
    import random

    r = random.Random(9)
    lines = [t for t, _ in pii.examples()]
    texts = [" ".join(r.choice([r.choice(lines), r.choice(TRICKY), "x"])[: r.randint(5, 80)] for _ in range(r.randint(1, 8))) for _ in range(250)]
    got = {x["doc_id"]: sorted((k, s["start"], s["end"]) for k in pii.GENERATORS for s in x[k]) for x in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    model = pii._model(spark.sparkContext.applicationId)
    assert got == {k: brute_added(t, model) for k, t in enumerate(texts)}
    assert {k for spans in got.values() for k, _, _ in spans} == set(pii.GENERATORS)


TRICKY = [
    "a@b.c@d.e.f x%y+z@h-1.co.uk_more@x.y a@b @c.d e@f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 99999999999.1.1.1 1.1.1",
    "4111 1111 1111 1111 12 4111-1111-1111-1112 4111111111111111 41111111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (499) 555-6503 +49 30.123456 +1 2 +12345678901234567 + 1234567890123",
    "1234567812345670 1234 +4917612345678. 4222222222222 4242424242424242-", "٣٤ mail é@x.y 😀a@b.cd",
]


def test_pii(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + list(enumerate(TRICKY, 100))
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = by_row(pii.digest(scanned), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(((i, *counted(brute_pii(t))) for i, t in rows), key=repr)
    found = {r["doc_id"]: r for r in scanned.collect()}[14]
    assert [[s["value"] for s in found[k]] for k in pii.GENERATORS] == [["(030) 555-1234"], ["078-05-1120"], ["DE12 5001 0517 5407 3249 31"], ["name.x [at] host [dot] org"]]
    assert pii.scan(no_docs).count() == 0


def test_pii_thresholds_are_calibrated():
    falling = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 0), (0.6, 1), (0.7, 0)] + [(0.8 + k / 1000, 1) for k in range(60)]
    assert pii.threshold(falling) == 0.8
    assert pii.threshold([(0.9, 1), (0.95, 1)]) == 2.0 and pii.threshold([]) == 2.0


def test_added_pii_on_forms_it_was_not_trained_on(spark):
    """Held-out lines with other words and other ways to write: precision and recall of the added spans."""
    import random

    r = random.Random(77)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    good = [
        ("please telephone", lambda: f"{d(3)} {d(3)} {d(4)}"), ("his cell was", lambda: f"({d(3)}) {d(3)}.{d(4)}"), ("whatsapp me:", lambda: f"{d(4)} {d(3)} {d(3)}"), ("passport holder with", lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        ("transfer to account", lambda: f"NL{d(2)} ABNA {d(4)} {d(4)} {d(2)}"), ("email me,", lambda: f"ann.lee{d(2)} (at) house (dot) net"), ("you may contact", lambda: f"info [at] shop{d(1)}.org"),
    ]
    bad = [
        ("measured on", lambda: f"{d(2)}.{d(2)}.20{d(2)}"), ("see pages", lambda: f"{d(2)}-{d(2)}-{d(2)}"), ("version", lambda: f"{d(2)}.{d(2)}.{d(2)}"), ("invoice no", lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        ("the scores were", lambda: f"{d(2)} {d(2)} {d(3)} {d(2)}"), ("isbn", lambda: f"{d(3)}-{d(3)}-{d(4)}-{d(2)}"), ("a serial", lambda: f"QX{d(2)} ABCD EFGH"),
    ]
    rows, truth = [], []
    for k in range(700):
        before, make = r.choice(good if k % 2 else bad)
        value = make()
        text = f"so it was said, {before} {value} and nothing more"
        rows.append((k, text))
        if k % 2:
            truth.append((k, text.index(value), text.index(value) + len(value)))
    one = pii.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, start int, end int")).first()
    print(one)
    assert one["precision"] >= 0.9 and one["recall"] >= 0.6


def test_pii_leaves_plain_numbers(spark):
    plain = ["on 12.05.2024 and 2024-01-31 we met", "version 10.15.732 was out", "pages 10-12-15 of vol 3", "scores 120 333 250 211 in all", "serial 123-12-1234-12"]
    scanned = pii.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"))
    assert [r["spans"] for r in pii.digest(scanned).collect()] == [""] * len(plain)


def brute_license(text):
    w = words(text)
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    """Labels and score by comparing every place with every template."""
    w, k, found = words(text), licences.TEXT_K, {}
    for label, texts in licences.TEMPLATES.items():
        for t in map(str.split, texts):
            hits = [(i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
            groups, last = [], None
            for d in sorted({i - j for i, j in hits}):
                if last is None or d - last > licences.NEAR:
                    groups.append([])
                groups[-1] += [h for h in hits if h[0] - h[1] == d]
                last = d
            for group in groups:
                group.sort(key=lambda h: (h[0], -h[1]))
                best = []
                for n, (i, j) in enumerate(group):
                    best.append(max([(1, k), *((c + 1, v + min(k, j - group[m][1])) for m, (c, v) in enumerate(best) if group[m][0] < i and group[m][1] < j)]))
                covered = max(v for _, v in best)
                span = max(i for i, _ in group) + k - min(i for i, _ in group)
                if len(group) + k - 1 >= licences.LEAST * len(t) and span <= 2 * len(t):
                    found[label] = max(found.get(label, 0), covered / len(t) if covered >= (1.0 if len(t) < licences.SHORT else licences.LEAST) * len(t) else 0)
    base = brute_license(text)[4]
    return ",".join(sorted({x for x, s in found.items() if s} | set(filter(None, base.split(","))))), 1.0 if base else max(found.values(), default=0.0)


def test_labels_against_brute_force(spark):
    """Templates whole, cut, with words put in, left out and shuffled, and repeated."""
    import random

    r = random.Random(4)
    every = [t for texts in licences.TEMPLATES.values() for t in texts]
    texts = []
    for t in every:
        w = t.split()
        texts += [t, " ".join(w[: len(w) * 2 // 3]), " ".join(x for x in w if r.random() < 0.93), " ".join(y for x in w for y in ((x, "indeed") if r.random() < 0.06 else (x,)))]
        parts = [w[i : i + 5] for i in range(0, len(w), 5)]
        r.shuffle(parts)
        texts += [" ".join(x for part in parts for x in part), f"x {t} y {t} {t[:40]}"]
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {k: brute_labels(t) for k, t in enumerate(texts)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(abs(got[k][1] - want[k][1]) > 0.02 for k in want) == 0
    assert all(label in got[6 * k][0].split(",") for k, label in enumerate(x for x, texts_ in licences.TEMPLATES.items() for _ in texts_))


def test_licenses(spark, docs, no_docs):
    texts = [*licences.TEMPLATES["mit"][:1], "x " + licences.TEMPLATES["apache-2.0"][0].replace(" except in", " indeed"), "cc by " * 50, "general public general public license", "permission is hereby granted"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + list(enumerate(texts, 100))
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = by_row(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute_license(t)) for i, t in rows), key=repr)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[100]["labels"] == "mit" and by_id[100]["score"] == 1.0
    assert by_id[101]["labels"] == "apache-2.0" and any(0.6 <= s["share"] < 1 for s in by_id[101]["spans"]) and by_id[104]["labels"] == "" and by_id[104]["score"] == 0
    assert licences.scan(no_docs).count() == 0
