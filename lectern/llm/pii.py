"""Personal data in DataFrame functions: base formats, and boosted trees over generous candidates.

Generators propose overlapping spans of four further kinds: numbers written like telephone
numbers, identity numbers, account numbers and disguised mail addresses. Gradient-boosted
trees judge each by its format and the words before it. They are trained by Spark's own
library on a fixed set of made-up examples (`examples`, bounded by their number), passed
through the same generators and features, and become a Column expression. A second part of
the examples calibrates the scores: pooled neighbours give for each score the share of
personal data among examples like it, in a rising order, and each kind's threshold is the
lowest score whose share reaches PRECISION (without one the kind is never accepted). A third
part, from forms and words that the other two lack, tells precision and recall (`report`). Of
accepted spans that overlap, the longer stays if it covers the other, else the better; spans that a base span touches go.

Defined cases: null texts are empty and empty texts have no spans; repeated rows repeat;
null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.native_spans import SPAN, apart_from, let, listed, running, sha256, spans

# The base formats, with possessive loops and anchors that find the same matches in one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The generators of further kinds.
GENERATORS = {
    "phone_like": r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){2,4}+(?![0-9A-Za-z])",
    "id_like": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account_like": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "mail_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z]{2,24}){1,4}+",
}
# Words before a span that speak for and against personal data.
FOR = r"(?i)\b(?:tel|telephone|phone|mobile|cell|call|fax|ring|text|whatsapp|iban|account|acct|bank|ssn|social|security|passport|tax|identity|mail|email|contact|write|reach|name)\b"
AGAINST = r"(?i)\b(?:version|ver|isbn|issn|order|invoice|page|pages|pp|vol|no|nr|chapter|section|date|dated|scores?|numbers?|price|total|usd|eur|doi|serial|part|build|release|between|from|until|art)\b"
# Common top-level domains.
DOMAIN = r"(?i)(?:\b|[\])])(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|eu|us|ch|at)$"
FEATURES = ("kind", "digits", "letters", "length", "groups", "blanks", "hyphens", "dots", "slashes", "parens", "first", "distinct", "year", "for_near", "against_near", "for_far", "domain", "last")
#: Characters before a candidate that are its context, and its near context.
CONTEXT, NEAR = 60, 18
PROPOSED = "struct<start:int,end:int,value:string,kind:int,before:string>"
JUDGED = "struct<start:int,end:int,value:string,kind:int,p:double>"
#: Made-up examples of each form, and the precision that thresholds aim at.
EXAMPLES_EACH = 150
PRECISION = 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the checksum of payment cards."""
    def add(s: Column, d: Column) -> Column:
        n = d.cast("int") * F.when(s["odd"], 1).otherwise(2)
        return F.struct((s["sum"] + n - F.when(n > 9, 9).otherwise(0)).alias("sum"), (~s["odd"]).alias("odd"))

    backwards = F.split(F.reverse(_digits(value)), "")
    return F.aggregate(backwards, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add, lambda s: s["sum"] % 10 == 0)


def base(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    octet = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))
    return {
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP, digit & text.rlike(IP)), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: octet(p) & small(p))),
        "card": F.filter(spans(text, CARD, digit & text.rlike("[0-9](?:[ -]?[0-9]){13}")), lambda x: luhn(x["value"])),
        "phone": F.filter(spans(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(_digits(x["value"])).between(10, 15)),
    }


def candidates(text: Column) -> Column:
    """All proposals: array of start, end, value, kind (its number among the generators), before (the text since the
    generator's last proposal, its last CONTEXT characters)."""
    tests = (text.rlike(r"[0-9][)]?[ ./-][0-9]"), text.rlike(r"[0-9]{3}-[0-9]{2}-"), text.rlike("[A-Z]{2}[0-9]{2}"), text.rlike(r"[\[(] ?at ?[\])]"))

    def proposed(k: int, pattern: str, test: Column) -> Column:
        return F.transform(spans(text, pattern, test, CONTEXT), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(k).alias("kind"), x["before"].alias("before")))

    return F.concat(*[proposed(k, p, test) for k, (p, test) in enumerate(zip(GENERATORS.values(), tests, strict=True))])


def features(x: Column) -> dict[str, Column]:
    """Format of a candidate and context before it, as numbers."""
    v, far = x["value"], x["before"]
    near = F.right(far, F.lit(NEAR))
    some = lambda p: F.length(F.regexp_replace(v, p, ""))
    flag = lambda c: c.cast("int")
    out = {
        "kind": x["kind"], "digits": some("[^0-9]"), "letters": some("[^A-Za-z]"), "length": F.length(v), "groups": F.size(F.split(v, "[^0-9A-Za-z]+")),
        "blanks": some("[^ ]"), "hyphens": some("[^-]"), "dots": some("[^.]"), "slashes": some("[^/]"), "parens": some("[^()]"),
        "first": F.length(F.regexp_extract(v, "^[^0-9A-Za-z]?([0-9A-Za-z]+)", 1)), "distinct": F.size(F.array_distinct(F.split(_digits(v), ""))),
        "year": flag(v.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")), "for_near": flag(near.rlike(FOR)), "against_near": flag(near.rlike(AGAINST)), "for_far": flag(far.rlike(FOR)), "domain": flag(v.rlike(DOMAIN)),
        "last": F.length(F.regexp_extract(v, "([0-9A-Za-z]+)[^0-9A-Za-z]*$", 1)),
    }
    return {k: out[k].cast("double") for k in FEATURES}


def examples() -> list[tuple[str, float]]:
    """Made-up lines with one candidate each, and whether it is personal data. The same every time."""
    r = random.Random(11)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    y = lambda: str(r.randint(1900, 2035))
    a = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    phone = lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(3)} {d(4)}", f"({d(4)}) {d(3)} {d(3)}"))
    account = lambda: r.choice(("DE", "FR", "GB", "ES", "IT", "CH", "AT")) + d(2) + r.choice(("", " " + a(4).upper())) + "".join(f" {d(4)}" for _ in range(r.randint(2, 5))) + r.choice(("", f" {d(2)}"))
    forms = [
        (1.0, ("call ", "phone: ", "tel. ", "my mobile is ", "fax ", "contact ", "reach me at ", "text ", "cell ", "ring "), phone),
        (1.0, ("", "and then ", "is "), lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"))),
        (1.0, ("ssn ", "social security ", "tax id ", "identity: ", "", "with ", "passport "), lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        (1.0, ("iban ", "account ", "bank: ", "", "pay to ", "acct "), account),
        (1.0, ("mail ", "write to ", "contact ", "", "or ", "at ", "email "), lambda: f"{a(r.randint(2, 9))}{r.choice(('', '.' + a(r.randint(1, 6)), d(2)))} {r.choice(('[at]', '(at)'))} {a(r.randint(3, 10))}{r.choice((' [dot] ', ' (dot) ', '.', ' . '))}{r.choice(('com', 'org', 'net', 'de', 'co'))}"),
        (0.0, ("dated ", "date ", "on ", "from ", "until ", "", "since ", "by ", "was ", "in "), lambda: r.choice((f"{d(2)}/{d(2)}/{y()}", f"{d(2)}.{d(2)}.{y()}", f"{y()}-{d(2)}-{d(2)}", f"{d(2)} {d(2)} {y()}"))),
        (0.0, ("version ", "build ", "release ", "", "at ", "ver "), lambda: r.choice((f"{d(2)}.{d(2)}.{d(3)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(2)}.{d(3)}.{d(4)}"))),
        (0.0, ("isbn ", "serial ", "part no ", "order ", "invoice ", ""), lambda: r.choice((f"{d(3)}-{d(2)}-{d(4)}-{d(2)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(4)}-{d(3)}-{d(2)}", f"{d(3)}-{d(3)}-{d(3)}-{d(3)}"))),
        (0.0, ("isbn ", "order ", "invoice no ", "part "), lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (0.0, ("score ", "between ", "numbers ", "total ", "", "were ", "of "), lambda: " ".join(d(r.randint(2, 3)) for _ in range(r.randint(3, 5)))),
        (0.0, ("pages ", "pp ", "vol ", "", "lines ", "sizes "), lambda: r.choice((f"{d(2)}-{d(2)}-{d(2)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}/{d(2)}/{d(2)}"))),
        (0.0, ("model ", "serial ", "part ", "order ", "", "a ", "type "), lambda: f"{a(2).upper()}{d(2)} {a(4).upper()} {a(4).upper()}"),
        (0.0, ("order ", "serial ", "part no ", "invoice no ", "invoice "), lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        (0.0, ("the party ", "we met "), lambda: f"{a(r.randint(2, 9))} {r.choice(('[at]', '(at)'))} {a(r.randint(3, 10))} . {a(r.randint(3, 8))}"),
    ]
    return [(f"{a(5)} {a(3)} {a(6)} {r.choice(before)}{make()} {a(4)} {a(7)}", label) for label, before, make in forms for _ in range(EXAMPLES_EACH)]


@functools.cache
def _model(application: str) -> tuple[list, list[float], list[float]]:
    """Trees as nested tuples, their weights, and a threshold for each generator."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(examples())], "i int, text string, label double").repartition(1)
    rows = rows.withColumn("x", F.explode(candidates(F.col("text"))))
    rows = rows.select("i", "label", *[c.alias(k) for k, c in features(F.col("x")).items()])
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).cache()
    model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=1).fit(made.where("i % 2 = 0"))

    def tree(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return (split.featureIndex(), split.threshold(), tree(node.leftChild()), tree(node.rightChild()))

    trees = [tree(t._call_java("rootNode")) for t in model.trees]
    judged = model.transform(made.where("i % 2 = 1")).select("kind", "probability", "label").collect()
    made.unpersist()
    held = [(int(r["kind"]), float(r["probability"][1]), r["label"]) for r in judged]
    return trees, list(model.treeWeights), [threshold([(p, y) for kind, p, y in held if kind == k]) for k in range(len(GENERATORS))]


def threshold(judged: list[tuple[float, float]], precision: float = PRECISION) -> float:
    """Lowest score whose calibrated probability (by pooling neighbours that fall) reaches the precision; 2 if none does.

    A share of few examples is drawn towards one half by one example of each kind.
    """
    pools: list[list[float]] = []  # lowest score, positives, examples
    for p, y in sorted(judged):
        pools.append([p, y, 1.0])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            _, positives, n = pools.pop()
            pools[-1][1] += positives
            pools[-1][2] += n
    return next((p for p, positives, n in pools if (positives + 1) / (n + 2) >= precision), 2.0)


def report(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of the added spans against truth (doc_id, start, end): one row."""
    spans_ = scan(documents).select("doc_id", F.explode(F.concat(*GENERATORS)).alias("s")).select("doc_id", "s.start", "s.end")
    hit = spans_.join(truth, ["doc_id", "start", "end"], "left_semi").agg(F.count("*").alias("hits"))
    every = spans_.agg(F.count("*").alias("found")).crossJoin(truth.agg(F.count("*").alias("true"))).crossJoin(hit)
    return every.select((F.col("hits") / F.col("found")).alias("precision"), (F.col("hits") / F.col("true")).alias("recall"), "found", "true")


def score(x: dict[str, Column], trees: list, weights: list[float]) -> Column:
    """Probability from the trees, as an expression."""
    names = list(FEATURES)

    def grow(t: tuple | float) -> Column:
        return F.lit(float(t)) if not isinstance(t, tuple) else F.when(x[names[t[0]]] <= t[1], grow(t[2])).otherwise(grow(t[3]))

    margin = functools.reduce(lambda a, b: a + b, [grow(t) * w for t, w in zip(trees, weights, strict=True)])
    return 1 / (1 + F.exp(-2 * margin))


def winners(accepted: Column) -> Column:
    """Of spans that overlap, the best: in order of start, each meets the last that stands. Of two, one that covers the other
    and more stays, else the one of the higher score, of equals the more specific kind."""
    kind = f"struct<cur:{JUDGED},out:{JUDGED}>"
    nothing = F.lit(None).cast(JUDGED)

    def meet(last: Column, x: Column) -> Column:
        cur = last["cur"]
        covers = (x["start"] <= cur["start"]) & (x["end"] >= cur["end"]) & (x["end"] - x["start"] > cur["end"] - cur["start"])
        covered = (cur["start"] <= x["start"]) & (cur["end"] >= x["end"]) & (cur["end"] - cur["start"] > x["end"] - x["start"])
        better = covers | (~covered & ((x["p"] > cur["p"]) | ((x["p"] == cur["p"]) & (x["kind"] > cur["kind"]))))
        over = cur.isNotNull() & (x["start"] < cur["end"])
        return F.struct(F.when(over & ~better, cur).otherwise(x).alias("cur"), F.when(over, nothing).otherwise(cur).alias("out"))

    def stood(states: Column) -> Column:
        out = F.transform(states, lambda s: s["out"])
        return F.filter(F.concat(out, F.array(F.try_element_at(states, F.lit(-1))["cur"])), lambda x: x.isNotNull())

    start = F.struct(nothing.alias("cur"), nothing.alias("out"))
    return let(F.sort_array(accepted), lambda every: let(running(every, start, meet, kind), stood))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, arrays of spans (start, end, value) named email, ip, card, phone and as the generators."""
    trees, weights, limits = _model(documents.sparkSession.sparkContext.applicationId)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = base(F.col("text"))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in kinds.items()], candidates(F.col("text")).alias("proposed"))
    free = apart_from(F.col("proposed"), F.concat(*kinds), f"array<{PROPOSED}>")

    def judged(x: Column) -> Column:
        return let(F.struct(*[c.alias(k) for k, c in features(x).items()]), lambda f: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["kind"].alias("kind"), score({k: f[k] for k in FEATURES}, trees, weights).alias("p")))

    limit = F.array(*[F.lit(v) for v in limits])
    rows = rows.withColumn("judged", F.transform(free, judged))
    rows = rows.withColumn("best", winners(F.filter("judged", lambda x: x["p"] >= F.element_at(limit, x["kind"] + 1))))

    def own(k: int) -> Column:
        return F.transform(F.filter("best", lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).cast(SPAN)

    return rows.select("doc_id", *kinds, *[own(k).alias(name) for k, name in enumerate(GENERATORS)])


def digest(scanned: DataFrame) -> DataFrame:
    fixed = {k: F.col(k) for k in ("email", "ip", "card", "phone")}
    return scanned.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in fixed.items()], sha256(listed(fixed)).alias("base_sha256"),
        listed(fixed | {k: F.col(k) for k in GENERATORS}).alias("spans"))
