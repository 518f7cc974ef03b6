"""Secret scan in DataFrame functions: fixed formats, and windowed entropy over candidate strings.

Candidates are unbroken strings of key characters. Each candidate gets a class (hex, or mixed
letters and digits), and so does each of its parts between separators (letters of one case and
digits, hexadecimal digits, or letters alone, which also need fewer vowels than words have). A window of `WINDOW`
characters slides over it; the sum of n * log2(n) over its character counts changes only by the
counts of the character that enters and the one that leaves, which gives Shannon entropy step by step. A candidate whose best window
reaches its class's threshold is a secret, unless it is on the allow-list: identifiers of
published formats, words, paths, and strings of few kinds of characters. Samples and runs in order
take only the part between separators that holds them from a candidate.

Defined cases: null texts are empty and empty texts have no spans; repeated rows repeat;
null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.native_spans import SPAN, apart_from, let, listed, sha256, spans

# The base formats. (?i:...) is ASCII in Java's regular expressions.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Key characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates for entropy: strings of key characters, at least this long.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
#: Characters in a window, and the entropy (bits a character) that its class must reach in one window.
WINDOW = 20
ENTROPY = {"hex": 3.0, "mixed": 3.7, "lower": 3.5, "upper": 3.4, "letters": 3.75, "one case": 3.4, "signed": 3.2}
#: Vowels at most, as a share, of letters alone that are no words.
VOWELS = {"letters": 0.3, "one case": 0.25}
# Forms that look random but are not secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9_=/+-]*$",  # numbers alone
    r"^[A-Za-z]+$",  # one word
    r"^[A-Za-z_/=+-]*$",  # words joined by separators
    r"^(?:/[A-Za-z0-9_-]{1,19})+/?$",  # paths of short names
)
#: Runs in order and samples, and the part of a candidate that holds one.
SAMPLES = r"(?i:0123456789|abcdefghijklm|qwertyuiop|example|placeholder|changeme|xxxxxx)"
SAMPLE = rf"[^/_=+-]*{SAMPLES}[^/_=+-]*"
#: How the tokens of signed headers begin; their class needs less entropy.
SIGNED = "eyJ"


def _term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of `window` consecutive key characters of value.

    The state holds a count for each character of ALPHABET. A step takes one from the character
    that leaves, adds one to that which enters, and mends the sum of n * log2(n) by those two.
    """
    size = len(ALPHABET)

    def changed(counts: Column, at: Column, by: int) -> Column:
        new = F.array(F.element_at(counts, at) + by)
        return F.concat(F.slice(counts, F.lit(1), at - 1), new, F.slice(counts, at + 1, size - at))

    def slide(places: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def leave(s: Column) -> Column:
            gone = F.element_at(places, s["at"] - window + 1)
            n = F.element_at(s["counts"], gone)
            out = F.struct(s["at"].alias("at"), changed(s["counts"], gone, -1).alias("counts"), (s["sum"] - _term(n) + _term(n - 1)).alias("sum"), s["best"].alias("best"))
            return F.when(s["at"] >= window, out).otherwise(s)

        def enter(s: Column, place: Column) -> Column:
            n = F.element_at(s["counts"], place)
            total = s["sum"] - _term(n) + _term(n + 1)
            entropy = F.log2(F.lit(float(window))) - total / window
            return F.struct((s["at"] + 1).alias("at"), changed(s["counts"], place, 1).alias("counts"), total.alias("sum"),
                            F.when(s["at"] + 1 >= window, F.greatest(s["best"], entropy)).otherwise(s["best"]).alias("best"))

        return F.aggregate(places, state, lambda s, place: let(leave(s), lambda t: enter(t, place)), lambda s: s["best"])

    return let(F.transform(F.split(value, ""), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c), F.lit(1))), slide)


def is_secret_part(part: Column) -> Column:
    """Letters of one case with digits, or letters alone, that reach their class's entropy."""
    vowels = F.length(F.regexp_replace(part, "[^aeiouyAEIOUY]", "")) / F.length(part)
    least = F.when(part.rlike("^(?=.*[0-9].*[0-9])(?=.*[g-z])[a-z0-9]+$"), ENTROPY["lower"]).when(part.rlike("^(?=.*[0-9].*[0-9])(?=.*[G-Z])[A-Z0-9]+$"), ENTROPY["upper"])
    # hexadecimal digits behind a short prefix, in one case or both
    least = least.when(part.rlike("^(?=[^0-9]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]+$"), ENTROPY["hex"])
    least = least.when(part.rlike("^(?:[a-z]+|[A-Z]?[a-z]+|[A-Z]+)$") & (vowels <= VOWELS["one case"]), ENTROPY["one case"])
    least = least.when(part.rlike("^(?=.*[a-z])(?=.*[A-Z].*[A-Z])[A-Za-z]+$") & (vowels <= VOWELS["letters"]), ENTROPY["letters"])
    return F.coalesce((F.length(part) >= WINDOW) & least.isNotNull() & (best_entropy(part) >= least), F.lit(False))


def without_samples(candidate: Column) -> Column:
    """The candidate without the parts between separators that hold a sample or a run in order."""
    parts = F.regexp_extract_all(candidate, F.lit("[/_=+-]+|[^/_=+-]+"), F.lit(0))
    return F.when(candidate.rlike(SAMPLES), F.array_join(F.filter(parts, lambda p: ~p.rlike(SAMPLES)), "")).otherwise(candidate)


def is_allowed(value: Column) -> Column:
    """Whether value has a form of ALLOWED. The last, which repeats a group, is told part by part: a long value would be too deep for it."""
    allowed = value.rlike(ALLOWED[0])
    for form in ALLOWED[1:-1]:
        allowed = allowed | value.rlike(form)
    names = F.split(F.regexp_replace(value, "^/|/$", ""), "/", -1)
    return allowed | (value.startswith("/") & ~value.rlike("[+=]") & F.forall(names, lambda n: F.length(n).between(1, 19)))


def is_secret(candidate: Column) -> Column:
    def told(value: Column) -> Column:
        hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        classes = value.rlike("[0-9]") & F.when(hexadecimal, value.rlike("[A-Fa-f]")).otherwise(value.rlike("[A-Z]") & value.rlike("[a-z]"))
        least = F.when(hexadecimal, F.lit(ENTROPY["hex"])).when(value.startswith(SIGNED), F.lit(ENTROPY["signed"])).otherwise(F.lit(ENTROPY["mixed"]))
        whole = classes & ~is_allowed(value) & (best_entropy(value) >= least)
        return whole | (~value.rlike(ALLOWED[0]) & F.exists(F.split(value, "[/_=+-]+"), lambda p: let(p, is_secret_part)))

    return let(without_samples(candidate), told)


def found(text: Column) -> dict[str, Column]:
    """Arrays of spans by kind: assign, access, hex (fixed formats) and entropy."""
    named = F.lower(text).rlike("passw|secret|token|api_?key")
    assign = F.filter(spans(text, ASSIGN, named), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 8)
    return {
        "assign": assign, "access": spans(text, ACCESS, text.contains("AKIA")),
        "hex": spans(text, HEX, text.rlike("[0-9a-f]{32}")),
        "entropy": F.filter(spans(text, CANDIDATE, text.rlike(CANDIDATE)), lambda x: is_secret(x["value"])),
    }


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, arrays of spans (start, end in code points, value) named assign, access, hex, entropy.

    Strings that a base span covers are not reported a second time by entropy.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in found(F.col("text")).items()])
    return rows.withColumn("entropy", apart_from(F.col("entropy"), F.concat("assign", "access", "hex"), SPAN))


def digest(scanned: DataFrame) -> DataFrame:
    base = {k: F.col(k) for k in ("assign", "access", "hex")}
    return scanned.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()], sha256(listed(base)).alias("base_sha256"),
        listed(base | {"entropy": F.col("entropy")}).alias("spans"))
