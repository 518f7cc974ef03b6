"""Weak-label quality model: heuristic labellers, expectation-maximisation, hashed linear scorer.

Each labeller votes good, bad or nothing on the whole text. Counts of vote patterns over all
documents (at most 3 ** labellers of them) are all that expectation-maximisation needs: it
estimates each labeller's accuracy per class and gives each pattern its posterior (a
labeller that does not vote is no evidence). Posteriors
of a bounded sample train a logistic scorer on hashed features, which then scores every row.

Defined cases: null, empty and blank texts get the vote "bad" for length and score like
any other text; repeated rows are scored alike; null ids are kept; an empty table trains
a scorer that keeps all; extra columns are ignored by `score` and kept by `kept`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import map_rows

#: Rows that train the scorer, at most.
SAMPLE_ROWS = 4000
#: Hashed features: of byte classes and events, and of words and pairs of words.
SHAPES, WORDS = 1024, 1024
DIMENSIONS = SHAPES + WORDS
#: Weight of the words' features beside the others.
WORD_WEIGHT = 0.5
#: Score from which a document is kept.
THRESHOLD = 0.5
GOOD, BAD, NONE = 0, 1, 2

# Classes of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 sentence mark, 6 exclamation, 7 quote or bracket, 8 hyphen, 9 UTF-8, 10-14 symbols, 15 other
_CLASS = np.full(256, 15, np.uint8)
for _at, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?", b"!", b"\"'()[]", b"-_", bytes(range(128, 256)), b"#$%", b"&*+", b"|/\\", b"<>{}=", b"@^`~")):
    _CLASS[list(_bytes)] = _at
#: Symbols and exclamation marks, at the end of a word.
_EDGE = np.isin(np.arange(16), (6, 10, 11, 12, 13, 14))
_SPREAD = (np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 10)).astype(np.int64)


def measured(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Measures of the whole text for the labellers, the classes of its bytes, and its words."""
    raw = (text or "").encode()
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(kinds, minlength=16).astype(float)
    words = raw.split()
    n, solid = len(words), max(1.0, share.sum() - share[3] - share[4])
    again = sum(map(eq, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return np.array([
        n, share[10:16].sum() / solid, again / max(1, n - 1), share[1] / max(1.0, share[0] + share[1]), share[6] / max(1, n),
        len(set(words)) / max(1, n), repeated, len(raw) / max(1, n), share[2] / solid,
        min(1.0, (_EDGE[kinds[:-1]] & ((kinds[1:] == 3) | (kinds[1:] == 4))).sum() / max(1, n)) if len(kinds) > 1 else 0.0,
    ]), kinds, words


def signals(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures of the whole text, and its hashed features."""
    measures, kinds, words = measured(text)
    n, shapes = len(words), np.zeros(SHAPES)
    if len(kinds) > 2:
        k = kinds.astype(np.int64)
        shapes = np.bincount(_SPREAD[k[:-2] * 256 + k[1:-1] * 16 + k[2:]], minlength=SHAPES) / (len(kinds) - 2)
    events = np.zeros(SHAPES)  # hashed by name: word repetitions by rate, line repetitions, length, distinct words
    for name, value in ((1, measures[2]), (2, measures[6]), (3, min(1.0, 8 / max(1, n))), (4, measures[5] if n >= 50 else 0.5)):
        events[_SPREAD[name * 331 % 4096]] += value
    return measures, np.r_[np.sqrt(shapes) + events, word_features(words)]


def word_features(words: list[bytes]) -> np.ndarray:
    """Hashed words and pairs of words, of a length that does not depend on their number."""
    out = np.zeros(WORDS)
    if words:
        alone = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.uint64)
        pairs = alone[:-1] * np.uint64(0x9E3779B97F4A7C15) + alone[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        for some in (alone, pairs):
            out[(some * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 10)).astype(np.int64)] = 1.0
        out *= WORD_WEIGHT / np.sqrt(out.sum())
    return out


def votes(measures: np.ndarray) -> list[int]:
    """One vote of each labeller."""
    n, symbols, again, upper, exclaims, distinct, repeated, length, digits, marked = measures

    def two(value: float, good: float, bad: float) -> int:
        return BAD if value >= bad else GOOD if value <= good else NONE

    return [
        BAD if n < 1 else GOOD if n >= 20 else NONE,
        two(symbols, 0.04, 0.08),
        two(again, 0.05, 0.2) if n >= 5 else NONE,
        two(upper, 0.3, 0.6),
        two(exclaims, 0.05, 0.3),
        two(-distinct, -0.3, -0.1) if n >= 50 else NONE,
        two(repeated, 0.3, 0.6),
        two(length, 12.0, 20.0),
        two(digits, 0.2, 0.5),
        two(marked, 0.15, 0.4) if n >= 5 else NONE,
    ]


LABELLERS = 10


def pattern(vote: list[int]) -> int:
    return int(sum(v * 3**k for k, v in enumerate(vote)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" per pattern, accuracies (class, labeller, vote) and the prior of "good"."""
    vote = (patterns[:, None] // 3 ** np.arange(LABELLERS)) % 3
    post = np.where((vote == BAD).any(axis=1), 0.1, 0.95)
    table = np.zeros((2, LABELLERS, 3))
    prior = 0.9
    for _ in range(rounds):
        for c, weight in enumerate((post * counts, (1 - post) * counts)):
            for v in (GOOD, BAD):
                table[c, :, v] = (weight[:, None] * (vote == v)).sum(axis=0) + 0.5
        table /= table[:, :, :2].sum(axis=2, keepdims=True)
        table[:, :, NONE] = 1.0  # no vote, no evidence
        prior = (np.dot(post, counts) + 1) / (counts.sum() + 2)
        logs = [np.where(vote == NONE, 0.0, np.log(table[c][np.arange(LABELLERS), vote])).sum(axis=1) for c in (0, 1)]
        odds = logs[0] - logs[1] + np.log(prior) - np.log1p(-prior)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table, float(prior)


def train(features: np.ndarray, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps."""
    if not len(features):
        return np.zeros(DIMENSIONS), 10.0
    x = np.ones((len(features), features.shape[1] + 1), np.float32)
    x[:, :-1] = features
    balance = np.where(target >= 0.5, 0.5 / max(1e-9, (target >= 0.5).mean()), 0.5 / max(1e-9, (target < 0.5).mean()))
    target, balance = target.astype(np.float32), balance.astype(np.float32)
    steep = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # the steepest direction by powers
        steep = x.T @ (balance * (x @ steep))
        size = np.linalg.norm(steep)
        steep /= size
    top = np.float32(0.26 * size / len(x) + ridge)
    w, ahead, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), np.float32(1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        new = ahead - (x.T @ ((p - target) * balance) / len(x) + ridge * ahead) / top
        t, before = np.float32((1 + np.sqrt(1 + 4 * t * t)) / 2), t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w[:-1].astype(float), float(w[-1])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer: votes of every document, posteriors, then a bounded sample."""
    docs = documents.select(F.col(text_col).alias("text"))

    def vote() -> Callable:
        return lambda cols: {"pattern": [pattern(votes(measured(t)[0])) for t in cols["text"]]}

    found = map_rows(docs, vote, "pattern int").groupBy("pattern").count().collect()
    patterns, counts = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float)
    post, _, _ = expectation_maximisation(patterns, counts) if len(found) else (np.zeros(0), None, 0.9)
    of = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    share = min(1.0, 1.2 * sample_rows / max(1.0, counts.sum()))
    draw = documents.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))  # the same rows in whatever files
    draw = draw.where(F.pmod("draw", F.lit(1_000_003)) <= int(share * 1_000_003))

    def features() -> Callable:
        def step(cols: dict) -> dict:
            both = [signals(t) for t in cols["text"]]
            return {"draw": cols["draw"], "pattern": [pattern(votes(m)) for m, _ in both], "x": [f.astype("<f4").tobytes() for _, f in both]}

        return step

    rows = map_rows(draw, features, "draw long, pattern int, x binary").orderBy("draw", "pattern", "x").limit(sample_rows).collect()
    x = np.empty((len(rows), DIMENSIONS), np.float32)  # in single precision, as sent and as fitted: the driver holds it twice
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], "<f4")
    return train(x, np.array([of[r["pattern"]] for r in rows]))


def scorer(model: tuple[np.ndarray, float]):
    """A pandas UDF from text to score (0 to 1)."""
    weights, bias = model

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            z = np.array([float(signals(t)[1] @ weights) for t in s]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))), dtype=float)

    return F.pandas_udf(score, "double")


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score, keep."""
    one = scorer(fit(documents, id_col, text_col))
    found = documents.select(F.col(id_col).alias("doc_id"), one(F.col(text_col)).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))


def kept(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the scorer keeps."""
    return documents.where(scorer(fit(documents, id_col, text_col))(F.col(text_col)) >= threshold)
