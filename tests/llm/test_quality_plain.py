"""The quality classifier against a plain recomputation: votes counted one by one, expectation-maximisation by loops, plain training."""

import math
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality
from lectern.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_posteriors(texts):
    """Probability of "good" for each pattern of votes."""
    votes = [tuple(quality.votes(quality.measured(t)[0])) for t in texts]
    counts = Counter(votes)
    post = {v: 0.1 if quality.BAD in v else 0.95 for v in counts}
    for _ in range(100):
        right = {c: [{quality.GOOD: 0.0, quality.BAD: 0.0} for _ in range(quality.LABELLERS)] for c in (0, 1)}
        for v, n in counts.items():
            for c, p in ((0, post[v]), (1, 1 - post[v])):
                for k, x in enumerate(v):
                    if x != quality.NONE:
                        right[c][k][x] += p * n
        rate = {c: [{x: (w[x] + 0.5) / (sum(w.values()) + 1) for x in w} for w in right[c]] for c in (0, 1)}
        prior = (sum(post[v] * n for v, n in counts.items()) + 1) / (len(texts) + 2)
        new = {}
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[0][k][x] / rate[1][k][x]) for k, x in enumerate(v) if x != quality.NONE)
            new[v] = 1 / (1 + math.exp(-min(40, max(-40, odds))))
        done = max(abs(new[v] - post[v]) for v in new) < 1e-9
        post = post if done else new
        if done:
            break
    return votes, post


def test_scores(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    votes, post = plain_posteriors([r["text"] for r in rows])
    x = np.array([quality.signals(r["text"])[1] for r in rows])
    target = np.array([post[v] for v in votes])
    x1 = np.c_[x, np.ones(len(x))]
    balance = np.where(target >= 0.5, 0.5 / (target >= 0.5).mean(), 0.5 / (target < 0.5).mean())
    # the steepest direction exactly; then the same number of accelerated steps in double precision
    top = 0.26 * np.linalg.eigvalsh((x1 * balance[:, None]).T @ x1)[-1] / len(x1) + 1e-4
    w = ahead = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(x1 @ ahead)))
        new = ahead - (x1.T @ ((p - target) * balance) / len(x1) + 1e-4 * ahead) / top
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    want = {r["doc_id"]: s for r, s in zip(rows, 1 / (1 + np.exp(-(x1 @ w))), strict=True)}
    got = {r["doc_id"]: (r["score"], r["keep"]) for r in quality.score(docs).collect()}
    assert set(got) == set(want)
    assert max(abs(got[i][0] - want[i]) for i in want) < 0.02
    sure = [i for i in want if abs(want[i] - quality.THRESHOLD) > 0.02]
    assert len(sure) > 0.9 * len(want) and all(got[i][1] == (want[i] >= quality.THRESHOLD) for i in sure)


def test_posteriors():
    texts = ["A plain line of words, as long as twenty words need to be so that it counts as good text for all of them."] * 30 + ["$$$ ### !!!"] * 5 + ["", None, "word " * 60, "UPPER CASE WORDS ONLY " * 6]
    votes, post = plain_posteriors(texts)
    counts = Counter(quality.pattern(list(v)) for v in votes)
    codes = np.array(sorted(counts))
    got, _, _ = quality.expectation_maximisation(codes, np.array([counts[c] for c in codes], float))
    of = {quality.pattern(list(v)): p for v, p in post.items()}
    assert got == pytest.approx([of[c] for c in codes], abs=1e-6)
