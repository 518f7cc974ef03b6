"""The driver fits the scorer in single precision: no copies of the sample in double precision beside it."""

import tracemalloc

import numpy as np

from lectern.llm import quality


def test_fit_holds_the_sample_once_more():
    x = np.random.default_rng(3).random((1000, quality.DIMENSIONS), np.float32)
    tracemalloc.start()
    quality.train(x, np.linspace(0, 1, 1000), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes
