"""Coverage orders by cells against the plain way."""

import numpy as np
import pytest

from sievecraft.operators import sequence

rng = np.random.default_rng(30)
POINTS = {
    "normal": rng.normal(size=(700, 2)), "lattice": rng.integers(0, 12, (800, 2)).astype(float), "copies": np.repeat(rng.normal(size=(50, 2)), 9, 0), "line": rng.normal(size=(500, 1)), "five": rng.normal(size=(500, 5)),
    "one": np.ones((20, 2)), "upright": np.c_[np.ones(300), rng.normal(size=300)], "outliers": rng.standard_cauchy(size=(600, 2)), "flat": np.c_[np.zeros((200, 2)), rng.normal(size=(200, 1))],
}


@pytest.mark.parametrize("name", POINTS)
def test_coverage_equals_the_plain_way(name):
    x = POINTS[name]
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    assert sequence.coverage(x).tolist() == sequence._plain_coverage(x, first).tolist()


def test_coverage_of_many_points_is_quick():
    import time

    began = time.process_time()
    assert len(set(sequence.coverage(rng.normal(size=(40_000, 2))).tolist())) == 40_000
    assert time.process_time() - began < 20  # the plain way takes a minute
