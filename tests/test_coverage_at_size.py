"""Coverage orders chosen many points at a time: equal to the plain way, and as quick as they must be."""

import time

import numpy as np
import pytest

from sievecraft.operators import sequence

rng = np.random.default_rng(31)
POINTS = {
    "lattice": np.stack(np.divmod(np.arange(1600), 40), 1).astype(float), "copies and ties": rng.integers(0, 40, (2500, 2)).astype(float), "steps": np.c_[np.arange(900.0), np.zeros(900)],
    "dense spot": np.r_[rng.normal(size=(900, 2)) * 1e-6, rng.normal(size=(900, 2))], "far off": np.r_[rng.normal(size=(900, 2)), [[1e12, -1e12]]],
}


@pytest.mark.parametrize("name", POINTS)
def test_points_chosen_at_once_keep_the_plain_order(name, monkeypatch):
    x = POINTS[name]
    monkeypatch.setattr(sequence, "PAIRS", 1 << 10, raising=False)  # several pieces
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    assert sequence.coverage(x).tolist() == sequence._plain_coverage(x, first).tolist()


def test_a_hundred_thousand_points_take_seconds():
    began = time.process_time()
    assert len(set(sequence.coverage(rng.normal(size=(100_000, 2))).tolist())) == 100_000
    assert time.process_time() - began < 8  # point after point takes about 15
