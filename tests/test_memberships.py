"""Memberships of many lists at a time."""

import numpy as np

from sievecraft.operators import neighbours


def test_lists_of_a_length_are_weighed_together():
    d = np.sort(np.random.default_rng(33).random((500, 12)), 1)
    d[0], d[1, :4], d[2] = 0.0, 0.0, 0.25
    w = neighbours._weights(d)
    assert np.allclose(w[3:].sum(1), np.log2(12), atol=1e-4) and (w[3:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    assert (w[0] == 1).all() and (w[2] == 1).all() and (w[1, :5] == 1).all()
    assert all(np.array_equal(neighbours._weights(r[None])[0], v) for r, v in zip(d[:20], w))
