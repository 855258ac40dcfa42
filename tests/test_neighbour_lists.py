"""Neighbour lists whose bounds come from a row's own tile, and what is made of lists."""

import numpy as np
import pytest

from sievecraft.operators import neighbours


def tile(x, ids, **more):
    n = len(x)
    return {"id": np.asarray(ids, np.int64), "v": x, "p": np.zeros((n, 0)), "of": np.ones(n, bool), "apart": np.full(n, -1)} | more


def test_one_product_serves_both_tiles_of_a_pair():
    x = np.random.default_rng(30).normal(size=(300, 6))
    a, b = tile(x[:140], range(140)), tile(x[140:], range(140, 300))
    bounds = [neighbours._nearest(t, t, 5, 9, False).bound for t in (a, b)]
    best, back = neighbours._nearest_both(a, b, 5, 9, False, bounds)
    d = np.round(np.sqrt(((x[:140, None] - x[None, 140:]) ** 2).sum(2)), 9)
    for got, d, bound in ((best, d, bounds[0]), (back, d.T, bounds[1])):
        order = np.argsort(d, 1, kind="stable")[:, :5]
        want = {(i, j) for i in range(len(d)) for j in order[i] if d[i, j] <= bound[i]}
        assert set(zip(got.i.tolist(), got.j.tolist())) == want and len(got.i) == len(want) < 5 * len(d)


def test_tiles_out_of_reach_give_no_pairs():
    x = np.random.default_rng(31).normal(size=(200, 4))
    x[100:] += 50
    a, b = tile(x[:100], range(100)), tile(x[100:], range(100, 200))
    bounds = [neighbours._nearest(t, t, 3, 9, False).bound for t in (a, b)]
    assert [len(r.i) for r in neighbours._nearest_both(a, b, 3, 9, False, bounds)] == [0, 0]


@pytest.mark.parametrize("size", [20, 4096])
def test_lists_with_copies_and_rows_kept_apart(spark, size):
    rng = np.random.default_rng(32)
    x = np.concatenate([rng.integers(0, 2, size=(90, 3)).astype(float), rng.normal(size=(40, 3))])
    n = len(x)
    rated, fold = rng.random(n) < 0.4, rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, x[i].tolist(), bool(rated[i]), int(fold[i])) for i in range(n)], "id long, v array<double>, rated boolean, fold int")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    ok = rated[None, :] & (fold[:, None] != fold[None, :])
    want = {(i, r, j) for i in range(n) for r, j in enumerate(sorted(np.flatnonzero(ok[i] & (np.arange(n) != i)).tolist(), key=lambda j: (d[i, j], j))[:7], 1)}
    assert {(r.i, r["rank"], r.j) for r in neighbours.knn(df, 7, tile=size, of="rated", apart="fold").collect()} == want
