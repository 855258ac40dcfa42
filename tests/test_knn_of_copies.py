"""Neighbour lists of tables with many equal vectors: equal vectors are compared once, and lists stay what they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import neighbours


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(ids, x)], "id long, v array<double>")


@pytest.mark.parametrize("of_each", [2, 7])
@pytest.mark.parametrize("kinds", [1, 4, 60])
def test_f16_lists_of_copies(spark, kinds, of_each):
    rng = np.random.default_rng(50)
    x = np.repeat(rng.integers(0, 4, (kinds, 2)).astype(float), of_each, 0)  # distances tie between kinds too
    x, ids = np.r_[x, x[:1], rng.normal(size=(3, 2))], rng.permutation(len(x) + 4) * 3
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {(ids[i], r, ids[j], d[i, j]) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], ids[j]))[:5], 1)}
    df = frame(spark, x, ids)
    got = neighbours.knn(df, 5, copies=0, far=True).collect()
    assert {(r.i, r["rank"], r.j, r.d) for r in got} == want and len(got) == len(want)
    assert all(r.far == max(o.d for o in got if o.i == r.i) for r in got[:40])
    assert neighbours.knn(df, 5, copies=0).dtypes == neighbours.knn(df, 5, copies=None).dtypes


def test_f16_copies_that_are_not_finite_have_no_lists(spark):
    x = np.array([[np.nan, 0.0], [np.nan, 0.0], [np.inf, 1.0], [np.inf, 1.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    want = {tuple(r) for r in neighbours.knn(frame(spark, x, range(8)), 3, copies=None).collect()}
    assert {tuple(r) for r in neighbours.knn(frame(spark, x, range(8)), 3, copies=0).collect()} == want
    assert {i for i, *_ in want} == {4, 5, 6, 7}


def test_f16_equal_vectors_are_compared_once(spark, monkeypatch):
    met, packed = [], neighbours._packed
    monkeypatch.setattr(neighbours, "_packed", lambda rows, *a: met.append(rows.count()) or packed(rows, *a))
    x = np.random.default_rng(51).normal(size=(40, 3))
    df = frame(spark, np.r_[x, x, x], range(120)).withColumn("id", F.col("id") * 2)
    monkeypatch.setattr(neighbours.knn, "__defaults__", (*neighbours.knn.__defaults__[:-1], 100))
    assert neighbours.knn(df, 4).count() == 480 and met == [40]
