"""Blends of neighbours whose vectors are summed whole."""

import numpy as np
from pyspark.sql import functions as F

from sievecraft.operators import blend, neighbours


def test_means_of_nulls_and_unequal_lengths_in_one_row_a_group(spark):
    rows = [(1, 1.0, [1.0, None]), (1, 3.0, [5.0, None, 7.0]), (1, 2.0, None), (2, 1.0, []), (3, None, [4.0]), (3, 2.0, [6.0])]
    df = spark.createDataFrame(rows, "g int, w double, v array<double>")
    means = blend.weighted_means(df, "g", digits=6)
    assert sorted(map(tuple, means.collect())) == [(1, 0, 4.0), (1, 1, None), (1, 2, 7.0), (3, 0, 6.0)]
    # a component's row is made after the exchange, not before
    assert means._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert "Generate" in means._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_vectors_meet_only_the_neighbours_that_are_blended(spark):
    near = spark.createDataFrame([(t, (t * 3 + r) % 11, r / 4, r, (t + r) % 2) for t in range(6) for r in range(1, 10)], "target long, id long, d double, rank int, kind int")
    v = spark.createDataFrame([(i, [i * 1.5, 40.0 - i]) for i in range(11)], "id long, v array<double>")
    got = blend.interpolate(near, taken=3, vectors=v).collect()
    assert sorted(got) == sorted(blend.interpolate(near.join(v, "id"), taken=3).collect()) and len(got) == 12


def test_those_of_the_voted_kind_are_blended_however_far(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(70, 3)), np.repeat(rng.normal(size=(1, 3)), 20, 0)])
    kinds = [int(c) for c in rng.integers(0, 9, 90)]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    rows = spark.createDataFrame([(i, [float(a) for a in r], c) for i, (r, c) in enumerate(zip(x, kinds))], "id long, v array<double>, kind int")
    params = spark.createDataFrame([(i, [i * 7.0]) for i in range(90)], "id long, v array<double>")
    near = neighbours.knn(rows, 6, tile=40).select(F.col("i").alias("target"), F.col("j").alias("id"), "d", "rank").join(rows.select("id", "kind"), "id")
    got = {(r.target, r.kind): r.value for r in blend.interpolate(near, voters=6, taken=4, vectors=params, rows=rows).collect()}

    want, beyond = {}, 0
    for t in range(90):
        order = sorted((d[t, j], j) for j in range(90) if j != t)
        votes = {}
        for dist, j in order[:6]:
            votes[kinds[j]] = votes.get(kinds[j], 0) + 1 / (dist * dist + 1e-6)
        kind = min(votes, key=lambda c: (-round(votes[c], 9), c))
        same = [(dist, j) for dist, j in order if kinds[j] == kind][:4]
        beyond += same[-1] not in order[:6]
        w = [np.exp(-1.8 * dist / max(same[-1][0], 1e-9)) for dist, _ in same]
        want[t, kind] = np.floor(round(sum(7 * j * a for (_, j), a in zip(same, w)) / sum(w), 9) + 0.5)
    assert got == want and beyond > 40


def test_neighbours_of_a_block_in_tiles(spark):
    rng = np.random.default_rng(6)
    x, block = np.concatenate([rng.normal(size=(100, 3)), np.ones((30, 3))]), rng.integers(0, 2, 130)
    rows = spark.createDataFrame([(i, [float(a) for a in r], int(b)) for i, (r, b) in enumerate(zip(x, block))], "id long, v array<double>, b int")
    asked = rows.where("id % 3 = 0").withColumn("b", F.expr("int(id % 2)"))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {(i, r, j) for i in range(0, 130, 3) for r, j in enumerate([j for _, j in sorted((d[i, j], j) for j in range(130) if j != i and block[j] == i % 2)][:5], 1)}
    for tile in (20, 4096):
        assert {(r.i, r["rank"], r.j) for r in neighbours.knn_of_block(asked, rows, 5, "b", tile=tile).collect()} == want
