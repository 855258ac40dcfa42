"""Neighbours and chains where products of matrices in single precision cannot tell rows apart, and how much leaves the tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import components, families, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("spread,offset", [(1.0, 0.0), (1e-6, 0.0), (1e-3, 1e4), (1e30, 0.0)])
def test_knn_where_rows_are_hard_to_tell_apart(spark, spread, offset):
    rng = np.random.default_rng(20)
    x = np.concatenate([rng.normal(size=(60, 5)), np.zeros((30, 5)), 1 + 1e-5 * rng.normal(size=(60, 5))]) * spread + offset
    d = np.round(distances(x), 9)
    want = {(i, r, j) for i in range(150) for r, j in enumerate([j for _, j in sorted((d[i, j], j) for j in range(150) if j != i)][:4], 1)}
    assert {(r.i, r["rank"], r.j) for r in neighbours.knn(frame(spark, x), 4, tile=40).collect()} == want


def test_links_and_chains_near_the_threshold(spark):
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=(100, 3)), np.arange(20)[:, None] * [1e-9, 0, 0] + [9, 9, 9], np.array([[20, 20, 20], [20.5, 20, 20]])])
    for t in (1e-9, 5e-9, 0.5, 0.7):
        d = distances(x)
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] < t}
        assert {(r.a, r.b) for r in neighbours.near_links(frame(spark, x), t, tile=30).collect()} == want


@pytest.mark.parametrize("tile", [16384, 25])
def test_chains_give_the_components_of_all_links(spark, tile):
    x = np.random.default_rng(22).normal(size=(120, 3))
    df = frame(spark, x)
    held, links = neighbours.chains(df, [0.6, 0.3, 0.45], tile), neighbours.near_links(df, 0.6)
    for t in (0.3, 0.45, 0.6):
        assert sorted(families.clusters(df, held, t).collect()) == sorted(families.clusters(df, links, t).collect())
    assert held.count() < links.count()


def test_chains_of_copies_grow_with_the_rows(spark):
    df = frame(spark, np.ones((500, 4)))
    held = neighbours.chains(df, [0.1])
    assert held.count() == 499 and components.connected_components(held).agg(F.max("component").alias("m")).first().m == 0


def test_a_pass_of_the_descent_returns_only_pairs_that_a_list_can_use(spark):
    x = np.random.default_rng(23).normal(size=(200, 6))
    df = frame(spark, x)
    graph = neighbours.knn(df.withColumn("b", F.col("id") % 5), 6, block="b").select("i", "j", "d", F.lit(1).alias("new"))
    far = {r.i: r.far for r in graph.groupBy("i").agg(F.max("d").alias("far")).collect()}
    d = np.round(distances(x), 9)
    around = {i: {i} for i in range(200)}
    for r in graph.collect():
        around[r.i].add(r.j)
        around[r.j].add(r.i)
    want = {(a, b) for m in around.values() for a in m for b in m if a < b and d[a, b] <= max(far[a], far[b])}
    # two of a row's neighbours, or a row and its neighbour; a pair needs a new edge, and all are new
    assert {(r.i, r.j) for r in neighbours._meet(graph, graph, df, 6).collect()} == want
