"""How much is done for neighbour lists, links and layouts, and that results stay what they were."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import neighbours, sequence, taste


def frame(spark, x, **more):
    rows = [(i, [float(a) for a in r], *(int(c[i]) for c in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {c} long" for c in more))


def tile(x):
    n = len(x)
    return {"id": np.arange(n), "v": x, "p": np.zeros((n, 0)), "of": np.ones(n, bool), "apart": np.full(n, -1)}


def test_f3_a_block_of_some_thousands_is_one_tile_and_lists_meet_once(spark):
    rows = frame(spark, np.zeros((5000, 1)), block=np.zeros(5000))
    assert neighbours._packed(rows, neighbours.TILE, "block")[0].agg(F.max("tiles")).first()[0] == 1
    assert "Window" not in neighbours.knn(rows, 3, block="block")._jdf.queryExecution().toString()


def test_f3_lists_of_several_blocks_and_their_recall(spark):
    rng = np.random.default_rng(40)
    x, label = rng.integers(0, 4, size=(150, 3)).astype(float), rng.integers(0, 3, 150)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    share = (label[:, None] == label[None]) | (label[:, None] % 2 == label[None] % 2)
    want = {(i, r, j) for i in range(150) for r, j in enumerate(sorted((j for j in range(150) if j != i and share[i, j]), key=lambda j: (d[i, j], j))[:6], 1)}
    df = frame(spark, x, label=label).withColumn("b", F.explode(F.array("label", F.col("label") % 2 - 5)))
    found, exact = neighbours.knn(df, 6, block="b"), neighbours.knn(frame(spark, x), 6)
    assert {(r.i, r["rank"], r.j) for r in found.collect()} == want
    both = {(r.i, r.j) for r in exact.collect()} & {(i, j) for i, _, j in want}
    assert neighbours.recall(found.unionByName(found), exact).first().recall == len(both) / 900
    assert neighbours.recall(found, exact.where("false")).first().recall is None


@pytest.mark.parametrize("size", [25, 4096])
def test_f11_f14_lists_know_their_last_distance(spark, size):
    x = np.random.default_rng(41).normal(size=(90, 4))
    near = neighbours.knn(frame(spark, x), 5, tile=size, far=True).withColumn("rating", (F.col("j") % 4).cast("double"))
    assert all(r.far == r.d for r in near.where("rank = 5").collect())
    estimate = taste.kernel_estimate(near, 5)
    assert estimate._jdf.queryExecution().toString().count("Join") == 0
    want = {r.i: r.estimate for r in taste.kernel_estimate(near.drop("far"), 5).collect()}
    got = {r.i: r.estimate for r in estimate.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_f16_few_distances_are_added_up_and_all_lists_are_right(monkeypatch):
    x, k, seen = np.random.default_rng(42).normal(size=(6000, 8)), 12, []
    quick = neighbours._quick
    monkeypatch.setattr(neighbours, "_quick", lambda x, y, i, j: seen.append(len(i)) or quick(x, y, i, j))
    t = tile(x)
    best = neighbours._nearest(t, t, k, 9, False)
    assert k * 6000 <= sum(seen) < 1.2 * k * 6000
    for i in range(0, 6000, 500):
        d = np.round(neighbours._exact(x, x, np.full(6000, i), np.arange(6000)), 9)
        d[i] = np.inf
        assert best.j[best.i == i].tolist() == np.lexsort((np.arange(6000), d))[:k].tolist()


def test_f16_rounding_does_not_hang_on_the_order_of_adding():
    rng = np.random.default_rng(43)
    x = np.round(rng.normal(size=(400, 64)), 3)
    x[200:] = x[:200]
    x[200:, 0] += (rng.integers(1, 2000, 200) * 2 + 1) / 2e9  # halves of the ninth digit
    i, j = np.arange(200), np.arange(200, 400)
    for digits in (3, 9):
        assert (neighbours._rounded(x, x, i, j, digits) == np.round(neighbours._exact(x, x, i, j), digits)).all()


def _plain_embed(start, a, b, w, epochs, negatives=5, min_dist=0.1, span=20.0):
    rng, y = np.random.default_rng(42), start.astype(float).copy()
    y = (y - y.min()) / (y.max() - y.min()) * span
    pa, pb = max(0.1, 1.929 - 3.53 * min_dist + 2.4 * min_dist**2), max(0.1, 0.7915 + 0.5 * min_dist)
    every = w.max() / w
    due = every.copy()
    for epoch in range(epochs):
        step, fire = 1 - epoch / epochs, np.flatnonzero(due <= epoch + 1)
        if not len(fire):
            continue
        due[fire] += every[fire]
        i, j = a[fire], b[fire]
        diff = y[i] - y[j]
        d2 = (diff**2).sum(1)
        pull = np.where(d2 > 0, -2 * pa * pb * np.maximum(d2, 1e-12) ** (pb - 1) / (1 + pa * d2**pb), 0)[:, None] * diff
        pull = np.clip(pull, -4, 4) * step
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        for _ in range(negatives):
            other = rng.integers(len(y), size=len(i))
            diff = y[i] - y[other]
            d2 = (diff**2).sum(1)
            push = (2 * pb / ((0.001 + d2) * (1 + pa * d2**pb)))[:, None] * diff
            push[other == i] = 0
            np.add.at(y, i, np.clip(push, -4, 4) * step)
    return y


def test_f9_layout_is_the_plain_way_s_and_quicker():
    rng = np.random.default_rng(44)
    n, m = 20_000, 200_000
    start, a, w = rng.normal(size=(n, 2)), rng.integers(0, n - 1, m), 0.05 + 0.9 * rng.random(m)
    start[5] = start[6]
    b = np.minimum(a + 1 + rng.integers(0, 50, m), n - 1)
    times = []
    for way in (_plain_embed, sequence.embed):
        began = time.process_time()
        times.append((way(start, a, b, w, epochs=8), time.process_time() - began))
    assert np.array_equal(times[0][0], times[1][0])
    assert times[1][1] < times[0][1] / 1.5


def test_f25_links_are_rounded_as_spark_does(spark):
    rng = np.random.default_rng(45)
    x = np.concatenate([rng.normal(size=(80, 3)), [[50.0, 0, 0], [50 + 1 / 2**7, 0, 0], [50 + 3 / 2**7, 0, 0], [50 + 1.2, 0, 0]]])
    df = frame(spark, x)
    for digits, most in ((6, 1.2), (2, 1.2), (6, 1 / 2**7)):
        want = neighbours.near_links(df, most, tile=30).select("a", "b", F.round("d", digits).alias("d")).collect()
        assert sorted(neighbours.near_links(df, most, tile=30, digits=digits).collect()) == sorted(want)


def test_f25_links_leave_a_task_in_large_pieces(spark, monkeypatch):
    got = []
    monkeypatch.setattr(neighbours, "_on_pairs", lambda rows, tile, block, compare, schema: got.append(compare) or rows)
    neighbours.near_links(frame(spark, np.zeros((1, 2))), 1.0, digits=6)
    t = tile(np.random.default_rng(46).normal(size=(2000, 2)))
    pieces = list(got[0](0, 0, 0, t, t))
    d = np.sqrt(((t["v"][:, None] - t["v"][None]) ** 2).sum(2))
    assert sum(map(len, pieces)) == (np.triu(d < 1.0, 1)).sum() and len(pieces) <= sum(map(len, pieces)) // neighbours.LINKS + 1


def test_f28_whole_distances_only_where_the_second_term_leaves_room(spark, monkeypatch):
    got, seen = [], []
    monkeypatch.setattr(neighbours, "_on_pairs", lambda rows, tile, block, compare, schema: got.append(compare) or rows)
    neighbours.near_links(frame(spark, np.zeros((1, 2))).withColumn("p", F.slice("v", 1, 2)), 0.72, weights=(0.6, 0.4), params="p", ranges=[0.5, 0.7], digits=6)
    x = np.random.default_rng(47).uniform(size=(900, 4))
    t = tile(x) | {"p": x[:, :2]}
    quick = neighbours._quick
    monkeypatch.setattr(neighbours, "_quick", lambda x, y, i, j: seen.append(len(i)) or quick(x, y, i, j))
    links = {(r.a, r.b): r.d for f in got[0](0, 0, 0, t, t) for r in f.itertuples()}
    d0 = 0.6 * np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d = d0 + 0.4 * (np.abs(x[:, None, :2] - x[None, :, :2]) / np.array([0.5, 0.7])).mean(2)
    want = {(i, j): round(d[i, j], 6) for i in range(900) for j in range(i + 1, 900) if d[i, j] < 0.72}
    assert links.keys() == want.keys() and all(abs(links[p] - want[p]) < 1e-9 for p in want)
    assert len(want) <= sum(seen) < 1.01 * len(want) + 100 < (np.triu(d0 < 0.72, 1)).sum()
