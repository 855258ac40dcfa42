"""Vector operators, families, models, allocation, sequences: invariants and numpy references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import allocate, components, elo, families, layout, neighbours, sequence, taste, vectors


def frame(spark, x, **more):
    cols = list(more)
    return spark.createDataFrame([(i, [float(a) for a in r], *[more[c][i] for c in cols]) for i, r in enumerate(x)], ", ".join(["id long", "v array<double>", *[f"{c} {'string' if isinstance(more[c][0], str) else 'double' if isinstance(more[c][0], float) else 'int'}" for c in cols]]))


def test_medians_are_exact(spark):
    x = np.random.default_rng(0).normal(size=(501, 3)).round(1)
    x[:, 2] = 7
    got = vectors.exact_medians(vectors.unnest(frame(spark, x))).orderBy("pos").collect()
    assert [r.median for r in got] == pytest.approx(np.median(x, 0))
    even = vectors.exact_medians(vectors.unnest(frame(spark, x[:500]))).orderBy("pos").collect()
    assert [r.median for r in even] == pytest.approx(np.median(x[:500], 0))


def test_scales_fall_back(spark):
    x = np.zeros((9, 3))
    x[:, 0] = range(9)
    x[0, 1] = 5  # no median deviation, but a deviation
    s = vectors.robust_scales(frame(spark, x)).orderBy("pos").collect()
    assert [r.scale for r in s] == pytest.approx([1.4826 * 2, x[:, 1].std(), 1.0])


def test_whitening_evens_out_directions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5)) @ np.diag([3, 2, 1, 1, 0.05])
    df = frame(spark, x)
    p = vectors.whitener(vectors.collect_moments(df, 5)[0])
    y = np.array([r.p for r in p.apply(df).orderBy("id").collect()])
    values = np.linalg.eigvalsh(np.cov(y.T, bias=True))
    assert values[-3:] == pytest.approx([1, 1, 1], abs=0.2) and values[0] < 0.5 and p.capped >= 1
    assert vectors.redundancy_ratio(vectors.collect_moments(df, 5)[0]) > 2


def test_pca_and_lda(spark):
    rng = np.random.default_rng(2)
    label = np.arange(300) % 3
    x = rng.normal(size=(300, 4))
    x[:, 0] *= 5
    x[:, 1] += label * 6
    df = frame(spark, x, label=[int(c) for c in label])
    p = vectors.pca(vectors.collect_moments(df, 4)[0])
    assert abs(p.matrix[0] @ np.linalg.svd(x - x.mean(0))[2][0]) == pytest.approx(1, abs=1e-6)
    d = vectors.lda(vectors.collect_moments(df, 4, group="label"))
    y = (x - d.mean) @ d.matrix.T
    assert abs(d.matrix[0, 1]) > 5 * abs(d.matrix[0, 0]) and [y[label == c, 0].mean() for c in range(3)] in (sorted(y[label == c, 0].mean() for c in range(3)), sorted((y[label == c, 0].mean() for c in range(3)), reverse=True))
    with pytest.raises(ValueError):
        vectors.lda({0: vectors.collect_moments(df, 4)[0]})


def test_redundant_dimensions_count_less():
    cov = np.array([[1.0, 1.0, 0], [1.0, 1.0, 0], [0, 0, 1.0]])
    assert vectors.redundancy_weights(cov) == pytest.approx([1 / np.sqrt(2), 1 / np.sqrt(2), 1])


@pytest.mark.parametrize("tile", [2048, 30])
def test_knn_and_links_match_brute_force(spark, tile):
    x = np.random.default_rng(3).normal(size=(120, 4)).round(2)
    x[50] = x[51]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = [(i, j, r) for i in range(120) for r, j in enumerate([j for _, j in sorted((d[i, j], j) for j in range(120) if j != i)][:5], 1)]
    got = sorted((r.i, r.j, r["rank"]) for r in neighbours.knn(frame(spark, x), 5, tile).collect())
    assert got == sorted(want)
    links = {(r.a, r.b) for r in neighbours.near_links(frame(spark, x), 1.0, tile=tile).collect()}
    assert links == {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] < 1.0}
    blocked = frame(spark, x).withColumn("blocks", F.array(F.col("id") % 3, 10 + F.col("id") % 3))
    assert {(r.a, r.b) for r in neighbours.near_links(blocked, 1.0, blocks="blocks", tile=tile).collect()} == {(i, j) for i, j in links if i % 3 == j % 3}


def test_descent_finds_most_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) + 4 * rng.normal(size=(8, 8))[rng.integers(8, size=400)]
    df = frame(spark, x)
    assert neighbours.recall(neighbours.descent_knn(df, 8, start_block=60), neighbours.knn(df, 8)).first().recall > 0.85


def test_memberships_sum_to_log2_k(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    w = neighbours.memberships(neighbours.knn(frame(spark, x), 8)).groupBy("i").agg(F.sum("w").alias("s"), F.max("w").alias("m")).collect()
    assert all(abs(r.s - 3) < 1e-3 and r.m == 1 for r in w)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)] + [(300, 300 + k) for k in range(1, 60)] + [(5, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(300, 360), 300)}
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected_components(none).count() == 0


def test_sweep_agrees_with_clusters_at_each_threshold(spark):
    x = np.random.default_rng(6).normal(size=(80, 2))
    df = frame(spark, x)
    links = neighbours.near_links(df, 0.8)
    for r in families.sweep(df, links, [0.5, 0.3, 0.8]).collect():
        assert families.sizes(families.clusters(df, links, r.threshold)).select("clusters", "singletons", "largest").first() == (r.clusters, r.singletons, r.largest)


def test_two_levels_are_nested(spark):
    df = frame(spark, np.random.default_rng(7).normal(size=(60, 2)))
    levels = families.two_levels(df, neighbours.near_links(df, 0.6), family=0.4, merge=0.9)
    assert levels.where("merged <> family").count() == 0  # merge is brought down to family


def test_order_statistics(spark):
    x = np.random.default_rng(8).normal(size=2500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    s = np.sort(x)
    assert tuple(layout.order_statistics(df, "v").first()) == (s[int(0.005 * 2500)], s[min(2499, int(np.ceil(0.995 * 2500)))])
    assert tuple(layout.order_statistics(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").first()) == (2.0, 4.0)


def test_region_labels_on_a_planted_grid(spark):
    rows = []
    for cell in range(12):
        x, y = (cell % 4 + 0.5) / 4, (cell // 4 + 0.5) / 3
        word = "LSHAPE" if cell in (0, 4, 5) else f"W{chr(65 + cell)}"
        rows += [(len(rows) + k, x, y, [word] if k < 30 else ["OTHER"]) for k in range(40)]
    p = spark.createDataFrame(rows, "id long, x double, y double, tokens array<string>").withColumn("cell", layout.grid_cell(F.col("x"), F.col("y"), 4, 3))
    df = layout.document_frequency(p)
    best = layout.best_words(layout.cell_words(p, df, len(rows)))
    got = layout.region_labels(p, best, df, len(rows), components.connected_components, columns=4).collect()
    own = next(r for r in got if r.token == "LSHAPE")
    assert (own.region, own.n, own.hits) == (0, 120, 90) and len(got) == 10 and not any(r.token == "OTHER" for r in got)


def test_taste_follows_a_linear_preference(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 5))
    y = 3 + x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=150)
    df = frame(spark, x, category=["a"] * 150, rating=[float(v) for v in y], fold=[i % 5 for i in range(150)])
    half = df.withColumn("rating", F.when(F.col("id") < 100, F.col("rating")))
    m = taste.fit(half, 5)
    assert m.r2 > 0.8 and [n for n, _ in m.top_terms(list("abcde"), 2)] == ["a", "b"]
    p = np.array([r.predicted for r in taste.predict(half, m).orderBy("id").collect()])
    assert np.corrcoef(p[100:], y[100:])[0, 1] > 0.9
    w = m.distance_weights()
    assert w.argmax() == 0 and w.min() >= 0.3
    assert taste.fit(df.withColumn("rating", F.lit(3.0)), 5) is None and taste.fit(half.where("id < 8"), 5) is None


def test_taste_neighbours_help_with_two_peaks(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(-3, 0.5, (60, 3)), rng.normal(0, 0.5, (60, 3)), rng.normal(3, 0.5, (60, 3))])
    y = [5.0] * 60 + [1.0] * 60 + [5.0] * 60
    m = taste.fit(frame(spark, x, category=["a"] * 180, rating=y, fold=[i % 5 for i in range(180)]), 3)
    assert m.blend > 0.5 and m.r2 > 0.8


def test_elo():
    held = elo.fold([(1, 2), (2, 3), (3, 1)])
    assert sum(s for s, _ in held.values()) == pytest.approx(4500, abs=15) and all(g == 2 for _, g in held.values())
    rng = np.random.default_rng(11)
    skill = np.arange(24)
    games = [(a, b) if (skill[a] > skill[b]) == (rng.random() < 0.85) else (b, a) for a, b in (rng.choice(24, 2, replace=False) for _ in range(288))]
    held = elo.fold([(int(a), int(b)) for a, b in games])
    score = np.array([held.get(i, (1500, 0))[0] for i in range(24)])
    assert np.corrcoef(score, skill)[0, 1] > 0.6


def test_refit_points():
    rated = list(range(1, 101))
    points = elo.refit_points(rated)
    assert points[:2] == [9, 19] and points == sorted(set(points))


def test_apportion_respects_caps_floors_and_total():
    rng = np.random.default_rng(12)
    for _ in range(300):
        cats = [f"c{k}" for k in range(rng.integers(1, 7))]
        pools = {c: (int(rng.integers(0, 40)), 0, float(rng.uniform(0, 5))) for c in cats if rng.random() < 0.9}
        pools = {c: (n, int(rng.integers(0, n + 1)) if rng.random() < 0.3 else 0, w) for c, (n, _, w) in pools.items()}
        floors, ceilings = {c: int(rng.integers(0, 10)) for c in cats}, {c: int(rng.integers(5, 30)) for c in cats}
        total = int(rng.integers(1, 90))
        got = allocate.apportion(pools, cats, floors, ceilings, total)
        cap = {c: min(ceilings[c], pools.get(c, (0,))[0]) for c in cats}
        assert sum(got.values()) <= total and all(0 <= got[c] <= cap[c] for c in cats)
        need = {c: max(min(floors[c], cap[c]), min(pools.get(c, (0, 0))[1], cap[c])) for c in cats}
        if sum(need.values()) <= total:
            assert all(got[c] >= need[c] for c in cats)
        if all(pools.get(c, (0, 0, 0))[2] > 0 for c in cats):
            assert sum(got.values()) == min(total, sum(cap.values()))


def test_allocate_backfills_under_ceilings_first(spark):
    rows = [(i, "a", 5.0, False, 0.0) for i in range(4)] + [(10 + i, "b", 2.0, False, float(i)) for i in range(6)] + [(20, "b", 1.0, True, 0.0)]
    df = spark.createDataFrame(rows, "id long, category string, rating double, pinned boolean, tie_break double")
    got = allocate.allocate(df, 8, {"a": 0, "b": 0}, {"a": 3, "b": 4}, ["a", "b"])
    ids = {r.id: r.backfilled for r in got.selected.collect()}
    assert len(ids) == 8 and ids[20] is False and ids.get(3) is True and sum(i >= 10 for i in ids) == 4


def test_seriation_is_a_short_permutation(spark):
    rng = np.random.default_rng(13)
    x, c = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    path = sequence.seriate(x, c)
    y = np.hstack([x, c[:, None] * 6.0])
    start, end = path[0], path[-1]
    near = np.array(sequence.nearest_path(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), int(start), int(end)))
    assert sorted(path) == list(range(40)) and sequence.path_length(y, path) <= sequence.path_length(y, near) + 1e-9
    assert c[start] == 0 and c[end] == 2
    df = spark.createDataFrame([(int(i % 2), i, int(c[i]), [float(v) for v in x[i]]) for i in range(40)], "run int, id long, category int, v array<double>")
    assert sequence.seriate_runs(df).groupBy("run").agg(F.max("position").alias("m")).where("m <> 19").count() == 0
    with pytest.raises(Exception, match="at most 5"):
        sequence.seriate_runs(df, most=5).collect()


def test_coverage_order_starts_central_and_spreads(spark):
    x = np.random.default_rng(14).uniform(size=(200, 2))
    order = sequence.coverage(x)
    assert sorted(order) == list(range(200)) and order[0] == ((x - x.mean(0)) ** 2).sum(1).argmin() and order[1] == ((x - x[order[0]]) ** 2).sum(1).argmax()
    assert sequence.coverage_head(frame(spark, x), 4) == order[:4].tolist()


def test_layout_parts_groups_and_repeats(spark):
    rng = np.random.default_rng(15)
    label = np.arange(120) % 4
    x = rng.normal(size=(120, 10)) + 6 * rng.normal(size=(4, 10))[label]
    df = frame(spark, x)
    links = neighbours.fuzzy_union(neighbours.memberships(neighbours.knn(df, 8)))
    start = frame(spark, x).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    a, b = (sequence.layout(start, links, epochs=60).orderBy("id").collect() for _ in range(2))
    assert a == b
    y = np.array([(r.x, r.y) for r in a])
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.eye(120) * 1e9
    assert (label[d.argsort(1)[:, :5]] == label[:, None]).mean() > 0.9
