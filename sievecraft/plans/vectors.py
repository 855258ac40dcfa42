"""Queries: standardizing, moments, distances, neighbours, near-duplicate families, layout of plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import components, families, layout, neighbours, search, vectors
from .registry import Registry, read

registry = Registry()
query = registry.query
DIM = 64


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), expr.doubles("embedding").alias("v"), "label")


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_U = f"{_E}, u AS (SELECT id, label, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM e)"
_SCALES = f"""{_U}, m AS (SELECT pos, median(x) AS median, stddev_pop(x) AS sd FROM u GROUP BY pos),
    a AS (SELECT pos, 1.4826 * median(abs(x - median)) AS mad FROM u JOIN m USING (pos) GROUP BY pos),
    s AS (SELECT pos, median, CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd ELSE 1.0 END AS scale FROM m JOIN a USING (pos))"""


@query(f"WITH {_SCALES} SELECT CAST(pos AS INTEGER) AS pos, round(median, 9) AS median, round(scale, 9) AS scale FROM s")
def standardize_median_mad(spark: SparkSession, sf: str) -> DataFrame:
    s = vectors.robust_scales(_rows(spark, sf))
    return s.select("pos", F.round("median", 9).alias("median"), F.round("scale", 9).alias("scale"))




@query("""WITH u AS (SELECT unnest(range(0, 4)) AS pos, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem),
    m AS (SELECT pos, median(x) AS median, stddev_pop(x) AS sd FROM u GROUP BY pos),
    a AS (SELECT pos, 1.4826 * median(abs(x - median)) AS mad FROM u JOIN m USING (pos) GROUP BY pos)
    SELECT CAST(pos AS INTEGER) AS pos, round(median, 6) AS median, round(CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd ELSE 1.0 END, 6) AS scale FROM m JOIN a USING (pos)""")
def standardize_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem").select(expr.feature_vector([F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("v"))
    return vectors.robust_scales(line).select("pos", F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"))


@query(f"""WITH {_SCALES}, z AS (SELECT id, least(greatest((x - median) / scale, -5.0), 5.0) * CASE WHEN pos < 33 THEN 1.0 ELSE 0.6 END AS z FROM u JOIN s USING (pos))
    SELECT id, round(sum(z), 6) AS total, round(min(z), 6) AS least, round(max(z), 6) AS most FROM z GROUP BY id""")
def vector_clip_weight(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    st = vectors.Standardizer.fit(rows, weight=[1.0] * 33 + [0.6] * (DIM - 33))
    z = rows.select("id", st.apply(F.col("v")).alias("z"))
    return z.select("id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_min("z"), 6).alias("least"), F.round(F.array_max("z"), 6).alias("most"))


@query(f"WITH {_U} SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM u a JOIN u b ON a.id = b.id AND a.pos <= b.pos GROUP BY 1, 2")
def covariance_population(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.covariance(_rows(spark, sf), DIM).select("i", "j", F.round("cov", 9).alias("cov"))


@query(f"""WITH {_U}, c AS (SELECT a.pos AS i, covar_pop(a.x, b.x) AS c, stddev_pop(a.x) AS sa, stddev_pop(b.x) AS sb FROM u a JOIN u b ON a.id = b.id GROUP BY a.pos, b.pos)
    SELECT CAST(i AS INTEGER) AS pos, round(1 / (sqrt(greatest(1, sum(CASE WHEN sa * sb > 1e-9 THEN (c / (sa * sb)) * (c / (sa * sb)) ELSE 0 END))) * greatest(max(sa), 1e-6)), 6) AS weight FROM c GROUP BY i""")
def redundancy_weights(spark: SparkSession, sf: str) -> DataFrame:
    _, cov, _ = vectors.mean_and_covariance(vectors.collect_moments(_rows(spark, sf), DIM)[0])
    w = vectors.redundancy_weights(cov)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "pos int, weight double").select("pos", F.round("weight", 6).alias("weight"))


@query()
def whiten(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return vectors.whitener(vectors.collect_moments(rows, DIM)[0]).apply(rows, into="w").select("id", "w")


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    p = vectors.pca(vectors.collect_moments(rows, DIM)[0])
    return p.apply(rows).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query()
def lda_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    p = vectors.lda(vectors.collect_moments(rows, DIM, group="label"))
    return p.apply(rows).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"WITH {_U} SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 9) AS mean FROM u GROUP BY 1, 2")
def class_means(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.class_means(_rows(spark, sf), "label").select("label", "pos", F.round("mean", 9).alias("mean"))


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_MEANS = "m AS (SELECT label AS c, list(mx ORDER BY pos) AS mv FROM (SELECT label, pos, avg(x) AS mx FROM u GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {_U}, {_MEANS}, r AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY round({_D2.format(a='v', b='mv')}, 9), c) AS rn FROM e, m)
    SELECT id, CAST(rn AS INTEGER) AS rank, c AS block FROM r WHERE rn <= 2""")
def nearest_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    means: dict[int, list[float]] = {}
    for r in vectors.class_means(rows, "label").orderBy("label", "pos").collect():  # labels times dimensions
        means.setdefault(r.label, []).append(r.mean)
    near = neighbours.nearest_centroids(F.col("v"), sorted(means.items()), 2)
    return rows.select("id", F.posexplode(near).alias("at", "block")).select("id", (F.col("at") + 1).alias("rank"), "block")


@query(f"""WITH {_E} SELECT a.id AS a, b.id AS b, round(sqrt({_D2.format(a='a.v', b='b.v')}), 6) AS d FROM e a JOIN e b ON a.label = b.label AND a.id < b.id WHERE sqrt({_D2.format(a='a.v', b='b.v')}) < 1.25""")
def blocked_pairs_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("blocks", F.array("label", F.lit(-1) - F.col("label")))  # every row in two blocks: pairs are found twice
    return neighbours.near_links(rows, 1.25, blocks="blocks").select("a", "b", F.round("d", 6).alias("d"))


@query(f"""WITH {_E}, p AS (SELECT a.id AS a, b.id AS b, 0.6 * sqrt({_D2.format(a='a.v', b='b.v')}) AS d0,
        0.4 * (list_sum(list_transform(range(1, 17), lambda k: abs(a.v[k] - b.v[k]) / (0.5 + k / 16.0))) / 16.0) AS d1 FROM e a JOIN e b ON a.id < b.id)
    SELECT a, b, round(d0 + d1, 6) AS d FROM p WHERE d0 < 0.72 AND d0 + d1 < 0.72""")
def neardup_two_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("p", F.slice("v", 1, 16))
    links = neighbours.near_links(rows, 0.72, weights=(0.6, 0.4), params="p", ranges=[0.5 + k / 16.0 for k in range(1, 17)], digits=6)
    return links.select("a", "b", "d")


@query(f"WITH {_E} SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]) / 2.0)) / 64.0, 6) AS p, round(len(list_filter(list_zip(a.v, b.v), lambda p: p[1] <> p[2])) / 64.0, 6) AS f FROM e a JOIN e b ON b.id = a.id + 1")
def param_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    other = rows.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = rows.select(F.col("id").alias("a"), F.col("v").alias("va")).join(other, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(expr.normalised_l1(F.col("va"), F.col("vb"), [2.0] * DIM), 6).alias("p"), F.round(expr.diff_fraction(F.col("va"), F.col("vb")), 6).alias("f"))


_KNN = f"""WITH {_E}, d AS (SELECT a.id AS i, b.id AS j, round(sqrt({_D2.format(a='a.v', b='b.v')}), 9) AS d FROM e a JOIN e b ON a.id <> b.id),
    k AS (SELECT i, j, d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank FROM d)"""


@query(f"{_KNN} SELECT i, j, d, rank FROM k WHERE rank <= 12")
def knn_exact_12(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.knn(_rows(spark, sf), 12)


@query(f"""{_KNN}, f AS (SELECT i, j FROM (SELECT a.i, a.j, row_number() OVER (PARTITION BY a.i ORDER BY a.d, a.j) AS r FROM d a JOIN e x ON a.i = x.id JOIN e y ON a.j = y.id WHERE x.label = y.label) WHERE r <= 12)
    SELECT round(count(f.i) / count(*), 9) AS recall FROM (SELECT * FROM k WHERE rank <= 12) t LEFT JOIN f ON t.i = f.i AND t.j = f.j""")
def knn_recall_blocked(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return neighbours.recall(neighbours.knn(rows, 12, block="label"), neighbours.knn(rows, 12)).select(F.round("recall", 9).alias("recall"))


@query()
def knn_descent_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return neighbours.recall(neighbours.descent_knn(rows, 12), neighbours.knn(rows, 12))


@query(f"{_KNN} SELECT round(count(*) FILTER (x.label = y.label) / count(*), 9) AS purity FROM k JOIN e x ON i = x.id JOIN e y ON j = y.id WHERE rank <= 12")
def knn_purity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return neighbours.purity(neighbours.knn(rows, 12), rows.select("id", "label")).select(F.round("purity", 9).alias("purity"))


@query(f"""{_KNN}, w AS (SELECT i, j, 1.0 / (1.0 + d) AS w FROM k WHERE rank <= 12),
    p AS (SELECT least(i, j) AS a, greatest(i, j) AS b, list(w) AS ws FROM w GROUP BY 1, 2)
    SELECT a, b, round(CASE WHEN len(ws) > 1 THEN ws[1] + ws[2] - ws[1] * ws[2] ELSE ws[1] END, 6) AS w FROM p""")
def fuzzy_edge_union(spark: SparkSession, sf: str) -> DataFrame:
    directed = neighbours.knn(_rows(spark, sf), 12).select("i", "j", (1.0 / (1.0 + F.col("d"))).alias("w"))
    return neighbours.fuzzy_union(directed).select("a", "b", F.round("w", 6).alias("w"))


@query()
def fuzzy_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.memberships(neighbours.knn(_rows(spark, sf), 12))


# --- families -------------------------------------------------------------------------------

MERGE, FAMILY = 1.10, 1.15
_LINKS = f"WITH RECURSIVE {_E}, l AS (SELECT a.id AS a, b.id AS b, sqrt({_D2.format(a='a.v', b='b.v')}) AS d FROM e a JOIN e b ON a.id < b.id WHERE sqrt({_D2.format(a='a.v', b='b.v')}) < 1.2)"


def _walk(name: str, threshold: str) -> str:
    return f""", {name}_s AS (SELECT a, b FROM l WHERE d < {threshold} UNION ALL SELECT b, a FROM l WHERE d < {threshold}),
    {name}_w AS (SELECT id, id AS r FROM e UNION SELECT s.b, w.r FROM {name}_w w JOIN {name}_s s ON w.id = s.a),
    {name} AS (SELECT id, min(r) AS cluster FROM {name}_w GROUP BY id)"""


def _chains(spark: SparkSession, sf: str, *thresholds: float) -> DataFrame:
    """What joins rows at the thresholds; the links themselves grow with the square of the table."""
    return neighbours.chains(_rows(spark, sf), list(thresholds))


@query(f"{_LINKS} SELECT a, b, round(d, 6) AS d FROM l WHERE d < {FAMILY}")
def neardup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_links(_rows(spark, sf), FAMILY, digits=6).select("a", "b", "d")


@query(f"{_LINKS}{_walk('c', str(MERGE))} SELECT id, cluster FROM c")
def neardup_components_merge(spark: SparkSession, sf: str) -> DataFrame:
    return families.clusters(_rows(spark, sf), _chains(spark, sf, MERGE), MERGE)


@query(f"{_LINKS}{_walk('c', str(FAMILY))} SELECT id, cluster FROM c")
def neardup_components_family(spark: SparkSession, sf: str) -> DataFrame:
    return families.clusters(_rows(spark, sf), _chains(spark, sf, FAMILY), FAMILY)


@query(f"{_LINKS}{_walk('m', str(MERGE))}{_walk('f', str(FAMILY))} SELECT id, m.cluster AS merged, f.cluster AS family FROM m JOIN f USING (id)")
def two_level_families(spark: SparkSession, sf: str) -> DataFrame:
    return families.two_levels(_rows(spark, sf), _chains(spark, sf, MERGE, FAMILY), FAMILY, MERGE)


@query(f"""{_LINKS}{_walk('c', str(FAMILY))}, n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1)
    SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, CAST(sum(n - 1) AS BIGINT) AS collapsed FROM n""")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return families.sizes(families.clusters(_rows(spark, sf), _chains(spark, sf, FAMILY), FAMILY))


_SWEEP = (1.0, 1.05, 1.1, 1.15)


@query(f"""{_LINKS}, t AS (SELECT unnest([{', '.join(map(str, _SWEEP))}]::DOUBLE[]) AS threshold),
    s AS (SELECT threshold, a, b FROM l, t WHERE d < threshold UNION ALL SELECT threshold, b, a FROM l, t WHERE d < threshold),
    w AS (SELECT threshold, id, id AS r FROM e, t UNION SELECT w.threshold, s.b, w.r FROM w JOIN s ON w.id = s.a AND w.threshold = s.threshold),
    c AS (SELECT threshold, id, min(r) AS cluster FROM w GROUP BY 1, 2), n AS (SELECT threshold, cluster, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT threshold, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, {', '.join(
        f"CAST(coalesce(sum(n) FILTER (n >= {a}{'' if b is None else f' AND n < {b}'}), 0) AS BIGINT) AS in_{a}" for a, b in zip(families.SIZE_CLASSES, [*families.SIZE_CLASSES[1:], None]))} FROM n GROUP BY 1""")
def neardup_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return families.sweep(_rows(spark, sf), _chains(spark, sf, *_SWEEP), list(_SWEEP))


_REPS = """, x AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM e), mean AS (SELECT cluster, pos, avg(x) AS m FROM x JOIN {c} USING (id) GROUP BY 1, 2),
    off AS (SELECT cluster, id, round(sum((x - m) * (x - m)), 9) AS d2 FROM x JOIN {c} USING (id) JOIN mean USING (cluster, pos) GROUP BY 1, 2),
    reps AS (SELECT cluster, arg_min(id, (d2, id)) AS rep, count(*) AS members FROM off GROUP BY 1)"""


@query(f"{_LINKS}{_walk('c', str(FAMILY))}{_REPS.format(c='c')} SELECT cluster, rep, members FROM reps")
def cluster_medoids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return families.representatives(families.clusters(rows, _chains(spark, sf, FAMILY), FAMILY), rows)


@query(f"{_LINKS}{_walk('m', str(MERGE))}{_walk('f', str(FAMILY))}{_REPS.format(c='m')} SELECT DISTINCT f.cluster AS family, rep AS id FROM m JOIN f USING (id) JOIN reps ON reps.cluster = m.cluster")
def family_contenders(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    levels = families.two_levels(rows, _chains(spark, sf, MERGE, FAMILY), FAMILY, MERGE)
    reps = families.representatives(levels.select("id", F.col("merged").alias("cluster")), rows)
    return families.contenders(levels, reps)


@query(f"{_LINKS}{_walk('c', str(FAMILY))} SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS in_cluster, CAST(sum(1 + id % 4) OVER (PARTITION BY cluster) AS BIGINT) AS copies FROM c")
def copies_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return families.copies(families.clusters(rows, _chains(spark, sf, FAMILY), FAMILY), rows.select("id", (1 + F.col("id") % 4).alias("n")))


@query(f"{_LINKS}{_walk('f', str(FAMILY))} SELECT id, cluster AS family, bool_or(label = 3) OVER (PARTITION BY cluster) AS has_rating FROM f JOIN e USING (id)")
def family_has_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    levels = families.two_levels(rows, _chains(spark, sf, MERGE, FAMILY), FAMILY, MERGE)
    return families.family_has_rating(levels, rows.select("id", F.when(F.col("label") == 3, 5).alias("rating")))


# --- plots ----------------------------------------------------------------------------------

_BOUNDS = """b AS (SELECT s[1 + CAST(floor(0.005 * n) AS BIGINT)] AS lo, s[1 + least(n - 1, CAST(ceil(0.995 * n) AS BIGINT))] AS hi
    FROM (SELECT list_sort(list({c})) AS s, count({c}) AS n FROM {t}))"""


@query(f"WITH {_BOUNDS.format(c='l_extendedprice', t='lineitem')} SELECT CASE WHEN hi <= lo THEN lo - 1 ELSE lo END AS lo, CASE WHEN hi <= lo THEN lo + 1 ELSE hi END AS hi FROM b")
def robust_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return layout.order_statistics(read(spark, sf, "lineitem"), "l_extendedprice")


_XY = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py FROM embeddings)"


@query(f"""WITH {_XY}, {_BOUNDS.format(c='px', t='p')}, {_BOUNDS.format(c='py', t='p').replace('b AS', 'c AS', 1)}
    SELECT id, round((px - b.lo) / (b.hi - b.lo), 9) AS x, round(1 - (py - c.lo) / (c.hi - c.lo), 9) AS y FROM p, b, c""")
def plot_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    p = _rows(spark, sf).select("id", F.col("v")[0].alias("px"), F.col("v")[1].alias("py"))
    p = layout.normalise(p, "px", layout.order_statistics(p, "px"), "x")
    return layout.normalise(p, "py", layout.order_statistics(p, "py"), "y", flip=True).drop("px", "py")


@query(f"""WITH {_BOUNDS.format(c='p_retailprice', t='part')} SELECT p_partkey, floor(sqrt(4.0 + least(greatest((p_retailprice - lo) / (hi - lo), 0.0), 1.0) * 140.0) * 4 + 0.5) / 4.0 AS radius FROM part, b""")
def size_quantise(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    bounds = layout.order_statistics(part, "p_retailprice")
    held = part.withColumn("b", bounds.select(F.struct("lo", "hi")).scalar())
    return held.select("p_partkey", layout.radius(F.col("p_retailprice"), F.col("b.lo"), F.col("b.hi")).alias("radius"))


@query("SELECT count(*) AS rows, count(DISTINCT l_quantity) AS levels, bool_and(l_quantity = floor(l_quantity)) AND count(DISTINCT l_quantity) <= 64 AND count(*) >= 4 * count(DISTINCT l_quantity) AS is_lattice FROM lineitem")
def lattice_levels(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lattice(read(spark, sf, "lineitem"), "l_quantity")


GRID = (8, 6)
# each part stands on the plot where its price and size put it, with its name's words
_POINTS = f"""pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 51.0 AS x, CAST(p_partkey % 97 AS DOUBLE) / 97.0 AS y, p_name FROM part),
    g AS (SELECT id, x, y, least(greatest(floor(y * 6), 0), 5) * 8 + least(greatest(floor(x * 8), 0), 7) AS cell,
        list_distinct(list_filter(string_split_regex(upper(p_name), '[^A-Z]+'), lambda w: length(w) BETWEEN 3 AND 12)) AS tokens FROM pts),
    df AS (SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM g) GROUP BY 1), total AS (SELECT count(*) AS corpus FROM g),
    n AS (SELECT cell, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 30),
    h AS (SELECT cell, token, count(*) AS hits FROM (SELECT cell, unnest(tokens) AS token FROM g) GROUP BY 1, 2),
    w AS (SELECT cell, token, n, hits, hits / (df / CAST(corpus AS DOUBLE) * n) AS lift FROM h JOIN n USING (cell) JOIN df USING (token), total)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    p = part.select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / 51.0).alias("x"), ((F.col("p_partkey") % 97).cast("double") / 97.0).alias("y"), search.name_tokens(F.col("p_name"), []).alias("tokens"))
    return p.withColumn("cell", layout.grid_cell(F.col("x"), F.col("y"), *GRID))


@query(f"WITH {_POINTS} SELECT CAST(cell AS INTEGER) AS cell, token, hits FROM h")
def grid_cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("cell", F.explode("tokens").alias("token")).groupBy("cell", "token").agg(F.count(F.lit(1)).alias("hits"))


def _best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    points = _points(spark, sf)
    df, corpus = layout.document_frequency(points), points.count()
    return points, layout.best_words(layout.cell_words(points, df, corpus, least_share=0.03, least_lift=1.05)), df, corpus


_BEST = """, best AS (SELECT cell, token, n, hits, lift FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(hits * ln(lift), 9) DESC, token) AS rn
    FROM w WHERE hits >= 5 AND hits >= 0.03 * n AND lift >= 1.05) WHERE rn = 1)"""


@query(f"WITH {_POINTS}{_BEST} SELECT CAST(cell AS INTEGER) AS cell, token, n, hits, round(lift, 9) AS lift FROM best")
def cell_best_word(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf)[1].select("cell", "token", "n", "hits", F.round("lift", 9).alias("lift"))


@query(f"""WITH RECURSIVE {_POINTS}{_BEST}, s AS (SELECT a.cell AS a, b.cell AS b FROM best a JOIN best b ON a.token = b.token
        AND (abs(a.cell - b.cell) = 8 OR (abs(a.cell - b.cell) = 1 AND floor(a.cell / 8) = floor(b.cell / 8)))),
    walk AS (SELECT cell AS id, cell AS r FROM best UNION SELECT s.b, walk.r FROM walk JOIN s ON walk.id = s.a),
    reg AS (SELECT id AS cell, min(r) AS region FROM walk GROUP BY 1),
    roll AS (SELECT region, token, avg(x) AS x, avg(y) AS y, count(*) AS n, CAST(sum(CASE WHEN list_contains(tokens, token) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM g JOIN reg USING (cell) JOIN best USING (cell) GROUP BY 1, 2),
    l AS (SELECT roll.*, roll.hits / (df / CAST(corpus AS DOUBLE) * roll.n) AS lift FROM roll JOIN df USING (token), total),
    z AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY round(hits * ln(greatest(1.01, lift)), 9) DESC, region) AS rank FROM l)
    SELECT CAST(region AS INTEGER) AS region, token, round(x, 9) AS x, round(y, 9) AS y, n, hits, round(lift, 9) AS lift, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 3""")
def region_labels(spark: SparkSession, sf: str) -> DataFrame:
    points, best, df, corpus = _best(spark, sf)
    r = layout.region_labels(points, best, df, corpus, components.connected_components, columns=GRID[0])
    return r.select("region", "token", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n", "hits", F.round("lift", 9).alias("lift"), "rank")


