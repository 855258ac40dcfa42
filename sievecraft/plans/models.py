"""Queries: preference model, categories, pairwise judgements, allocation, blending, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, expr
from ..operators import allocate, blend, category, elo, neighbours, sequence, series, taste, vectors
from .registry import Registry, read
from .vectors import _E, _KNN, DIM, _rows

registry = Registry()
query = registry.query

# --- preference model -----------------------------------------------------------------------


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a rating that follows their label, a category, and a fold."""
    rating = 1 + (F.col("label") * 7 + F.col("id") % 3) % 5
    return _rows(spark, sf).select("id", "v", "label", rating.cast("double").alias("rating"), (F.col("id") % 5).cast("int").alias("fold"), F.concat(F.lit("c"), (F.col("label") % 4).cast("string")).alias("category"))


_R = f"{_E}, r AS (SELECT id, v, label, CAST(1 + (label * 7 + id % 3) % 5 AS DOUBLE) AS rating, CAST(id % 5 AS INTEGER) AS fold, 'c' || CAST(label % 4 AS VARCHAR) AS category FROM e)"


@query(f"""WITH {_R}, u AS (SELECT fold, rating, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM r)
    SELECT fold, CAST(pos AS INTEGER) AS pos, count(*) AS n, sum(rating) AS sy, round(sum(x), 6) AS sx, round(sum(x * rating), 6) AS sxy, round(sum(x * x), 6) AS sxx FROM u GROUP BY 1, 2""")
def fold_gram(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rated(spark, sf).select(F.concat("v", F.array("rating")).alias("v"), "fold")
    m = vectors.moments(rows, DIM + 1, group="fold").select(F.col("group").cast("int").alias("fold"), "i", "j", "s")
    pos = F.col("i") - 1
    return m.where(f"i BETWEEN 1 AND {DIM}").groupBy("fold", pos.alias("pos")).agg(F.lit(1).alias("one"), F.max(F.when(F.col("j") == 0, F.col("s"))).alias("sx"), F.max(F.when(F.col("j") == DIM + 1, F.col("s"))).alias("sxy"), F.max(F.when(F.col("j") == F.col("i"), F.col("s"))).alias("sxx")).join(
        m.where("i = 0").groupBy("fold").agg(F.max(F.when(F.col("j") == 0, F.col("s"))).cast("long").alias("n"), F.max(F.when(F.col("j") == DIM + 1, F.col("s"))).alias("sy")), "fold"
    ).select("fold", "pos", "n", "sy", F.round("sx", 6).alias("sx"), F.round("sxy", 6).alias("sxy"), F.round("sxx", 6).alias("sxx"))


@query(f"""WITH {_R}, mean AS (SELECT avg(rating) AS m FROM r)
    SELECT category, count(*) AS n, round(sum(rating - m) / count(*), 9) AS mean, round(sum(rating - m) / (count(*) + 6.0), 9) AS "offset" FROM r, mean GROUP BY 1""")
def category_offsets_shrunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rated(spark, sf)
    mean = rows.agg(F.avg("rating").alias("m"))
    out = taste.shrunken_offsets(rows.withColumn("m", mean.scalar()), "category", F.col("rating") - F.col("m"))
    return out.select("category", "n", F.round("mean", 9).alias("mean"), F.round("offset", 9).alias("offset"))


_KERNEL = f"""{_KNN}, near AS (SELECT i, d, CAST(1 + (label * 7 + j % 3) % 5 AS DOUBLE) AS rating FROM k JOIN e ON j = id WHERE rank <= 8),
    far AS (SELECT i, greatest(max(d), 1e-6) AS s FROM near GROUP BY 1),
    est AS (SELECT i, sum(exp(-(d / s) * (d / s)) * rating) / sum(exp(-(d / s) * (d / s))) AS estimate FROM near JOIN far USING (i) GROUP BY 1)"""


def _kernel(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rated(spark, sf)
    near = neighbours.knn(rows, 8, far=True).join(rows.select(F.col("id").alias("j"), "rating"), "j")
    return taste.kernel_estimate(near, 8)


@query(f"{_KERNEL} SELECT i, round(estimate, 6) AS estimate FROM est")
def kernel_knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _kernel(spark, sf).select("i", F.round("estimate", 6).alias("estimate"))


@query(f"""{_KERNEL}, y AS (SELECT id % 5 AS fold, CAST(1 + (label * 7 + id % 3) % 5 AS DOUBLE) AS y, estimate FROM est JOIN e ON i = id)
    SELECT CAST(fold AS INTEGER) AS fold, round(1 - sum((y - estimate) * (y - estimate)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM y GROUP BY 1""")
def r2_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    held = _kernel(spark, sf).join(_rated(spark, sf).select(F.col("id").alias("i"), "fold", F.col("rating").alias("y")), "i")
    return taste.r_squared(held, "y", "estimate", "fold").select("fold", F.round("r2", 6).alias("r2"))


@query()
def taste_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Model of half the rows' ratings, and its prediction for all."""
    rows = _rated(spark, sf).withColumn("rating", F.when(F.col("id") % 2 == 0, F.col("rating"))).withColumn("fold", ((F.col("id") / 2) % 5).cast("int"))
    model = taste.fit(rows, DIM)
    return taste.predict(rows, model) if model else rows.select("id", F.lit(None).cast("double").alias("predicted"))


# --- categories -----------------------------------------------------------------------------

# features of parts made from their columns, spread over the scorer's ranges; the thresholds in the SQL below are fixed values, as in operators.category
_FEATURES = {
    "attack": "-2.5e0 + (p_partkey % 23) / 10.0e0", "release": "-2.0e0 + (p_partkey % 29) / 11.0e0", "sustain": "(p_partkey % 11) / 10.0e0", "centroid": "(p_partkey % 37) / 7.0e0", "abs_bright": "-2.0e0 + (p_partkey % 31) / 8.0e0",
    "register": "-2.5e0 + (p_partkey % 41) / 9.0e0", "inharm": "(p_partkey % 13) / 16.0e0", "slope": "-2.0e0 + (p_partkey % 17) / 4.0e0", "vel_bright": "(p_partkey % 19) / 8.0e0", "vel_level": "(p_partkey % 43) / 2.0e0",
    "key_level": "-7.0e0 + (p_partkey % 47) / 4.0e0", "flatness": "(p_partkey % 53) / 120.0e0", "pitch_eg": "(p_partkey % 59) * 2.5e0", "lfo_pm": "(p_partkey % 61) * 1.6e0", "lfo_am": "(p_partkey % 67) * 1.5e0",
    "sample_hold": "CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE 0 END", "carriers": "1 + p_partkey % 6", "transpose": "p_partkey % 25 - 12",
}
# words of these parts' names in the place of the usual ones
_WORDS = {"keys": ["small"], "bells": ["ring", "bell"], "plucked": ["blue"], "bass": ["large"], "brass": ["hot"], "lead": ["gear"], "organ": ["red"], "strings": ["bolt"], "abstract": ["gizmo"]}


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _FEATURES.items()])


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest(({x} - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE, 0.0), 1.0)"


def _band(x: str, a: float, b: float, c: float, d: float) -> str:
    return f"least({_ramp(x, a, b)}, 1.0 - {_ramp(x, c, d)})"


_ATOMS = {
    "fast": f"1.0 - {_ramp('attack', -2.2, -1.2)}", "mid": _band("attack", -2.2, -1.7, -0.9, -0.4), "slow": _ramp("attack", -1.4, -0.5), "sus": "sustain", "perc": "1.0 - sustain",
    "long": _ramp("release", -1.0, 0.3), "short": f"1.0 - {_ramp('release', -1.5, -0.6)}", "very_short": f"1.0 - {_ramp('release', -2.0, -1.2)}", "bright": _ramp("centroid", 0.6, 3.5),
    "dark": f"1.0 - {_ramp('abs_bright', -1.5, 1.5)}", "low": _ramp("(-register)", 0.4, 2.0), "clang": _ramp("inharm", 0.15, 0.6), "tonal": f"1.0 - {_ramp('inharm', 0.15, 0.6)}", "darken": _ramp("(-slope)", 0.1, 1.5),
    "brighten": _ramp("slope", 0.15, 1.5), "vel_bright": _ramp("vel_bright", 0.3, 2.0), "vel_level": _ramp("vel_level", 4.0, 20.0), "noisy": _ramp("flatness", 0.02, 0.3), "low_heavy": _ramp("(-key_level)", 0.5, 6.0),
    "wild": f"greatest({_ramp('pitch_eg', 25.0, 120.0)}, {_ramp('lfo_pm', 40.0, 99.0)}, sample_hold)", "no_vel": f"1.0 - {_ramp('vel_level', 1.5, 8.0)}", "hold": _ramp("sustain", 0.75, 0.95),
    "few": f"1.0 - {_ramp('carriers', 1.0, 3.0)}", "keys_band": _band("centroid", 0.0, 0.6, 2.6, 4.5), "transposed": "CASE WHEN transpose < 0 THEN 1.0 ELSE 0.0 END",
    "clang_bright": f"{_ramp('inharm', 0.15, 0.6)} * {_ramp('centroid', 0.6, 3.5)}", "moving": _ramp("abs(slope)", 1.5, 6.0), "tremolo": _ramp("lfo_am", 40.0, 99.0), "dull": f"1.0 - {_ramp('centroid', 0.6, 3.5)}",
}
_PRIOR = {c: "CASE WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in ws) + f" THEN {category.KEYWORD_BONUS.get(c, category.USUAL_BONUS)!r}::DOUBLE ELSE 0.0 END" for c, ws in _WORDS.items()}
_SCORE = {c: " + ".join(f"{w!r}::DOUBLE * ({_ATOMS[a]})" for a, w in parts.items()) + f" + {_PRIOR[c]}" for c, parts in category.COEFFICIENTS.items()}
_CATEGORY = f"""f AS (SELECT p_partkey, p_name AS name, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _FEATURES.items())} FROM part),
    s AS (SELECT *, [{', '.join(_SCORE.values())}] AS s FROM f),
    c AS (SELECT *, [{', '.join(repr(c) for c in category.CATEGORIES)}][list_position(s, list_max(s))] AS category, list_max(s) - list_reverse_sort(s)[2] AS confidence FROM s)"""


@query(f"WITH {_CATEGORY} SELECT p_partkey, category, round(confidence, 6) AS confidence FROM c")
def categorize_rules(spark: SparkSession, sf: str) -> DataFrame:
    return category.categorize(_parts(spark, sf), "name", _WORDS).select("p_partkey", "category", F.round("confidence", 6).alias("confidence"))


_SUBWORDS = {"keys": {"piano": ["widget"], "epiano": ["small"]}, "bells": {"bell": ["ring"], "metallic": ["gear"]}, "strings": {"strings": ["blue"], "pad": ["bolt"]}, "abstract": {"fx": ["hot"], "noise": ["gizmo"]}}
_EVIDENCE = {
    "epiano": f"{_ramp('release', -1.2, -0.2)} * (1.0 - {_ramp('inharm', 0.1, 0.4)})", "metallic": _ramp("inharm", 0.35, 0.8), "pad": f"{_ramp('attack', -1.2, -0.3)} * sustain", "noise": _ramp("flatness", 0.08, 0.4),
}


def _pick(subs: dict[str, list[str]]) -> str:
    words = lambda ws: " OR ".join(f"contains(lower(name), '{w}')" for w in ws)
    values = ", ".join(f"CASE WHEN {words(ws)} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + {_EVIDENCE.get(s, '0.0::DOUBLE')}" for s, ws in subs.items())
    return f"[{', '.join(repr(s) for s in subs)}][list_position([{values}], list_max([{values}]))]"


_PICK = " ".join(f"WHEN category = '{c}' THEN {_pick(subs)}" for c, subs in _SUBWORDS.items())


@query(f"WITH {_CATEGORY} SELECT p_partkey, category, CASE {_PICK} END AS subcategory FROM c")
def subcategory_pick(spark: SparkSession, sf: str) -> DataFrame:
    c = category.categorize(_parts(spark, sf), "name", _WORDS)
    return c.select("p_partkey", "category", category.subcategory(F.col("category"), F.col("name"), _SUBWORDS).alias("subcategory"))


# --- pairwise judgements ---------------------------------------------------------------------

@query("SELECT event_id, round(1.0 / (1.0 + pow(10.0, (1500.0 - (1400.0 + value)) / 400.0)), 9) AS chance, round(48.0 / (1.0 + (user_id % 40) / 8.0), 9) AS step FROM events")
def elo_expected(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select("event_id", F.round(elo.expected(1400.0 + F.col("value"), F.lit(1500.0)), 9).alias("chance"), F.round(elo.step((F.col("user_id") % 40).cast("double")), 9).alias("step"))


@query("""SELECT event_id, round(CASE WHEN user_id % 5 = 0 THEN 3.0 ELSE 3.0 + least(greatest((1300.0 + value * 4 - 1500.0) / 400.0 * 0.45, -0.45), 0.45) END, 9) AS rating FROM events""")
def elo_offset(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    r = elo.effective_rating(F.lit(3.0), 1300.0 + F.col("value") * 4, (F.col("user_id") % 5).cast("long"))
    return e.select("event_id", F.round(r, 9).alias("rating"))


@query()
def elo_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").where("user_id <> event_id % 150")
    r = e.select((F.col("event_id") % 4).alias("band"), F.col("event_id").alias("seq"), F.col("user_id").alias("winner"), (F.col("event_id") % 150).alias("loser"))
    return elo.standings(r)


@query()
def faceoff_brackets(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    choice = F.when(F.col("event_type") == "click", "challenger").when(F.col("event_type") == "view", "both").otherwise("champion")
    return elo.brackets(e.select((F.col("user_id") % 20).alias("family"), F.col("event_id").alias("seq"), F.col("user_id").alias("champion"), F.col("event_id").alias("challenger"), choice.alias("choice")))


# --- allocation ------------------------------------------------------------------------------

def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), (F.col("p_size") / 10.0).alias("rating"), (F.col("p_partkey") % 97 == 0).alias("pinned"), (F.col("p_partkey") % 101).cast("double").alias("tie_break"))


_CAND = "cand AS (SELECT p_partkey AS id, p_type AS category, p_size / 10.0 AS rating, p_partkey % 97 = 0 AS pinned, CAST(p_partkey % 101 AS DOUBLE) AS tie_break FROM part)"
_LOOSE = "rating DESC, tie_break DESC, id"
_ORDER = f"pinned DESC, {_LOOSE}"


@query(f"WITH {_CAND} SELECT id, category, CAST(row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS INTEGER) AS rank FROM cand WHERE pinned OR floor(rating + 0.5) >= 4")
def rank_within_category(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.rank_within_category(_candidates(spark, sf)).select("id", "category", "rank")


@query(f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS rank FROM cand WHERE pinned OR floor(rating + 0.5) >= 4)
    SELECT category, count(*) AS pool, count(*) FILTER (pinned) AS pinned, round(sum(rating) FILTER (rank <= 12) / count(*) FILTER (rank <= 12), 9) AS weight FROM r GROUP BY 1""")
def topn_weight(spark: SparkSession, sf: str) -> DataFrame:
    p = allocate.pool_sizes(allocate.rank_within_category(_candidates(spark, sf)))
    return p.select("category", "pool", "pinned", F.round("weight", 9).alias("weight"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"""WITH {_CAND},
    rest AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_LOOSE}) AS nth FROM cand WHERE floor(rating + 0.5) >= 1)
    SELECT id, category, true AS backfilled FROM (SELECT *, row_number() OVER (ORDER BY CAST(nth > 18 AS INTEGER), {_LOOSE}) AS g FROM rest) WHERE g <= 128""")
def allocate_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Nobody reaches the least rating, so all places are filled from the rest: first under the ceilings, then beyond them."""
    c = _candidates(spark, sf)
    got = allocate.allocate(c.withColumn("pinned", F.lit(False)), 128, dict.fromkeys(_TYPES, 0), dict.fromkeys(_TYPES, 18), _TYPES, least_rating=99)
    order = got.selected.select("id").join(c, "id")
    return order.select("id", "category", F.lit(True).alias("backfilled"))


@query()
def allocate_quota(spark: SparkSession, sf: str) -> DataFrame:
    got = allocate.allocate(_candidates(spark, sf), 128, dict.fromkeys(_TYPES, 12), dict.fromkeys(_TYPES, 30), _TYPES)
    return got.selected.select("id", "category", "rating", "pinned", "backfilled")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 4.0)) AS INTEGER) AS bank FROM documents")
def bank_split(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.banks import number

    return allocate.bank_split(number(read(spark, sf, "documents").select("doc_id"), "doc_id")).select("doc_id", "bank")


@query(f"""WITH {_CAND}, b AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE category END AS category, rating, 0 AS p FROM cand WHERE rating >= 3
        UNION ALL SELECT id, category, CASE WHEN rating > 0 THEN rating ELSE 5 END, 1 FROM cand WHERE pinned)
    SELECT id, category, rating FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM b WHERE category IS NOT NULL) WHERE rn = 1""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    fam = c.where("rating >= 3").select("id", F.when(F.col("id") % 13 != 0, F.col("category")).alias("category"), "rating")
    return allocate.candidate_union(fam, c.where("pinned").select("id", "category", F.when(F.col("rating") > 0, F.col("rating")).otherwise(5.0).alias("rating")))


@query()
def seriate_path(spark: SparkSession, sf: str) -> DataFrame:
    """The 128 places of allocate_quota() in path order; vectors are made of the parts' numbers."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") / 10.0), (F.col("p_retailprice") / 500.0), (F.col("p_partkey") % 7).cast("double")).alias("v"))
    chosen = allocate_quota(spark, sf).join(p, "id")
    rank = F.array_position(F.array(*[F.lit(t) for t in _TYPES]), F.col("category")).cast("int")
    run = F.when(F.col("pinned"), 0).when(F.col("backfilled"), 2).otherwise(1)
    return sequence.seriate_runs(chosen.select(run.alias("run"), "id", rank.alias("category"), "v"))


@query()
def coverage_order(spark: SparkSession, sf: str) -> DataFrame:
    p = _rows(spark, sf).select(F.lit(0).alias("plot"), "id", F.slice("v", 1, 2).alias("v"))
    return sequence.coverage_order(p)


@query()
def layout_sgd(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    p = vectors.pca(vectors.collect_moments(rows, DIM)[0]).apply(rows).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return sequence.layout(p, neighbours.fuzzy_union(neighbours.memberships(neighbours.knn(rows, 12))))


# --- blending --------------------------------------------------------------------------------

_NEAR = f"{_KNN}, n AS (SELECT i AS target, j AS id, d, rank, label, v, 1.0 / (d * d + 1e-6) AS w FROM k JOIN e ON j = e.id WHERE rank <= 24)"


def _near(spark: SparkSession, sf: str, k: int, *columns: Column | str) -> DataFrame:
    """Each row's k nearest with columns of theirs; no others travel."""
    rows = _rows(spark, sf)
    held = rows.select(F.col("id").alias("j"), *columns)
    near = neighbours.knn(rows, k).join(held, "j")
    return near.select(F.col("i").alias("target"), F.col("j").alias("id"), "d", "rank", *held.columns[1:], blend.inverse_square(F.col("d")).alias("w"))


@query(f"""{_NEAR}, t AS (SELECT target, label, round(sum(w), 9) AS total FROM n GROUP BY 1, 2)
    SELECT target, label, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY total DESC, label) AS rn FROM t) WHERE rn = 1""")
def weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    return blend.weighted_vote(_near(spark, sf, 24, "label"), "target", "label").select("target", "label", F.round("total", 6).alias("total"))


@query(f"""{_NEAR}, u AS (SELECT target, w, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM n WHERE rank <= 8)
    SELECT target, CAST(pos AS INTEGER) AS pos, round(sum(x * w) / sum(w), 6) + 0.0 AS value FROM u GROUP BY 1, 2""")
def weighted_mean_params(spark: SparkSession, sf: str) -> DataFrame:
    return blend.weighted_means(_near(spark, sf, 8, "v"), "target", digits=6).withColumn("value", F.col("value") + 0.0)


@query(f"""{_NEAR}, q AS (SELECT target, CAST(floor(v[1] * 10) AS INTEGER) AS a, CAST(floor(v[2] * 10) AS INTEGER) AS b, w FROM n WHERE rank <= 8),
    t AS (SELECT target, a, b, round(sum(w), 9) AS total FROM q GROUP BY 1, 2, 3)
    SELECT target, a, b, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY total DESC, a, b) AS rn FROM t) WHERE rn = 1""")
def donor_vote(spark: SparkSession, sf: str) -> DataFrame:
    q = _near(spark, sf, 8, *[F.floor(F.col("v")[k] * 10).cast("int").alias(c) for k, c in enumerate("ab")])
    return blend.donors(q, "target", ["a", "b"]).select("target", "a", "b", F.round("total", 6).alias("total"))


@query()
def interpolate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    params = _rows(spark, sf).select("id", F.transform("v", lambda x: F.floor((x + 1) * 50).cast("double")).alias("v"))
    return blend.interpolate(_near(spark, sf, 24, "label"), "label", vectors=params, rows=_rows(spark, sf))


_TIME = "yyyy-MM-dd HH:mm:ss"

# --- series ----------------------------------------------------------------------------------

@query("""SELECT event_id, round(avg(value) OVER w, 6) AS trend, round(value - avg(value) OVER w, 6) AS residual FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_average_detrend(spark: SparkSession, sf: str) -> DataFrame:
    d = series.detrend(read(spark, sf, "events"), "user_id", "event_id", "value", 3)
    return d.select("event_id", F.round("trend", 6).alias("trend"), F.round("residual", 6).alias("residual"))


@query("""WITH t AS (SELECT user_id, value, value - avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS r FROM events)
    SELECT user_id, round(sqrt(avg(r * r)) / avg(value), 6) AS wobble FROM t GROUP BY 1""")
def residual_wobble(spark: SparkSession, sf: str) -> DataFrame:
    return series.wobble(read(spark, sf, "events"), "user_id", "event_id", "value", 3).select("user_id", F.round("wobble", 6).alias("wobble"))


@query("SELECT user_id, round(coalesce(regr_slope(value, CAST(event_id AS DOUBLE)), 0.0), 9) AS slope FROM events GROUP BY 1")
def regr_slope(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("x", F.col("event_id").cast("double"))
    return series.slopes(e, "user_id", "x", "value").select("user_id", F.round("slope", 9).alias("slope"))


@query("""SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a, max(value) OVER (PARTITION BY user_id) AS p FROM events)
    WHERE (a IS NULL OR a <= value) AND value >= 0.5 * p""")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return series.local_maxima(read(spark, sf, "events"), "user_id", "event_id", "value", 4, 0.5).select("event_id")


@query("""WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, CAST(sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS runs, CAST(sum(CASE WHEN event_type < b THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM t GROUP BY 1""")
def runs_inversions(spark: SparkSession, sf: str) -> DataFrame:
    return series.runs(read(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = series.tumbling(read(spark, sf, "events"), "1 hour", "ts", "event_type")
    return t.select(F.date_format("start", _TIME).alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH e AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS s FROM events), w AS (SELECT s AS start FROM e UNION ALL SELECT s - 1800 FROM e)
    SELECT strftime(make_timestamp(start * 1000000), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w GROUP BY 1""")
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return series.sliding(read(spark, sf, "events"), "1 hour", "30 minutes").select(F.date_format("start", _TIME).alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS stop, count(*) AS n FROM s GROUP BY user_id, nth""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = series.sessions(read(spark, sf, "events"), "2 hours", "user_id")
    return s.select("user_id", F.date_format("start", f"{_TIME}.SSSSSS").alias("start"), F.date_format("end", f"{_TIME}.SSSSSS").alias("stop"), "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, '[' || string_agg('{\"id\":' || CAST(event_id AS VARCHAR) || ',\"kind\":\"' || event_type || '\"}', ',' ORDER BY event_id) || ']' AS backup FROM events GROUP BY 1")
def backup_json(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))).alias("b"))
    return e.select("user_id", F.to_json("b").alias("backup"))


@query("""WITH q AS (SELECT event_id, CAST(event_id % 128 AS INTEGER) AS low, CAST((event_id // 128) % 128 AS INTEGER) AS high FROM events), v AS (SELECT event_id, high * 128 + low - 8192 AS v FROM q)
    SELECT event_id, round(CASE WHEN v < 0 THEN v / 8192.0 ELSE v / 8191.0 END, 9) AS bend FROM v""")
def bend_decode(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", (F.col("event_id") % 128).cast("int").alias("low"), (F.floor(F.col("event_id") / 128) % 128).cast("int").alias("high"))
    return e.select("event_id", F.round(codecs.pitch_bend(F.col("low"), F.col("high")), 9).alias("bend"))


@query("""SELECT p_partkey, CAST((-(p_size + p_partkey % 128 + 7)) & 127 AS INTEGER) AS checksum, round(440.0 * pow(2.0, (p_size - 69) / 12.0), 6) AS hz, round(20.0 * log10(greatest(p_retailprice - 900.0, 1e-9)), 6) AS db FROM part""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    data = F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 128).cast("int"), F.lit(7))
    return p.select("p_partkey", codecs.checksum(data).cast("int").alias("checksum"), F.round(expr.midi_to_hz(F.col("p_size")), 6).alias("hz"), F.round(expr.amp_to_db(F.col("p_retailprice") - 900.0), 6).alias("db"))

