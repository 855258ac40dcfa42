"""A preference model of a few ratings: ridge line, shrunken category offsets, and a kernel over rated neighbours.

Sums and residuals are aggregated by Spark; the driver solves systems of the vectors' width.
Five folds choose the ridge, the number of neighbours and their share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import knn
from .vectors import collect_moments

FOLDS = 5
RIDGES = (0.05, 0.2, 1.0, 5.0, 25.0)
BLENDS = (0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0)
NEIGHBOURS = (4, 8, 16, 32, 64)
SHRINK = 6.0
LEAST_ROWS = 12


def fold_sums(df: DataFrame, dim: int) -> dict[int, np.ndarray]:
    """fold -> moment matrix of (1, x, y). df: v, rating, fold."""
    rows = df.select(F.concat(F.col("v").cast("array<double>"), F.array(F.col("rating").cast("double"))).alias("v"), "fold")
    return collect_moments(rows, dim + 1, group="fold")


def ridge(m: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (the mean rating) of a moment matrix of (1, x, y): X is not centred, y is."""
    n, mean = m[0, 0], m[0, -1] / m[0, 0]
    xx, xy = m[1:-1, 1:-1], m[1:-1, -1] - mean * m[0, 1:-1]
    return np.linalg.solve(xx + lam * n * np.eye(len(xx)), xy), float(mean)


def shrunken_offsets(df: DataFrame, group: str, residual: Column, shrink: float = SHRINK) -> DataFrame:
    """group, n, mean, offset: the mean residual, and that pulled to zero as by `shrink` further rows."""
    return df.groupBy(group).agg(F.count(residual).alias("n"), (F.sum(residual) / F.count(residual)).alias("mean"), (F.sum(residual) / (F.count(residual) + shrink)).alias("offset"))


def kernel_estimate(near: DataFrame, k: int, value: str = "rating") -> DataFrame:
    """near: i, d, rank, rating of rated neighbours, and far, the k-th's distance, where lists of k have it -> i, estimate: their mean, weighted by exp(-(d / far)^2)."""
    held = near.where(F.col("rank") <= k)
    if "far" not in near.columns:
        held = held.join(held.groupBy("i").agg(F.max("d").alias("far")), "i")
    share = F.col("d") / F.greatest(F.col("far"), F.lit(1e-6))
    return held.withColumn("w", F.exp(-share * share)).groupBy("i").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("estimate"))


def r_squared(df: DataFrame, y: str, estimate: str, *keys: str) -> DataFrame:
    """keys, r2: one minus the squared errors over the squared deviations from the mean."""
    n, s = F.count(F.lit(1)), F.sum(y)
    sst = F.sum(F.col(y) * F.col(y)) - s * s / n
    return df.groupBy(*keys).agg((F.lit(1.0) - F.sum((F.col(y) - F.col(estimate)) * (F.col(y) - F.col(estimate))) / sst).alias("r2"))


@dataclass
class Taste:
    beta: np.ndarray
    intercept: float
    offsets: dict[str, float]
    lam: float
    blend: float
    k: int
    r2: float

    def distance_weights(self, strength: float = 1.0) -> np.ndarray:
        """Weights of the dimensions: those that matter to the model count more, as far as it can be trusted."""
        trust = min(max(self.r2 / 0.3, 0.0), 1.0) * strength
        return 1 - 0.7 * trust + 1.4 * trust * np.abs(self.beta) / max(np.abs(self.beta).max(), 1e-12)

    def top_terms(self, names: list[str], n: int = 6) -> list[tuple[str, float]]:
        order = sorted(range(len(names)), key=lambda i: (-abs(self.beta[i]), i))[:n]
        return [(names[i], float(self.beta[i])) for i in order]

    def line(self, vector: Column, category: Column) -> Column:
        beta = F.array(*[F.lit(float(b)) for b in self.beta])
        at = F.aggregate(F.zip_with(vector, beta, lambda x, b: x * b), F.lit(self.intercept), lambda s, x: s + x)
        pairs = [F.lit(v) for c, o in self.offsets.items() for v in (c, float(o))]
        own = F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(0.0)) if pairs else F.lit(0.0)
        return at + own


def _lines(rows: DataFrame, models: dict[int, list[tuple[np.ndarray, float]]], dim: int) -> DataFrame:
    """rows with `lines`: each fold's and each ridge's estimate, one after the other."""
    beta = np.array([[b for b, _ in models[f]] for f in sorted(models)]).reshape(-1, dim)
    base = np.array([[a for _, a in models[f]] for f in sorted(models)]).ravel()
    own = rows.sparkSession.sparkContext.broadcast((beta, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, a = own.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x @ b.T + a), pa.list_(pa.float64()))], names=[*batch.schema.names, "lines"])

    return rows.select("id", "v", "category", "rating", "fold").mapInArrow(run, "id long, v array<double>, category string, rating double, fold int, lines array<double>")


def fit(df: DataFrame, dim: int, space: DataFrame | None = None) -> Taste | None:
    """df: id, v, category, rating (null: not rated), fold (of rated rows). space: id, v of the space neighbours are sought in (df's own if none).

    None with fewer than twelve rated rows, or if all ratings are equal.
    """
    rated = df.where(F.col("rating").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"), F.col("category").cast("string").alias("category"), F.col("rating").cast("double").alias("rating"), F.col("fold").cast("int").alias("fold")).cache()
    stats = rated.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rating").alias("sd")).first()
    if stats.n < LEAST_ROWS or not stats.sd:
        return None
    sums = fold_sums(rated, dim)
    whole = sum(sums.values())
    models = {f: [ridge(whole - sums[f], lam) for lam in RIDGES] for f in sorted(sums)}
    held = _lines(rated, models, dim).cache()
    folds, width = sorted(models), len(RIDGES)
    # a fold's offsets come from rows of the other folds
    sums_of = [
        F.sum(F.when(F.col("fold") != f, F.col("rating") - F.col("lines")[i * width + j])) / (F.count_if(F.col("fold") != f) + SHRINK)
        for i, f in enumerate(folds)
        for j in range(width)
    ]
    offsets = held.groupBy("category").agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums_of]).alias("offsets"))
    at = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int") - 1
    line = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.element_at("lines", at * width + j + 1) + F.element_at("offsets", at * width + j + 1))
    lined = held.join(offsets, "category").select("id", "rating", line.alias("line"))

    near_in = (space.join(rated.select("id", "rating", "fold"), "id") if space is not None else rated).select("id", "v", "rating", "fold")
    n_near = max(NEIGHBOURS)
    near = knn(near_in, n_near, apart="fold")  # each row's list is of the other folds
    ranked = near.join(rated.select(F.col("id").alias("j"), "rating"), "j").select("i", "d", "rank", "rating").cache()
    scored = {k: r_squared(kernel_estimate(ranked, k).join(rated.select(F.col("id").alias("i"), F.col("rating").alias("y")), "i"), "y", "estimate").first().r2 for k in NEIGHBOURS}
    k = max(NEIGHBOURS, key=lambda k: (scored[k], -k))
    both = lined.join(kernel_estimate(ranked, k).withColumnRenamed("i", "id"), "id", "left").withColumn("estimate", F.coalesce("estimate", F.lit(float(whole[0, -1] / whole[0, 0]))))
    n, s = F.count(F.lit(1)), F.sum("rating")
    sst = F.sum(F.col("rating") * F.col("rating")) - s * s / n
    grid = [(lam, b) for lam in range(width) for b in BLENDS]
    cells = [F.lit(1.0) - F.sum(F.pow(F.col("rating") - ((1 - b) * F.col("line")[j] + b * F.col("estimate")), F.lit(2.0))) / sst for j, b in grid]
    row = both.agg(F.array(*cells).alias("r2")).first().r2
    best = max(range(len(grid)), key=lambda i: (row[i], -i))
    j, blend = grid[best]
    beta, base = ridge(whole, RIDGES[j])
    line_all = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in beta]), lambda x, b: x * b), F.lit(base), lambda a, x: a + x)
    final = {r.category: r.offset for r in shrunken_offsets(rated, "category", F.col("rating") - line_all).collect()}  # one row per category
    for frame in (rated, held, ranked):
        frame.unpersist()
    return Taste(beta, base, final, RIDGES[j], blend, k if blend else 0, float(row[best]))


def predict(df: DataFrame, model: Taste, space: DataFrame | None = None) -> DataFrame:
    """id, predicted. Neighbours are sought among rated rows, in the space the model was fitted in."""
    line = df.select("id", model.line(F.col("v").cast("array<double>"), F.col("category").cast("string")).alias("line"))
    if not model.blend:
        return line.withColumnRenamed("line", "predicted")
    rated = df.select("id", F.col("rating").isNotNull().alias("rated"), F.col("rating").cast("double").alias("rating"))
    rows = (space if space is not None else df).select("id", "v").join(rated, "id")
    near = knn(rows, model.k, of="rated").join(rated.select(F.col("id").alias("j"), "rating"), "j")
    est = kernel_estimate(near, model.k).withColumnRenamed("i", "id")
    b = F.lit(model.blend)
    return line.join(est, "id", "left").select("id", F.coalesce((1 - b) * F.col("line") + b * F.col("estimate"), "line").alias("predicted"))
