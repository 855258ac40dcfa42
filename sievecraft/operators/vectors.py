"""Vectors: exact medians, robust standardizing, moments, whitening, projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import doubles


def unnest(df: DataFrame, vector: str = "v", *keys: str) -> DataFrame:
    """keys, pos (from 0), x."""
    return df.select(*keys, F.posexplode(doubles(vector)).alias("pos", "x"))


def exact_medians(values: DataFrame, key: str = "pos", value: str = "x", margin: float = 0.0005) -> DataFrame:
    """key, median, n. Exact, whatever the size: a sketch brackets each median, and only the distinct values inside the bracket, a thousandth of all or less, are counted and sorted."""
    shares = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    marks = values.groupBy(key).agg(F.percentile_approx(value, shares, int(5 / margin)).alias("q"), F.count(value).alias("n")).select(key, F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), "n")
    v = F.col(value)
    marked = values.where(v.isNotNull()).join(F.broadcast(marks), key)  # one row per dimension
    # ties are one row, with their number; what lies below the bracket is one row too
    counted = marked.where(v <= F.col("b")).groupBy(key, "n", F.when(v >= F.col("a"), v).alias("x")).agg(F.count(F.lit(1)).alias("rows"))
    until = F.sum("rows").over(Window.partitionBy(key).orderBy(F.col("x").asc_nulls_first()))
    ranked = counted.withColumn("until", until).where("x IS NOT NULL")
    holds = lambda r: (F.col("until") > r) & (F.col("until") - F.col("rows") <= r)
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return ranked.groupBy(key).agg(((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("median"), F.max("n").alias("n"))


def robust_scales(df: DataFrame, vector: str = "v") -> DataFrame:
    """pos, median, scale: 1.4826 times the median absolute deviation, else the population deviation, else 1."""
    values = unnest(df, vector)
    med = exact_medians(values).select("pos", "median")
    off = values.join(F.broadcast(med), "pos").select("pos", F.abs(F.col("x") - F.col("median")).alias("x"))
    mad = exact_medians(off).select("pos", (F.lit(1.4826) * F.col("median")).alias("mad"))
    sd = values.groupBy("pos").agg(F.stddev_pop("x").alias("sd"))
    scale = F.when(F.col("mad") > 1e-9, F.col("mad")).when(F.col("sd") > 1e-9, F.col("sd")).otherwise(F.lit(1.0))
    return med.join(mad, "pos").join(sd, "pos").select("pos", "median", scale.alias("scale"))


@dataclass
class Standardizer:
    median: list[float]
    scale: list[float]
    weight: list[float]

    @classmethod
    def fit(cls, df: DataFrame, vector: str = "v", weight: list[float] | None = None) -> "Standardizer":
        rows = robust_scales(df, vector).orderBy("pos").collect()  # one row per dimension
        return cls([r.median for r in rows], [r.scale for r in rows], weight or [1.0] * len(rows))

    def apply(self, vector: Column, clip: float = 5.0) -> Column:
        lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        z = F.zip_with(F.zip_with(vector, lits(self.median), lambda x, m: x - m), lits(self.scale), lambda x, s: x / s)
        return F.zip_with(F.transform(z, lambda x: F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))), lits(self.weight), lambda x, w: x * w)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def moments(df: DataFrame, dim: int, vector: str = "v", group: str | None = None) -> DataFrame:
    """group (0 if none), i, j, s, n: sums of x_i * x_j over rows, where component 0 is the constant 1.

    Each task adds up its rows in one matrix per group; the matrices' cells are then summed.
    """
    width = dim + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.hstack([np.ones((b.num_rows, 1)), _matrix(b.column(1), dim)])
            g = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(g):
                part = x[g == key]
                total[int(key)] = total.get(int(key), 0) + part.T @ part
        for key, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["g", "m"])

    g = (F.col(group) if group else F.lit(0)).cast("long")
    rows = df.where(F.col(vector).isNotNull() & g.isNotNull()).select(g.alias("g"), doubles(vector).alias("v"))
    cells = rows.mapInArrow(run, "g long, m array<double>").select("g", F.posexplode("m").alias("at", "s"))
    return cells.groupBy("g", "at").agg(F.sum("s").alias("s")).select(F.col("g").alias("group"), F.floor(F.col("at") / width).cast("int").alias("i"), (F.col("at") % width).cast("int").alias("j"), "s")


def collect_moments(df: DataFrame, dim: int, vector: str = "v", group: str | None = None) -> dict[int, np.ndarray]:
    """The matrices of moments(), one per group; their size depends on dim and the number of groups only."""
    out: dict[int, np.ndarray] = {}
    for r in moments(df, dim, vector, group).collect():
        out.setdefault(r.group, np.zeros((dim + 1, dim + 1)))[r.i, r.j] = r.s
    return out


def mean_and_covariance(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, population covariance and number of rows of a moment matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return mean, m[1:, 1:] / n - np.outer(mean, mean), n


def covariance(df: DataFrame, dim: int, vector: str = "v") -> DataFrame:
    """i, j, cov (population), for i <= j, from 0."""
    m = moments(df, dim, vector)
    n = m.where("i = 0 AND j = 0").select(F.col("s").alias("n"))
    mean = m.where("i = 0 AND j > 0").withColumn("n", n.scalar()).select(F.col("j").alias("at"), (F.col("s") / F.col("n")).alias("mean"), "n")
    pairs = m.where("i > 0 AND i <= j")
    a, b = mean.select(F.col("at").alias("i"), F.col("mean").alias("mi"), "n"), mean.select(F.col("at").alias("j"), F.col("mean").alias("mj"))
    return pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), (F.col("s") / F.col("n") - F.col("mi") * F.col("mj")).alias("cov"))


def redundancy_weights(cov: np.ndarray) -> np.ndarray:
    """1 / (sqrt(max(1, sum of squared correlations)) * deviation) for each dimension."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.outer(sd, sd)
    corr = np.where(scale > 1e-9, cov / np.where(scale > 1e-9, scale, 1), 0.0)
    return 1 / (np.sqrt(np.maximum(1, (corr**2).sum(1))) * np.maximum(sd, 1e-6))


@dataclass
class Projection:
    """x -> matrix @ (x - mean)."""

    mean: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray | None = None
    capped: int = 0

    def apply(self, df: DataFrame, vector: str = "v", into: str = "p") -> DataFrame:
        own = df.sparkSession.sparkContext.broadcast((self.mean, self.matrix))  # of the dimension's size
        keep = [c for c in df.columns if c != into]
        at, dim = keep.index(vector), len(self.mean)
        schema = ", ".join(f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, matrix = own.value
            for b in batches:
                p = (_matrix(b.column(at), dim) - mean) @ matrix.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64()))], names=[*b.schema.names, into])

        return df.select(*keep).mapInArrow(run, f"{schema}, `{into}` array<double>")


def whitener(m: np.ndarray, ridge: float = 0.05, gain: float = 3.0, weights: np.ndarray | None = None) -> Projection:
    """Symmetric whitening of a moment matrix's rows; directions of little variance are not blown up by more than `gain` over a usual one."""
    mean, cov, _ = mean_and_covariance(m)
    dim = len(mean)
    values, vectors = np.linalg.eigh(cov + (ridge * np.trace(cov) / dim + 1e-9) * np.eye(dim))
    most = gain / np.sqrt(values.mean())
    full = 1 / np.sqrt(np.maximum(values, 1e-12))
    w = (vectors * np.minimum(full, most)) @ vectors.T
    if weights is not None:
        w = weights[:, None] * w
    return Projection(mean, w, capped=int((full > most).sum()))


def redundancy_ratio(m: np.ndarray) -> float:
    """Largest eigenvalue of the covariance over the mean one."""
    values = np.linalg.eigvalsh(mean_and_covariance(m)[1])
    return float(values[-1] / max(values.mean(), 1e-12))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with the sign that the usual start vector of an iteration would give them."""
    c, d = np.meshgrid(np.arange(vectors.shape[1]), np.arange(vectors.shape[0]))
    start = np.sin((c + 1) * (d + 1) * 0.7) + 0.1
    return vectors * np.where((vectors * start).sum(1) < 0, -1, 1)[:, None]


def pca(m: np.ndarray, components: int = 2) -> Projection:
    """Principal components of a moment matrix's rows, with each one's share of the variance."""
    mean, cov, _ = mean_and_covariance(m)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:components]
    return Projection(mean, _signed(vectors[:, top].T), values[top] / max(values.sum(), 1e-12))


def lda(by_class: dict[int, np.ndarray], components: int = 2, shrink: float = 0.08) -> Projection:
    """Directions that part the classes, from one moment matrix per class. Needs two classes and twice as many rows as classes."""
    held = {c: m for c, m in by_class.items() if m[0, 0] > 0}
    used = sum(m[0, 0] for m in held.values())
    if len(held) < 2 or used < 2 * len(held):
        raise ValueError("too few rows or classes")
    means = {c: mean_and_covariance(m)[0] for c, m in held.items()}
    overall = sum(m[0, 1:] for m in held.values()) / used
    dim = len(overall)
    within = sum(m[1:, 1:] - m[0, 0] * np.outer(means[c], means[c]) for c, m in held.items()) / used
    ridge = shrink * np.trace(within) / dim + 1e-9
    for attempt in range(6):
        try:
            lower = np.linalg.cholesky(within + ridge * 4**attempt * np.eye(dim))
            break
        except np.linalg.LinAlgError:
            continue
    else:
        raise ValueError("the scatter within classes is singular")
    rows = np.stack([np.linalg.solve(lower, means[c] - overall) * np.sqrt(held[c][0, 0] / used) for c in sorted(held)])
    values, vectors = np.linalg.eigh(rows.T @ rows)
    top = np.argsort(values)[::-1][:components]
    return Projection(overall, np.linalg.solve(lower.T, _signed(vectors[:, top].T).T).T, values[top] / max((rows**2).sum(), 1e-12))


def class_means(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """label, pos, mean."""
    return unnest(df, vector, label).groupBy(label, "pos").agg(F.avg("x").alias("mean"))
