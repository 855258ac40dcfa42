"""What a scatter plot needs of its rows: bounds, sizes, lattices, grids and region names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def order_statistics(df: DataFrame, column: str, shares: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """One row lo, hi: the values at positions floor(a * n) and min(n - 1, ceil(b * n)) of the sorted finite values; lo - 1 and lo + 1 if hi is no greater.

    Positions are found from counts of distinct values, so no task sorts all rows: one sum
    per value, then a running sum over ranges of values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(finite(F.col("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # ranges of values by approximate quantiles; each range's rows are summed apart
    cuts = values.approxQuantile("v", [i / 32 for i in range(1, 32)], 0.01)
    ranged = values.withColumn("part", sum(((F.col("v") > F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))  # 32 rows
    own = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = ranged.withColumn("upto", own).join(F.broadcast(before), "part").withColumn("upto", F.col("upto") + F.col("before"))
    at = [F.floor(F.lit(shares[0]) * F.col("total")), F.least(F.col("total") - 1, F.ceil(F.lit(shares[1]) * F.col("total")))]
    picks = [F.min(F.when(F.col("upto") > a, F.col("v"))).alias(name) for a, name in zip(at, ("lo", "hi"))]
    bounds = placed.agg(*picks)
    flat = F.col("hi") <= F.col("lo")
    return bounds.select(F.when(flat, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def normalise(df: DataFrame, column: str, bounds: DataFrame, into: str, flip: bool = False) -> DataFrame:
    """Adds (column - lo) / (hi - lo), or 1 minus that; values outside the bounds are not clipped."""
    t = (F.col(column) - F.col("__b.lo")) / (F.col("__b.hi") - F.col("__b.lo"))
    return df.withColumn("__b", bounds.select(F.struct("lo", "hi")).scalar()).withColumn(into, 1 - t if flip else t).drop("__b")


def radius(value: Column, lo: Column, hi: Column, smallest: float = 2.0, largest: float = 12.0) -> Column:
    """Radius whose area grows with the clipped value, in quarters of a pixel."""
    t = F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    area = F.lit(smallest**2) + t * F.lit(largest**2 - smallest**2)
    return F.floor(F.sqrt(area) * 4 + F.lit(0.5)) / F.lit(4.0)


def lattice(df: DataFrame, column: str, most_levels: int = 64, rows_per_level: int = 4) -> DataFrame:
    """One row: rows, levels, is_lattice (all integers, few levels, enough rows for each)."""
    c = F.col(column).cast("double")
    stats = df.where(finite(c)).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(c).alias("levels"), F.min((c == F.floor(c)).cast("int")).alias("whole"))
    fits = (F.coalesce("whole", F.lit(0)) == 1) & (F.col("levels") <= most_levels) & (F.col("rows") >= F.col("levels") * rows_per_level)
    return stats.select("rows", "levels", fits.alias("is_lattice"))


def jitter(key: Column, seed: int, spread: float) -> Column:
    """A fixed offset in [-spread / 2, spread / 2) for each key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)).cast("double") / F.lit(float(1 << 20)) - 0.5) * F.lit(spread)


def grid_cell(x: Column, y: Column, columns: int = 32, rows: int = 22) -> Column:
    """Cell number of a normalised point, points outside in the edge cells."""
    place = lambda v, n: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1))
    return (place(y, rows) * columns + place(x, columns)).cast("int")


def document_frequency(tokens: DataFrame, token: str = "tokens") -> DataFrame:
    """tokens: one array of distinct tokens per row -> token, df."""
    return tokens.select(F.explode(token).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def cell_words(points: DataFrame, df: DataFrame, corpus: int, least_rows: int = 30, least_hits: int = 5, least_share: float = 0.03, least_lift: float = 2.0) -> DataFrame:
    """points: cell, tokens. cell, token, n, hits, lift, score of words that are frequent and much more so than in the corpus."""
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    hits = points.select("cell", F.explode("tokens").alias("token")).groupBy("cell", "token").agg(F.count(F.lit(1)).alias("hits"))
    lift = F.col("hits") / (F.col("df") / F.lit(float(corpus)) * F.col("n"))
    held = hits.join(sizes, "cell").join(df, "token").withColumn("lift", lift)
    held = held.where((F.col("hits") >= least_hits) & (F.col("hits") >= least_share * F.col("n")) & (F.col("lift") >= least_lift))
    return held.select("cell", "token", "n", "hits", "lift", (F.col("hits") * F.log("lift")).alias("score"))


def best_words(words: DataFrame) -> DataFrame:
    """Each cell's word of the highest score (ties: the first by name)."""
    w = Window.partitionBy("cell").orderBy(F.round(F.col("score"), 9).desc(), "token")
    return words.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def region_labels(points: DataFrame, best: DataFrame, df: DataFrame, corpus: int, connect, columns: int = 32, per_word: int = 3) -> DataFrame:
    """Names of regions: 4-connected cells with the same best word.

    points: cell, x, y, tokens; best: cell, token; connect: edges (a, b) -> (node, component).
    region (its least cell), token, x, y (mean of the region's rows), n, hits, lift, score; at
    most per_word regions of a word, best first.
    """
    cells = best.select("cell", "token")
    other = cells.select(F.col("cell").alias("next"), F.col("token").alias("same"))
    beside = cells.withColumn("next", F.explode(F.array(F.when(F.col("cell") % columns < columns - 1, F.col("cell") + 1), F.col("cell") + columns))).where("next IS NOT NULL")
    edges = beside.join(other, "next").where("token = same").select(F.col("cell").alias("a"), F.col("next").alias("b"))
    regions = cells.join(connect(edges).select(F.col("node").alias("cell"), "component"), "cell", "left").select("cell", "token", F.coalesce("component", "cell").alias("region"))
    rows = points.join(regions, "cell")
    has = F.array_contains(F.col("tokens"), F.col("token"))
    rolled = rows.groupBy("region", "token").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(has.cast("long")).alias("hits"))
    lift = F.col("hits") / (F.col("df") / F.lit(float(corpus)) * F.col("n"))
    rolled = rolled.join(df, "token").withColumn("lift", lift).withColumn("score", F.col("hits") * F.log(F.greatest(F.lit(1.01), F.col("lift"))))
    w = Window.partitionBy("token").orderBy(F.round(F.col("score"), 9).desc(), "region")
    return rolled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_word).select("region", "token", "x", "y", "n", "hits", "lift", "score", F.col("rank").cast("int").alias("rank"))
