"""Sources ranked by the shrunken rating of the items they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR_WEIGHT = 4.0
LEVELS = ("archive", "folder", "file")


def source_key(path: Column, level: str) -> Column:
    """A path's archive (up to its first slash), folder (up to its last) or the path itself; the whole path where nothing precedes the slash."""
    if level == "file":
        return path
    if level == "archive":
        head = F.substring_index(path, "/", 1)
    elif level == "folder":
        head = F.regexp_replace(path, "/[^/]*$", "")
    else:
        raise ValueError(f"level: one of {LEVELS}")
    return F.when(F.length(head) > 0, head).otherwise(path)


def rank_sources(entries: DataFrame, items: DataFrame, level: str = "file", prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """entries: item, path (many per item); items: item, rating, predicted (both may be null).

    One row per key: items (distinct), rated, average, score, expected. score pulls the mean
    rating towards the mean over all rated items, as prior_weight further ratings would; null
    if the source has no rated item. expected averages ratings, or predictions in their stead.
    """
    overall = items.agg((F.sum(F.col("rating").cast("double")) / F.count("rating")).alias("mean")).select(F.coalesce("mean", F.lit(0.0)).alias("mean"))
    pairs = entries.select("item", source_key(F.col("path"), level).alias("key")).distinct()
    held = pairs.join(items.select("item", "rating", "predicted"), "item")
    best = F.coalesce(F.col("rating").cast("double"), F.col("predicted"))
    sums = held.groupBy("key").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("rating").alias("rated"),
        F.sum(F.col("rating").cast("double")).alias("total"),
        (F.sum(best) / F.count(best)).alias("expected"),
    )
    w = F.lit(float(prior_weight))
    return sums.withColumn("mean", overall.scalar()).select(
        "key",
        "items",
        "rated",
        F.when(F.col("rated") > 0, F.col("total") / F.col("rated")).alias("average"),
        F.when(F.col("rated") > 0, (F.col("total") + w * F.col("mean")) / (F.col("rated") + w)).alias("score"),
        "expected",
    )


def order_sources(ranked: DataFrame, by: str = "score", worst_first: bool = False) -> DataFrame:
    """Best (or worst) first; sources without the value last either way, by their items among themselves; ties by key."""
    value = F.col(by).asc_nulls_last() if worst_first else F.col(by).desc_nulls_last()
    return ranked.orderBy(value, F.when(F.col(by).isNull(), F.col("items")).desc_nulls_last(), "key")


def top_sources(ranked: DataFrame, n: int = 24, by: str = "score", worst_first: bool = False) -> DataFrame:
    return order_sources(ranked.where(F.col(by).isNotNull()), by, worst_first).limit(n)
