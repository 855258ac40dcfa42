"""Windows over ordered rows: detrending, slopes, peaks, runs, and event-time aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detrend(df: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """df with trend (centred moving average over 2 * half + 1 rows) and residual."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("trend", F.avg(value).over(w)).withColumn("residual", F.col(value) - F.col("trend"))


def wobble(df: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """key, wobble: root mean square of the residual over the mean."""
    d = detrend(df, key, order, value, half)
    return d.groupBy(key).agg((F.sqrt(F.avg(F.col("residual") * F.col("residual"))) / F.avg(value)).alias("wobble"))


def slopes(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, slope of the least-squares line; 0 where x does not vary."""
    return df.groupBy(key).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


def local_maxima(df: DataFrame, key: str, order: str, value: str, ahead: int, least: float = 0.0) -> DataFrame:
    """Rows that none of the next `ahead` rows exceeds, at least `least` times their key's peak."""
    w = Window.partitionBy(key).orderBy(order)
    after = F.max(value).over(w.rowsBetween(1, ahead))
    peak = F.max(value).over(Window.partitionBy(key))
    return df.withColumn("__a", after).withColumn("__p", peak).where((F.col("__a").isNull() | (F.col("__a") <= F.col(value))) & (F.col(value) >= F.lit(least) * F.col("__p"))).drop("__a", "__p")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, runs: stretches of equal values; inversions: falls from one row to the next."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("__b", F.lag(value).over(w))
    return d.groupBy(key).agg(F.sum((F.col("__b").isNull() | (F.col("__b") != F.col(value))).cast("long")).alias("runs"), F.coalesce(F.sum((F.col(value) < F.col("__b")).cast("long")), F.lit(0).cast("long")).alias("inversions"))


def tumbling(events: DataFrame, length: str, at: str = "ts", *keys: str) -> DataFrame:
    """start, keys, n, total of windows of `length`."""
    return events.groupBy(F.window(at, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, length: str, every: str, at: str = "ts", *keys: str) -> DataFrame:
    return events.groupBy(F.window(at, length, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, at: str = "ts") -> DataFrame:
    """key, start, end (last event plus gap), n of sessions that a silence of `gap` ends."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
