"""Table order, queue order, pairs to compare, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a missing value sorts as, by kind of column.
STAND_INS = {"text": "~", "rating": -1.0, "predicted": float("-inf"), "time": float("inf"), "brightness": float("-inf")}


def table_order(df: DataFrame, column: str, kind: str, descending: bool = False, key: str = "id", collation: str | None = None) -> DataFrame:
    """Rows by one column, missing values as their stand-in, ties by key ascending in either direction."""
    stand_in = F.lit(STAND_INS[kind])
    value = F.col(column)
    if kind == "text":
        value = F.lower(F.when(value != "", value))
        if collation:
            value = F.collate(F.coalesce(value, stand_in), collation)
    value = F.coalesce(value, stand_in) if not (kind == "text" and collation) else value
    return df.orderBy(value.desc() if descending else value.asc(), F.col(key).asc())


def page(df: DataFrame, number: int, size: int = 300) -> DataFrame:
    """Page `number` (from 0) of an ordered frame."""
    return df.offset(number * size).limit(size)


def queue_order(df: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """Items to judge next. mode: "predicted" (best first), "family" (largest first) or "given" (by position); items whose family has no rating yet come first."""
    by = {"predicted": F.col("predicted").desc_nulls_last(), "family": F.col("family_size").desc(), "given": F.col("position").asc()}[mode]
    return df.orderBy(F.coalesce(F.col("family_has_rating"), F.lit(False)).asc(), by, F.col(key).asc())


def family_has_rating(family: str = "family", rating: str = "rating") -> Column:
    return F.max(F.col(rating).isNotNull()).over(Window.partitionBy(family))


def bout_list(members: DataFrame, least_rating: int = 4, least_contenders: int = 2) -> DataFrame:
    """members: family, id, rating, done. Families with enough well-rated contenders: undone first, then larger ones."""
    held = members.where(F.col("rating") >= least_rating).groupBy("family").agg(F.count(F.lit(1)).alias("contenders"), F.max("done").alias("done"))
    return held.where(F.col("contenders") >= least_contenders).orderBy(F.col("done").asc(), F.col("contenders").desc(), F.col("family").asc())


def pair_candidates(standings: DataFrame, asked: DataFrame, closest: int = 6) -> DataFrame:
    """band, first, second, rank: for each band the item with the fewest games, and its closest opponents by score that it has not met.

    standings: band, id, score, games; asked: a, b with a < b.
    """
    w = Window.partitionBy("band")
    first = standings.withColumn("rn", F.row_number().over(w.orderBy("games", "id"))).where("rn = 1").select("band", F.col("id").alias("first"), F.col("score").alias("own"))
    pairs = standings.join(first, "band").where(F.col("id") != F.col("first"))
    pairs = pairs.withColumn("a", F.least("first", "id")).withColumn("b", F.greatest("first", "id")).join(asked.select("a", "b").distinct(), ["a", "b"], "left_anti")
    near = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.abs(F.col("score") - F.col("own")), "id"))).where(F.col("rank") <= closest)
    return near.select("band", "first", F.col("id").alias("second"), F.col("rank").cast("int").alias("rank"))


def next_pair(standings: DataFrame, asked: DataFrame, closest: int = 6) -> DataFrame:
    """One pair of pair_candidates() for each band, picked by hash."""
    by_hash = Window.partitionBy("band").orderBy(F.xxhash64("first", "second"), "second")
    return pair_candidates(standings, asked, closest).withColumn("pick", F.row_number().over(by_hash)).where("pick = 1").select("band", "first", "second")


def weak_run(selected: DataFrame, best: float, longest: int = 32, key: str = "id") -> DataFrame:
    """Backfilled rows first, then by rating and tie-break ascending, of those below best; at most `longest`."""
    return selected.where(F.col("rating") < best).orderBy(F.col("backfilled").desc(), "rating", "tie_break", key).limit(longest)


def rank_band(standings: DataFrame, star: int, key: str = "id") -> DataFrame:
    return standings.where(F.col("star") == star).orderBy(F.desc("score"), key)
