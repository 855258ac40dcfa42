"""Quota allocation: a fixed number of places dealt to categories by quality, then filled.

candidates: id, category, rating, pinned, tie_break. Ranks and fills are windows and joins;
only one row per category reaches the driver, where places are apportioned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import round_half_up

# fixed values: least and most places of each category by default
FLOORS = {"keys": 12, "bells": 8, "plucked": 8, "bass": 8, "brass": 8, "lead": 6, "organ": 6, "strings": 12, "abstract": 6}
CEILINGS = {"keys": 30, "bells": 22, "plucked": 22, "bass": 18, "brass": 22, "lead": 18, "organ": 16, "strings": 30, "abstract": 18}
TOTAL, TOP_N, LEAST_RATING, BACKFILL_RATING = 128, 12, 4, 1


def _order():
    return [F.col("pinned").desc(), F.col("rating").desc(), F.col("tie_break").desc(), F.col("id").asc()]


def rank_within_category(candidates: DataFrame, least_rating: int | None = LEAST_RATING) -> DataFrame:
    """Candidates that are pinned or rated well enough, with their rank in their category."""
    pool = candidates if least_rating is None else candidates.where(F.col("pinned") | (round_half_up(F.col("rating")) >= least_rating))
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*_order())))


def pool_sizes(ranked: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """category, pool, pinned, weight (mean rating of the first top_n)."""
    top = F.when(F.col("rank") <= top_n, F.col("rating").cast("double"))
    return ranked.groupBy("category").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("pinned")).alias("pinned"), (F.sum(top) / F.count(top)).alias("weight"))


def apportion(pools: dict[str, tuple[int, int, float]], order: list[str], floors: dict[str, int], ceilings: dict[str, int], total: int) -> dict[str, int]:
    """Places per category. pools: category -> (pool, pinned, weight)."""
    places = dict.fromkeys(order, 0)
    cap = {c: min(ceilings.get(c, total), pools.get(c, (0, 0, 0.0))[0]) for c in order}
    left = total
    for c in order:  # pinned ones first
        places[c] = min(pools.get(c, (0, 0, 0.0))[1], cap[c], left)
        left -= places[c]
    want = {c: max(0, min(floors.get(c, 0), cap[c]) - places[c]) for c in order}
    asked = sum(want.values())
    if asked > left:
        want = {c: w * left // asked for c, w in want.items()}
    for c in order:
        got = min(want[c], left)
        places[c] += got
        left -= got
    while left > 0:
        open_ = [c for c in order if places[c] < cap[c] and pools[c][2] > 0]
        if not open_:
            break
        weight, free, moved = sum(pools[c][2] for c in open_), left, 0
        for c in open_:
            got = min(int(free * pools[c][2] / weight), cap[c] - places[c])
            places[c] += got
            moved += got
        left -= moved
        if not moved:  # shares below one place: greedily to the highest weights
            for c in sorted(open_, key=lambda c: -pools[c][2]):
                got = min(left, cap[c] - places[c])
                places[c] += got
                left -= got
                moved += got
                if not left:
                    break
            if not moved:
                break
    return places


@dataclass
class Allocation:
    selected: DataFrame  # id, category, rating, pinned, tie_break, backfilled
    places: dict[str, int] = field(default_factory=dict)


def allocate(candidates: DataFrame, total: int = TOTAL, floors: dict[str, int] = FLOORS, ceilings: dict[str, int] = CEILINGS, order: list[str] | None = None, top_n: int = TOP_N, least_rating: int = LEAST_RATING, backfill: bool = True, backfill_rating: int = BACKFILL_RATING) -> Allocation:
    spark = candidates.sparkSession
    order = list(floors) if order is None else order
    candidates = candidates.select("id", "category", F.col("rating").cast("double").alias("rating"), "pinned", F.col("tie_break").cast("double").alias("tie_break")).where(F.col("category").isin(*order))
    ranked = rank_within_category(candidates, least_rating)
    pools = {r.category: (r.pool, r.pinned, r.weight or 0.0) for r in pool_sizes(ranked, top_n).collect()}  # one row per category
    places = apportion(pools, order, floors, ceilings, total)
    quota = spark.createDataFrame([(c, n, ceilings.get(c, total)) for c, n in places.items()], "category string, places int, ceiling int")
    seated = ranked.join(F.broadcast(quota), "category").where(F.col("rank") <= F.col("places")).drop("rank", "places", "ceiling").withColumn("backfilled", F.lit(False))
    free = total - sum(places.values())
    if not backfill or free <= 0:
        return Allocation(seated, places)
    rest = candidates.where(round_half_up(F.col("rating")) >= backfill_rating).join(seated.select("id"), "id", "left_anti")
    # first under the ceilings, then without them; both passes in one global order
    room = rest.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(*_order()))).join(F.broadcast(quota), "category")
    room = room.withColumn("over", (F.col("nth") > F.col("ceiling") - F.col("places")).cast("int"))
    filled = room.orderBy("over", *_order()).limit(free).drop("nth", "places", "ceiling", "over").withColumn("backfilled", F.lit(True))
    return Allocation(seated.unionByName(filled.select(*seated.columns)), places)


def bank_split(ordered: DataFrame, banks: int = 4, position: str = "position") -> DataFrame:
    """bank (from 0) of each position (from 0): ceil(n / banks) to a bank."""
    n = ordered.agg(F.ceil(F.count(F.lit(1)) / banks).alias("per"))
    return ordered.withColumn("per", n.scalar()).withColumn("bank", F.floor(F.col(position) / F.greatest("per", F.lit(1))).cast("int")).drop("per")


def candidate_union(families: DataFrame, pins: DataFrame) -> DataFrame:
    """Both with columns id, category, rating, ...; of rows with one id the family's comes first; rows without category go."""
    both = families.withColumn("__p", F.lit(0)).unionByName(pins.withColumn("__p", F.lit(1))).where("category IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("id").orderBy("__p"))
    return both.withColumn("__rn", first).where("__rn = 1").drop("__rn", "__p")
