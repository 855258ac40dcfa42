"""Faceted filters, representatives, picking by polygon or by distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import Query, matches


def is_mine(sources: Column) -> Column:
    """Items with a source outside any bundle, or without sources."""
    return (F.size(sources) == 0) | F.exists(sources, lambda s: s["bundle"].isNull())


def first_device(sources: Column) -> Column:
    tagged = F.filter(sources, lambda s: s["device"].isNotNull())
    return F.when(F.size(tagged) > 0, F.element_at(tagged, 1)["device"])


def category_of(category: Column, override: Column) -> Column:
    return F.coalesce(override, category)


def rating_facet(rating: Column, at_least: int | None = None, unrated: str = "any") -> Column:
    """unrated: "any" (at_least alone decides), "only", or "or" (rated well enough, or not at all)."""
    if unrated == "only":
        return rating.isNull()
    enough = F.lit(True) if at_least is None else F.coalesce(rating >= at_least, F.lit(False))
    return enough | rating.isNull() if unrated == "or" else enough


def facet_filter(df: DataFrame, predicates: Sequence[Column | None], query: Query | None = None, text: Column | None = None, only: bool = True, flag: str = "matched") -> DataFrame:
    """Rows that satisfy all facets; the text query filters too (only), or just marks rows in column `flag`."""
    kept = reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))
    df = df.where(kept)
    if query is None or not query.active or text is None:
        return df if only else df.withColumn(flag, F.lit(None).cast("boolean"))
    found = F.coalesce(matches(query, text), F.lit(False))
    return df.where(found) if only else df.withColumn(flag, found)


def collapse(df: DataFrame, representatives: DataFrame, key: str = "id", exempt: Column | None = None) -> DataFrame:
    """Rows that represent their cluster (representatives holds their keys), and those that are exempt."""
    marked = df.join(representatives.select(key).distinct().withColumn("__rep", F.lit(True)), key, "left")
    kept = F.coalesce(F.col("__rep"), F.lit(False))
    return marked.where(kept if exempt is None else kept | exempt).drop("__rep")


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: whether a ray to the right of (x, y) crosses the outline an odd number of times."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue  # a level edge is never crossed
        at = F.lit(x1) + (y - F.lit(y1)) * F.lit(x2 - x1) / F.lit(y2 - y1)
        crossings.append((((y < F.lit(max(y1, y2))) & (y >= F.lit(min(y1, y2)))) & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1


def nearest_pick(df: DataFrame, x: float, y: float, radius: float, key: str = "id") -> DataFrame:
    """The row nearest to (x, y) within radius, or none."""
    d2 = (F.col("x") - F.lit(x)) * (F.col("x") - F.lit(x)) + (F.col("y") - F.lit(y)) * (F.col("y") - F.lit(y))
    return df.withColumn("d2", d2).where(F.col("d2") < radius * radius).orderBy("d2", key).limit(1)
