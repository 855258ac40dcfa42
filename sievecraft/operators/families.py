"""Clusters of a link table: at one threshold, at two levels, over many, and their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .components import connected_components

# fixed values: lower ends of the size classes of a sweep
SIZE_CLASSES = (1, 2, 3, 5, 10, 50)


def clusters(ids: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """id, cluster (its least id) of all ids, under links with d < threshold."""
    linked = connected_components(links.where(F.col("d") < threshold))
    return ids.select("id").join(linked.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def two_levels(ids: DataFrame, links: DataFrame, family: float, merge: float) -> DataFrame:
    """id, merged, family. The merge threshold is never above the family's."""
    links = materialize(links.where(F.col("d") < family), "links")  # found once for both
    near, far = clusters(ids, links, min(merge, family)), clusters(ids, links, family)
    return near.withColumnRenamed("cluster", "merged").join(far.withColumnRenamed("cluster", "family"), "id")


def sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: clusters, singletons, largest, collapsed (rows that are not first of their cluster)."""
    n = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.sum(F.col("n") - 1).alias("collapsed"))


def sweep(ids: DataFrame, links: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, clusters, singletons, largest, and rows in clusters of each size class (in_1, in_2, in_3, in_5, in_10, in_50).

    From one threshold to the next only the links between them count, and only those that
    join two of the clusters so far.
    """
    links = materialize(links.select("a", "b", "d"), "links")
    now, before, rows = materialize(ids.select("id", F.col("id").alias("cluster")), "swept"), None, {}
    for t in sorted(set(thresholds)):
        named = lambda side: now.select(F.col("id").alias(side), F.col("cluster").alias(f"c{side}"))
        new = links.where(F.col("d") < t) if before is None else links.where((F.col("d") < t) & (F.col("d") >= before))
        joining = new.join(named("a"), "a").join(named("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        of = connected_components(joining)
        now = materialize(now.join(of, now["cluster"] == of["node"], "left").select("id", F.coalesce("component", "cluster").alias("cluster")), "swept")
        n = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        edges = list(zip(SIZE_CLASSES, [*SIZE_CLASSES[1:], None]))
        in_class = [F.sum(F.when((F.col("n") >= a) & (F.lit(True) if b is None else F.col("n") < b), F.col("n")).otherwise(0)).alias(f"in_{a}") for a, b in edges]
        rows[t] = n.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), *in_class).select(F.lit(float(t)).alias("threshold"), "*")
        before = t
    out = None
    for t in thresholds:
        out = rows[t] if out is None else out.unionByName(rows[t])
    return out


def sweep_zone(threshold, merge: float, family: float):
    """Whether a threshold lies in the merged, the family or the apart zone, with a little tolerance."""
    return F.when(threshold <= merge + 1e-9, "merged").when(threshold <= family + 1e-9, "family").otherwise("apart")


def representatives(labelled: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster, rep, members: the member nearest the mean of its cluster (the first by id on a tie)."""
    x = vectors.select("id", F.posexplode("v").alias("pos", "x")).join(labelled, "id")
    mean = x.groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    off = x.join(mean, ["cluster", "pos"]).groupBy("cluster", "id").agg(F.round(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), 9).alias("d2"))
    return off.groupBy("cluster").agg(F.min_by("id", F.struct("d2", "id")).alias("rep"), F.count(F.lit(1)).alias("members"))


def copies(labelled: DataFrame, counts: DataFrame) -> DataFrame:
    """id, cluster, in_cluster, copies (sum of n over the cluster). counts: id, n."""
    joined = labelled.join(counts, "id")
    total = joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("in_cluster"), F.sum("n").alias("copies"))
    return joined.join(total, "cluster").select("id", "cluster", "in_cluster", "copies")


def contenders(levels: DataFrame, reps: DataFrame) -> DataFrame:
    """family, id: each family's merged representatives, once. levels: id, merged, family; reps: cluster (merged), rep."""
    return levels.join(reps.select(F.col("cluster").alias("merged"), "rep"), "merged").select("family", F.col("rep").alias("id")).distinct()


def family_has_rating(levels: DataFrame, ratings: DataFrame) -> DataFrame:
    rated = levels.join(ratings.where("rating IS NOT NULL").select("id"), "id", "left_semi").select("family").distinct().withColumn("has", F.lit(True))
    return levels.select("id", "family").join(rated, "family", "left").select("id", "family", F.coalesce("has", F.lit(False)).alias("has_rating"))


def by_distance(center: DataFrame, members: DataFrame) -> DataFrame:
    """members (id, v) with their distance to the one row of center (v), nearest first."""
    d = F.sqrt(F.aggregate(F.zip_with("v", "__c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return members.withColumn("__c", center.limit(1).select("v").scalar()).select("id", d.alias("d")).orderBy(F.round("d", 9), "id")


def first_by(df: DataFrame, partition: str, *order) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where("__rn = 1").drop("__rn")
