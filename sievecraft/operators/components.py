"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps the components and brings every node nearer to its component's least node;
the number of rounds grows with the logarithm of the largest component. A hub's edges are
never gathered: a step takes each node's least neighbour by a combined minimum and joins it
back, and Spark can split the large side of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, files_for, materialize


EDGE_BYTES = 64


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """One step on edges (a, b) with a > b, distinct; the tables that it is done with go."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
    # written out, so that both sides of the join are plain exchanges, which Spark can split at a hub
    least = materialize(least, "least", files)
    joined = both.join(least, both["a"] == least["u"])
    if large:  # u's larger neighbours come to hang on the least of u and its neighbours
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # u and its smaller neighbours come to hang on the least of them
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    done = materialize(moved.where("a > b").distinct(), "edges", files)
    discard(least, edges)
    return done


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, which hangs on none: then those are their components' least nodes."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return not ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs + holds > 1").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """edges (a, b) of any one ordered type -> (node, component): the component is its least node.

    files: in how many files the distinct edges are written first, if their number is about
    known.
    Defined cases: loops are ignored, so a node that has only those is not returned; rows
    with a null end are ignored; repeated and reversed edges count once; no edges, no rows.
    """
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges", files)
    n = e.count()
    files = files_for(n, EDGE_BYTES)
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        e = _star(_star(e, True, files), False, files)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
