"""Exact top-k search: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size, queries to blocks of bounded size. Each shard's
ball tree is built once, over its vectors; a node's upper bound for a query q is q.centre +
|q| * radius. Nodes are visited in the order of their bounds, and a query leaves the shard
when the next bound is under its current k-th score. A task searches one shard for one block.
The k-th score is shared: in the first round a block meets one shard, in the next three more,
then twelve, and so on; after each round the best k so far of all shards set the score from
which the next round's searches start.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE = 1024.0
K = 10
SHARD_ROWS = 8192
#: Queries that are searched together: the unit that is sent to the shards.
QUERY_BLOCK = 2048
#: Each round a block has met so many times the shards that it had met before.
GROWTH = 4
LEAF = 64


class BallTree:
    """Balls over integer vectors. Scores are exact inner products in 64-bit integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.floats = self.vectors.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.least_id: list[int] = []
        if len(ids):
            self._grow(0, len(ids), leaf)
        self.centre = np.array(self.centres) if self.centres else np.zeros((0, vectors.shape[1]))
        self.radius = np.array(self.radii)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        stack = [(lo, hi, -1, False)]
        while stack:
            lo, hi, parent, right = stack.pop()
            x = self.floats[lo:hi]
            centre = x.mean(0)
            far = np.einsum("ij,ij->i", x - centre, x - centre)
            node = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(far.max())))
            self.least_id.append(int(self.ids[lo:hi].min()))
            if parent >= 0:
                a, b, left, r = self.nodes[parent]
                self.nodes[parent] = (a, b, left, node) if right else (a, b, node, r)
            if hi - lo <= leaf or far.max() == 0:
                continue
            # split between the point farthest from the centre and the one farthest from that
            p = x[int(far.argmax())]
            d = np.einsum("ij,ij->i", x - p, x - p)
            along = x @ (x[int(d.argmax())] - p)
            order = np.argsort(along, kind="stable")
            self.ids[lo:hi], self.vectors[lo:hi], self.floats[lo:hi] = self.ids[lo:hi][order], self.vectors[lo:hi][order], x[order]
            mid = (lo + hi) // 2
            stack += [(mid, hi, node, True), (lo, mid, node, False)]
        return 0

    def search(self, qid: int, q: np.ndarray, k: int, kth: int | None, exact_float: bool) -> list[tuple[int, int]]:
        """Up to k (score, id) at least as good as kth, best first: higher scores, then smaller ids. Rows with id qid are left out."""
        if not len(self.nodes):
            return []
        qf = q.astype(np.float64)
        bounds = self.centre @ qf + np.sqrt(qf @ qf) * self.radius
        bounds = np.floor(bounds + 1e-9 * np.abs(bounds) + 1e-6).tolist()
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            bound = -bound
            if kth is not None and bound < kth or len(best) == k and bound < best[0][0]:
                break  # no other node can hold a better one
            if len(best) == k and bound == best[0][0] and self.least_id[node] > -best[0][1]:
                continue
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            score = (self.floats[lo:hi] @ qf).astype(np.int64) if exact_float else _exact_scores(self.vectors[lo:hi], q)
            ids = self.ids[lo:hi]
            if kth is not None or len(best) == k:
                least = max(kth if kth is not None else best[0][0], best[0][0] if len(best) == k else -(2**63))
                at = np.flatnonzero(score >= least)
                score, ids = score[at], ids[at]
            if len(score) > k:  # of a leaf, only its own best k
                at = np.lexsort((ids, -score))[: k + 1]
                score, ids = score[at], ids[at]
            for s, i in zip(score.tolist(), ids.tolist()):
                if i == qid:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


    def to_bytes(self) -> bytes:
        return pickle.dumps((self.ids, self.vectors, self.nodes, self.centre, self.radius, self.least_id), protocol=5)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "BallTree":
        tree = cls.__new__(cls)
        tree.ids, tree.vectors, tree.nodes, tree.centre, tree.radius, tree.least_id = pickle.loads(raw)
        tree.floats = tree.vectors.astype(np.float64)
        return tree


def _exact_scores(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    return vectors @ q


_FOUND = "query_id long, vec_id long, score long"
_TREES = "dim int, shard int, tree binary"


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Rows take no part whose id or vector is null, or that hold a null or non-finite component."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 1), np.int64)


def _plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [int(key[0])], "shard": [int(key[1])], "tree": [BallTree(rows.vec_id.to_numpy(), _matrix(rows.v)).to_bytes()]})


def _search_block(k: int):
    """A block's queries in one shard's tree, each from its current k-th score, if it has one."""

    def run(key: tuple, trees: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(trees) and len(block):
            tree, q = BallTree.from_bytes(trees.tree.iloc[0]), _matrix(block.v)
            exact_float = float(np.abs(q).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * q.shape[1] < 2**52
            for qid, x, kth in zip(block.vec_id.tolist(), q, block.kth):
                rows += [(qid, i, s) for s, i in tree.search(qid, x, k, None if pd.isna(kth) else int(kth), exact_float)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product, ties to the smaller vec_id.

    candidates and queries: vec_id long, v array<long> (see quantize). A query's own row,
    that is any row with its id, is no candidate. Defined cases: with fewer candidates all
    are returned; equal vectors tie; rows whose vectors have another length than the query,
    such as empty ones, are not compared with it; repeated ids are candidates row by row;
    empty tables give no rows.
    """
    n_rows, n_queries = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // query_block))
    dim = F.size("v").alias("dim")
    rows = candidates.select("vec_id", "v", dim, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    trees = materialize(rows.groupBy("dim", "shard").applyInPandas(_plant, _TREES), "ball-trees")
    asked = materialize(queries.select("vec_id", "v", dim, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")), "search-queries")

    best, lo, hi = None, 0, 1
    while lo < shards:
        # block b meets shards b + lo to b + hi - 1, counted around
        turn = F.pmod(F.col("shard") - F.col("block"), F.lit(shards))
        mine = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where((turn >= lo) & (turn < hi))
        known = asked.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")
            known = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select(*asked.columns, "kth")
        theirs = known.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(lo), F.lit(min(hi, shards) - 1)), lambda i: F.pmod(F.col("block") + i, F.lit(shards)).cast("int"))))
        found = mine.groupBy("dim", "shard", "block").cogroup(theirs.groupBy("dim", "shard", "block")).applyInPandas(_search_block(k), _FOUND)
        # Spark limits each task's rows of a query to k before it deals them
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        ranked = (found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)).withColumn("rank", rank).where(F.col("rank") <= k)
        best, before = materialize(ranked, "search-best"), best
        discard(before)
        lo, hi = hi, hi * GROWTH
    discard(trees, asked)
    return best.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", **parameters) -> DataFrame:
    """search() of the rows whose id is divisible by `every` among all rows."""
    rows = quantize(vectors, id_col, vector_col)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k, **parameters)

