"""Nearest neighbours and near-duplicate links between vectors, in tiles of bounded size.

Rows are dealt to tiles, packed, and pairs of tiles are compared in one task. Products of
matrices in single precision, whose error is bounded, leave few pairs of rows; their distances
are added up in double precision. Only the k best of each row, the pairs under the threshold,
or the chains they form leave a task. For the k best each tile is compared with itself first:
what is farther than a row's k best of its own tile is of no use in the others, so one product
serves both tiles of a pair. All are exact within what is compared: everything for one block,
or rows that share a block where a blocking is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import doubles
from ..functions.storage import discard, materialize

TILE = 32768
LEAST_TILE = 2048  # up to eight tiles are made of smaller ones, so that there are pairs for all cores
LEAST_BLOCK_TILE = 8192  # the same within a block, as blocks are compared beside each other
PACK_ROWS = 65536
ROWS, COLUMNS = 512, 512  # of a product of matrices
LINKS = 1 << 18  # rows of links that leave a task at once
HELD = 1 << 21  # pairs whose distances are added up at once
COPIES = 1 << 16  # rows from which on it is worth looking for copies


# --- tiles ------------------------------------------------------------------------------------

_PACKED = "__block long, tile int, tiles int, n int, id binary, v binary, p binary, of binary, apart binary"
_KINDS = {"id": np.int64, "v": np.float64, "p": np.float64, "of": np.bool_, "apart": np.int64}


def _bytes(x: np.ndarray, kind: type) -> bytes:
    """x packed, with a first byte that tells whether doubles that single precision holds are kept in it."""
    x = np.ascontiguousarray(x, kind)
    if kind is np.float64:
        with np.errstate(over="ignore", invalid="ignore"):
            short = x.astype(np.float32)
        if (short == x).all():
            return b"\1" + short.tobytes()
    return b"\0" + x.tobytes()


def _array(x: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(x, np.float32 if x[0] else kind, offset=1).astype(kind, copy=False).reshape(n, -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (__block, tile, tiles, id, v, p, of, apart) -> a row for each block and tile with all its rows' values."""
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def numpy(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for c in ("__block", "tile", "tiles", *_KINDS):
            column = batch.column(batch.schema.get_field_index(c))
            if pa.types.is_list(column.type):
                out[c] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            else:
                out[c] = column.to_numpy(zero_copy_only=False)
        return out

    def flush(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        order = np.lexsort((x["tile"], x["__block"]))
        block, tile = x["__block"][order], x["tile"][order]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (tile[1:] != tile[:-1])])
        groups = np.split(order, starts[1:])
        columns = [[int(x["__block"][g[0]]) for g in groups], [int(x["tile"][g[0]]) for g in groups], [int(x["tiles"][g[0]]) for g in groups], [len(g) for g in groups]]
        columns += [[_bytes(x[c][g], kind) for g in groups] for c, kind in _KINDS.items()]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * len(_KINDS)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(numpy(batch))
            n += batch.num_rows
        if n >= PACK_ROWS:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _rows_of(chunks: pd.DataFrame) -> dict[str, np.ndarray]:
    """The rows of a tile by id, from its packed pieces; in the same order in every task."""
    x = {c: np.concatenate([_array(b, kind, n) for b, n in zip(chunks[c], chunks.n)]) for c, kind in _KINDS.items()}
    x = {c: v if c in "vp" else v[:, 0] for c, v in x.items()}
    if (x["id"][1:] > x["id"][:-1]).all():
        return x
    order = np.argsort(x["id"], kind="stable")
    if (np.diff(x["id"][order]) == 0).any():  # repeated ids
        order = np.lexsort((x["apart"], x["of"], *x["v"].T[::-1], x["id"]))
    return {c: v[order] for c, v in x.items()}


def _packed(rows: DataFrame, tile: int, block: str | None) -> tuple[DataFrame, int | None]:
    """rows: id, v, and optionally p, of, apart and the block -> packed pieces of tiles, and the number of tiles where there is one block."""
    have = set(rows.columns)
    rows = rows.select(
        (F.col(block) if block else F.lit(0)).cast("long").alias("__block"), F.col("id").cast("long").alias("id"), "v", *[F.col("p") if "p" in have else F.array().cast("array<double>").alias("p")],
        (F.coalesce("of", F.lit(False)) if "of" in have else F.lit(True)).alias("of"), (F.col("apart") if "apart" in have else F.lit(-1)).cast("long").alias("apart"),
    )
    n = F.count(F.lit(1))
    tiles = F.greatest(F.ceil(n / tile), F.least(F.lit(8), F.ceil(n / min(tile, LEAST_BLOCK_TILE if block else LEAST_TILE)))).cast("int")
    held = None
    if block:
        placed = rows.join(rows.groupBy("__block").agg(tiles.alias("tiles")), "__block")
    else:
        held = max(rows.agg(tiles.alias("tiles")).first().tiles, 1)
        placed = rows.withColumn("tiles", F.lit(held))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    return placed.select("__block", "tile", "tiles", *_KINDS).mapInArrow(_pack, _PACKED), held


def _dealt(df: DataFrame, held: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition and in a row; one task for each tile, or for each pair of tiles, of a single block."""
    parts = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if held is None:
        df = df.repartition(parts, "__block", *keys)
    elif len(keys) == 1:
        df = df.repartitionById(min(held, 4000), F.pmod(keys[0], F.lit(min(held, 4000))))
    else:
        parts = min(held * (held + 1) // 2, 4000)
        df = df.repartitionById(parts, F.pmod(F.expr("ti * bigint(2 * {0} - ti - 1) div 2 + tj".format(held)), F.lit(parts)).cast("int"))
    return df.sortWithinPartitions("__block", *keys)


def _with_others(packed: DataFrame) -> DataFrame:
    """Each tile once for each tile of its block, as one of the pair ti <= tj."""
    return packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))


def _by_key(keys: list[str], one: Callable) -> Callable:
    """one(key, rows) yields frames for all rows of a key, which follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pieces = None, []
        for batch in batches:
            for k, piece in batch.groupby(keys, sort=True):
                if k != key and pieces:
                    yield from one(key, pd.concat(pieces))
                    pieces = []
                key = k
                pieces.append(piece)
        if pieces:
            yield from one(key, pd.concat(pieces))

    return run


def _on_pairs(rows: DataFrame, tile: int, block: str | None, compare: Callable, schema: str) -> DataFrame:
    """compare(block, ti, tj, rows of ti, rows of tj) yields frames, for each pair ti <= tj of tiles of a block. rows: as for _packed()."""
    packed, held = _packed(rows, tile, block)

    def one(key: tuple, chunks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b, ti, tj = key
        a = _rows_of(chunks[chunks.tile == ti])
        c = a if ti == tj else _rows_of(chunks[chunks.tile == tj])
        yield from (f for f in compare(b, ti, tj, a, c) if len(f))

    met = _dealt(_with_others(packed).drop("other", "tiles"), held, "ti", "tj")
    return met.mapInPandas(_by_key(["__block", "ti", "tj"], one), schema)


# --- distances --------------------------------------------------------------------------------

def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x[i] and y[j], added up component by component."""
    out = np.empty(len(i))
    for k in range(0, len(i), 4096):
        diff = x[i[k : k + 4096]] - y[j[k : k + 4096]]
        diff *= diff
        # sums along the first axis go row by row
        out[k : k + 4096] = np.sqrt(np.add.reduce(np.ascontiguousarray(diff.T), axis=0))
    return out


def _quick(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x[i] and y[j], whose sums are added up in any order: off by no more than _slip() of theirs."""
    out, n = np.empty(len(i)), min(1024, len(i))
    p, q = np.empty((n, x.shape[1])), np.empty((n, x.shape[1]))
    for k in range(0, len(i), 1024):
        a, b = i[k : k + 1024], j[k : k + 1024]
        diff, other = p[: len(a)], q[: len(a)]
        np.take(x, a, axis=0, out=diff, mode="clip")
        np.take(y, b, axis=0, out=other, mode="clip")
        diff -= other
        np.einsum("ij,ij->i", diff, diff, out=out[k : k + 1024])
    return np.sqrt(out, out=out)


def _slip(x: np.ndarray) -> float:
    """Two orders of adding as many squares as x has columns differ by a smaller share."""
    return (x.shape[1] + 8) * 2.0**-52


def _rounded(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, digits: int) -> np.ndarray:
    """_exact() rounded to digits; component by component only where another order could round to another value."""
    d = _quick(x, y, i, j)
    with np.errstate(over="ignore", invalid="ignore"):
        at = d * 10.0**digits
        unsure = np.flatnonzero(~(np.abs(at - np.floor(at) - 0.5) > at * (2 * _slip(x))))
    d = np.round(d, digits)
    if len(unsure):
        d[unsure] = np.round(_exact(x, y, i[unsure], j[unsure]), digits)
    return d


class _Products:
    """Squared distances of x and y in single precision, divided by scale ** 2, and off by no more than slack."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        centre = y.mean(0) if len(y) else np.zeros(y.shape[1])
        x, y = x - centre, y - centre
        most = max(np.abs(z).max(initial=0.0) for z in (x, y)) * np.sqrt(x.shape[1])
        self.scale = float(most) if np.isfinite(most) and most > 0 else 1.0
        x, y = x / self.scale, y / self.scale  # no longer than 1
        self.x = np.hstack([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))]).astype(np.float32)
        self.y = np.hstack([-2 * y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).astype(np.float32)
        norms = np.sqrt((x * x).sum(1).max(initial=0.0)) + np.sqrt((y * y).sum(1).max(initial=0.0))
        # each of the d + 2 terms rounds once when it is made and once when it is added; infinite values leave all pairs in
        self.slack = float((x.shape[1] + 16) * 2.0**-24 * norms * norms) if np.isfinite(norms) else np.inf

    def near(self, x_most: np.ndarray, y_most: np.ndarray | None = None, differ: tuple[np.ndarray, np.ndarray] | None = None, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """i, j, squared distance: all pairs not farther than i's entry in x_most or j's in y_most, and some more. differ: values that must not be equal; half: x and y are the same rows with the same entries, and a pair is given one way only."""
        # rows of like bounds stand together, so a block needs one comparison with the greatest
        xs = np.argsort(x_most, kind="stable").astype(np.int32)
        ys = np.arange(len(self.y), dtype=np.int32) if y_most is None else np.argsort(y_most, kind="stable").astype(np.int32)
        x, y = self.x[xs], self.y[ys]
        # the same memory for all products; new arrays of this size would cost as much as the product
        held, hits = np.empty(ROWS * COLUMNS, np.float32), np.zeros(ROWS * COLUMNS, bool)
        for k in range(0, len(x), ROWS):
            for c in range(k if half else 0, len(y), COLUMNS):
                rows, cols = xs[k : k + ROWS], ys[c : c + COLUMNS]
                n = len(rows) * len(cols)
                d, hit = held[:n].reshape(len(rows), -1), hits[:n].reshape(len(rows), -1)
                np.matmul(x[k : k + ROWS], y[c : c + COLUMNS].T, out=d)
                if np.isfinite(self.slack):
                    np.less_equal(d, x_most[rows[-1]] if y_most is None else max(x_most[rows[-1]], y_most[cols[-1]]), out=hit)
                else:
                    hit.fill(True)
                if differ is not None:
                    hit &= differ[0][rows, None] != differ[1][None, cols]
                if half and c == k:
                    hit &= np.arange(len(rows))[:, None] < np.arange(len(cols))
                hits[n:] = False
                at = np.flatnonzero(hits.view(np.uint64) != 0)  # eight at once, as few are set
                at = (at[:, None] * 8 + np.arange(8))[hits.reshape(-1, 8)[at]] if len(at) * 16 < n else np.flatnonzero(hits)
                if len(at):
                    i, j = np.divmod(at, len(cols))
                    yield rows[i], cols[j], held[at]


def _close(x: np.ndarray, y: np.ndarray, most: float, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]:
    """i, j, squared distance, its slack and the scale: all pairs that may be nearer than most. half: x and y are the same rows, and a pair is given one way only."""
    p = _Products(x, y)
    limit = (most / p.scale) ** 2 * (1 + 1e-6) + p.slack
    for i, j, d in p.near(np.full(len(x), limit, np.float32), half=half):
        yield i, j, d, p.slack, p.scale


def _first_per_row(row: np.ndarray, k: int) -> np.ndarray:
    """Whether each entry of sorted rows is one of its row's first k."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k


def _ordered(row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by (row, d, id); ids are only sorted where distances tie."""
    if len(row) and 0 <= row.min() and row.max() < 1 << 16:
        order = np.argsort(d)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # by counting
    else:
        order = np.lexsort((d, row))
    r, e = row[order], d[order]
    tie = (r[1:] == r[:-1]) & (e[1:] == e[:-1])
    if tie.any():
        at = np.flatnonzero(np.r_[False, tie] | np.r_[tie, False])
        order[at] = order[at][np.lexsort((ids[order[at]], e[at], r[at]))]
    return order


class _Best:
    """The k nearest of each row of a among the rows of b, by (distance rounded to `digits`, id), as far as they are not beyond the row's bound."""

    def __init__(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], k: int, digits: int, bound: np.ndarray | None = None):
        self.a, self.b, self.k, self.digits = a, b, k, digits
        self.bound = np.full(len(a["id"]), np.inf) if bound is None else bound.copy()
        self.i, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.n = [], 0

    def most(self, p: _Products) -> np.ndarray:
        """Squared distances as p has them, beyond which pairs are of no use."""
        with np.errstate(over="ignore"):
            return (((self.bound + 10.0**-self.digits) / p.scale) ** 2 * (1 + 1e-6) + p.slack).astype(np.float32)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, p: _Products) -> None:
        """d: squared distances as p has them."""
        self.new.append((i, j, d))
        self.n += len(i)
        if self.n > HELD:
            self.settle(p)

    def _tighten(self, i: np.ndarray, d: np.ndarray, p: _Products) -> None:
        """Bounds from each row's k-th of the squared distances d, as p has them."""
        # distances are ordered as the integers that have their bits
        key = np.sort((i.astype(np.uint64) << np.uint64(32)) | np.maximum(d, 0).astype(np.float32).view(np.uint32))
        row = (key >> np.uint64(32)).astype(np.int64)
        last = np.searchsorted(row, np.arange(len(self.bound)), "left") + self.k - 1
        full = np.flatnonzero(last < np.searchsorted(row, np.arange(len(self.bound)), "right"))
        kth = (key[last[full]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32).astype(float) + p.slack
        self.bound[full] = np.minimum(self.bound[full], np.sqrt(kth) * p.scale * (1 + 1e-6) + 10.0**-self.digits)

    def settle(self, p: _Products) -> None:
        if not self.n:
            return
        i, j, d = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.n = [], 0
        other = np.flatnonzero(self.a["id"][i] != self.b["id"][j])
        i, j, d = i[other], j[other], d[other]
        if np.isfinite(p.slack) and len(i) > 2 * self.k * len(self.bound):
            self._tighten(i, d, p)
            near = np.flatnonzero(d <= self.most(p)[i])
            i, j = i[near], j[near]
        d = _rounded(self.a["v"], self.b["v"], i, j, self.digits)
        near = np.isfinite(d) & (d <= self.bound[i])
        i, j, d = (np.concatenate(x) for x in ((self.i, i[near]), (self.j, j[near]), (self.d, d[near])))
        order = _ordered(i, d, self.b["id"][j])
        order = order[_first_per_row(i[order], self.k)]
        self.i, self.j, self.d = i[order], j[order], d[order]
        full = np.flatnonzero(np.bincount(self.i, minlength=len(self.bound)) == self.k)
        self.bound[full] = np.minimum(self.bound[full], self.d[np.searchsorted(self.i, full, "right") - 1])


def _others(x: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Places of the rows that can stand in lists of k: of eligible rows alike no list holds more than the first k, besides the row itself."""
    of = np.flatnonzero(x["of"])
    if len(of) <= k or (np.diff(x["id"][of]) == 0).any():
        return of
    alike = np.ascontiguousarray(np.hstack([x["v"][of], x["apart"][of, None].astype(float)]))
    group = np.unique(alike.view(np.dtype((np.void, alike.itemsize * alike.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    return of[np.sort(order[_first_per_row(group[order], k + 1)])]


def _nearest(a: dict[str, np.ndarray], b: dict[str, np.ndarray], k: int, digits: int, apart: bool, bound: np.ndarray | None = None) -> _Best:
    """Lists of the rows of a. Without bounds, the first columns give some; where a and b are the same rows, one product serves both ends of a pair."""
    best = _Best(a, b, k, digits, bound)
    if not len(a["id"]) or not len(b["id"]):
        return best
    p = _Products(a["v"], b["v"])
    differ = (a["apart"], b["apart"]) if apart else None
    if bound is None:
        width = min(max(2 * COLUMNS, 8 * k, len(b["id"]) // 8), len(b["id"]))
        if width > k and np.isfinite(p.slack):
            # the k-th of the first columns, besides the row itself
            for at in range(0, len(a["id"]), ROWS):
                d = p.x[at : at + ROWS] @ p.y[:width].T
                for c in ("id", "apart") if apart else ("id",) if (np.diff(b["id"]) == 0).any() else ():
                    d[a[c][at : at + ROWS, None] == b[c][None, :width]] = np.inf
                kth = np.maximum(np.partition(d, k, axis=1)[:, k].astype(float) + p.slack, 0)
                best.bound[at : at + ROWS] = np.sqrt(kth) * p.scale * (1 + 1e-6) + 10.0**-digits
    most = best.most(p)
    if a is b:
        for i, j, d in p.near(most, most, differ, half=True):
            one, two = np.flatnonzero(~(d > most[i])), np.flatnonzero(~(d > most[j]))
            best.add(i[one], j[one], d[one], p)
            best.add(j[two], i[two], d[two], p)
    else:
        for i, j, d in p.near(most, None, differ):
            keep = np.flatnonzero(~(d > most[i]))
            best.add(i[keep], j[keep], d[keep], p)
    best.settle(p)
    return best


def _nearest_both(a: dict[str, np.ndarray], b: dict[str, np.ndarray], k: int, digits: int, apart: bool, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[_Best, _Best]:
    """Lists of the rows of a among those of b and the other way round, by one product."""
    best, back = _Best(a, b, k, digits, bounds[0]), _Best(b, a, k, digits, bounds[1])
    if not len(a["id"]) or not len(b["id"]):
        return best, back
    p = _Products(a["v"], b["v"])
    x_most, y_most = best.most(p), back.most(p)
    for i, j, d in p.near(x_most, y_most, (a["apart"], b["apart"]) if apart else None):
        one, two = np.flatnonzero(~(d > x_most[i])), np.flatnonzero(~(d > y_most[j]))
        best.add(i[one], j[one], d[one], p)
        back.add(j[two], i[two], d[two], p)
    best.settle(p)
    back.settle(p)
    return best, back


_LISTS = "__block long, tile int, id binary, at binary, j binary, d binary"


def _as_lists(block: int, tile: int, best: _Best, others: np.ndarray, ids: np.ndarray | None = None) -> pd.DataFrame:
    return pd.DataFrame({"__block": [block], "tile": [tile], "id": [None if ids is None else ids.tobytes()], "at": [best.i.astype(np.int32).tobytes()], "j": [others[best.j].tobytes()], "d": [best.d.tobytes()]})


def _merge_lists(k: int, far: bool = False) -> Callable:
    """Lists of a tile's rows -> i, j, d, rank, and far (the row's last distance) if asked for; beside the k best of each row a task holds one batch of lists."""

    def best(at: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        order = _ordered(at, d, j)
        order = order[_first_per_row(at[order], k)]
        return at[order], j[order], d[order]

    def out(held: tuple[np.ndarray, ...], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, d = ids[held[0]], held[1], held[2]
        if (np.diff(ids) == 0).any():  # repeated ids share a list
            i, j, d = best(i, j, d)
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1 if len(i) else i
        for s in range(0, len(i), PACK_ROWS):
            cut = slice(s, s + PACK_ROWS)
            last = [d[np.searchsorted(i, i[cut], "right") - 1]] if far else []
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i[cut], j[cut], d[cut], rank[cut].astype(np.int32), *last)], names=["i", "j", "d", "rank", "far"][: 4 + far])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, new, n, kth = None, None, None, [], 0, None

        def settle() -> None:
            nonlocal held, new, n, kth
            held, new, n = best(*(np.concatenate(x) for x in zip(held, *new))), [], 0
            size = int(held[0].max(initial=-1)) + 1
            full = np.flatnonzero(np.bincount(held[0], minlength=size) == k)
            kth = np.full(size, np.inf)
            kth[full] = held[2][np.searchsorted(held[0], full, "right") - 1]

        for batch in batches:
            for r in range(batch.num_rows):
                block, tile, own, at, j, d = (batch.column(c)[r].as_py() for c in range(6))
                if key != (block, tile):
                    if key is not None:
                        settle()
                        yield from out(held, ids)
                    key, ids, held, new, n, kth = (block, tile), None, (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)), [], 0, None
                ids = np.frombuffer(own, np.int64) if own is not None else ids
                x = np.frombuffer(at, np.int32), np.frombuffer(j, np.int64), np.frombuffer(d)
                if kth is not None:
                    known = x[0] < len(kth)
                    use = ~known
                    use[known] = x[2][known] <= kth[x[0][known]]
                    x = tuple(c[use] for c in x)
                new.append(x)
                n += len(x[0])
                if n > 2 * len(held[0]):
                    settle()
        if key is not None:
            settle()
            yield from out(held, ids)

    return run


def _keyed(rows: DataFrame) -> DataFrame:
    """rows: id, v -> id, key (a digest of the vector), finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            keys = [hashlib.sha256(x).digest() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(np.isfinite(v).all(1))], names=["id", "key", "finite"])

    return rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, key binary, finite boolean")


def _copied(keyed: DataFrame) -> bool:
    """Whether a quarter or more of the rows are copies. Rows with repeated ids are left as they are."""
    n = keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("key").alias("kinds")).first()
    return n.rows == n.ids and 4 * n.kinds <= 3 * n.rows


def _knn_of_kinds(rows: DataFrame, keyed: DataFrame, k: int, tile: int, digits: int, far: bool) -> DataFrame:
    """knn() by the vectors that differ: only the first row of each kind is compared with others.

    A kind's k nearest kinds, by (distance, least id), and its own copies hold its rows' k
    nearest: each of those kinds has a row that comes before all of any later kind. No list
    holds more than the first k of a kind, besides the row itself.
    """
    kinds = keyed.groupBy("key").agg(F.min("id").alias("kind"))
    member = keyed.join(kinds, "key").select("id", "kind", "finite")
    near = knn(rows.join(kinds.select(F.col("kind").alias("id")), "id", "left_semi"), k, tile, digits, copies=None)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    heads = member.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("kind").agg(F.collect_list("id").alias("ids"), F.first("finite").alias("finite"))
    own = heads.where("finite").select(F.col("kind").alias("i"), F.lit(0.0).alias("d"), "ids")
    met = near.select("i", "d", F.col("j").alias("kind")).join(heads.select("kind", "ids"), "kind").select("i", "d", "ids").unionByName(own)
    entries = met.select("i", F.transform("ids", lambda x: F.struct(F.col("d").alias("d"), x.alias("j"))).alias("of"))
    best = entries.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("of"))), 1, k + 1).alias("best"))
    lists = member.join(best, F.col("kind") == F.col("i")).select("id", F.slice(F.filter("best", lambda x: x["j"] != F.col("id")), 1, k).alias("best"))
    last = [F.element_at("best", -1)["d"].alias("far")] if far else []
    found = lists.where(F.size("best") > 0).select(F.col("id").alias("i"), F.posexplode("best").alias("at", "e"), *last)
    return found.select("i", F.col("e.j").alias("j"), F.col("e.d").alias("d"), (F.col("at") + 1).alias("rank"), *(["far"] if far else []))


def knn(df: DataFrame, k: int = 12, tile: int = TILE, digits: int = 9, block: str | None = None, of: str | None = None, apart: str | None = None, far: bool = False, copies: int | None = COPIES) -> DataFrame:
    """df: id, v. i, j, d, rank: each row's k nearest others by (distance rounded to `digits`, id). of: a boolean column that the others must have set; apart: an integer column in which they must differ; far: adds the last distance of the row's list (without blocks). copies: of so many rows or more, equal vectors are compared once, if many are equal; None: never."""
    if far and block:
        raise ValueError("far is not known within blocks")
    rows = df.select("id", doubles("v").alias("v"), *([F.col(of).alias("of")] if of else []), *([F.col(apart).cast("long").alias("apart")] if apart else []), *([block] if block else []))
    if copies is not None and not (block or of or apart) and rows.count() >= copies:
        keyed = _keyed(rows)
        if _copied(keyed):
            return _knn_of_kinds(rows, keyed, k, tile, digits, far)
    packed, held = _packed(rows, tile, block)
    differ = apart is not None
    take = lambda x, places: {c: v[places] for c, v in x.items()}

    def alone(key: tuple, chunks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = _rows_of(chunks)
        others = _others(x, k)
        best = _nearest(x, x if len(others) == len(x["id"]) else take(x, others), k, digits, differ)
        lists = _as_lists(*key, best, x["id"][others], x["id"])
        # bounds of rows with full lists only
        bound = np.where(np.bincount(best.i, minlength=len(x["id"])) == k, best.bound, np.inf)
        packs = {c: [_bytes(x[c], kind)] for c, kind in _KINDS.items()}
        yield lists.assign(tiles=int(chunks.tiles.iloc[0]), n=len(x["id"]), own=lists.id, **packs, can=others.astype(np.int32).tobytes(), bound=bound.tobytes())

    def together(key: tuple, chunks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b, ti, tj = key
        if ti == tj:
            yield chunks[["__block", "tile", "own", "at", "j", "d"]].rename(columns={"own": "id"})
            return
        (x, cx, bx), (y, cy, by) = ((_rows_of(c), np.frombuffer(c.can.iloc[0], np.int32), np.frombuffer(c.bound.iloc[0])) for c in (chunks[chunks.tile == t] for t in (ti, tj)))
        if len(cx) == len(x["id"]) and len(cy) == len(y["id"]):
            best, back = _nearest_both(x, y, k, digits, differ, (bx, by))
        else:
            best, back = _nearest(x, take(y, cy), k, digits, differ, bx), _nearest(y, take(x, cx), k, digits, differ, by)
        yield _as_lists(b, ti, best, y["id"][cy])
        yield _as_lists(b, tj, back, x["id"][cx])

    first = _dealt(packed, held, "tile").mapInPandas(_by_key(["__block", "tile"], alone), f"{_PACKED}, own binary, at binary, j binary, d binary, can binary, bound binary")
    met = _with_others(first)
    met = met.select("__block", "tile", "ti", "tj", "n", *_KINDS, "can", "bound", *[F.when(F.col("ti") == F.col("tj"), F.col(c)).alias(c) for c in ("own", "at", "j", "d")])
    lists = _dealt(met, held, "ti", "tj").mapInPandas(_by_key(["__block", "ti", "tj"], together), _LISTS)
    found = _dealt(lists, held, "tile").mapInArrow(_merge_lists(k, far), "i long, j long, d double, rank int" + ", far double" * far)
    return found if block is None else _best_per_row(found.select("i", "j", "d"), k)


def _best_per_row(found: DataFrame, k: int) -> DataFrame:
    """i, j, d of several lists of a row -> i, j, d, rank: its k best."""

    def best(x: list[np.ndarray]) -> list[np.ndarray]:
        row = np.cumsum(np.r_[0, x[0][1:] != x[0][:-1]])
        order = _ordered(row, x[2], x[1])
        i, j, d, row = x[0][order], x[1][order], x[2][order], row[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (j[1:] != j[:-1])]  # not again what several blocks hold
        i, j, d, row = i[once], j[once], d[once], row[once]
        use = _first_per_row(row, k)
        i, j, d, row = i[use], j[use], d[use], row[use]
        return [i, j, d, (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)]

    return _per_row(found, best, "i long, j long, d double, rank int")


def knn_of_block(asked: DataFrame, rows: DataFrame, k: int, block: str, tile: int = TILE, digits: int = 9) -> DataFrame:
    """asked: id, v, block; rows: id, v, block (a whole number): i, j, d, rank, each asked row's k nearest other rows of the block it names, however far, as knn() orders them. An id is asked for one block."""

    def compare(_, ti: int, tj: int, x: dict, y: dict) -> Iterator[pd.DataFrame]:
        for a, b in ((x, y), (y, x))[: 1 + (ti != tj)]:
            ask, others = ~a["of"], _others(b, k)
            best = _nearest({c: v[ask] for c, v in a.items()}, {c: v[others] for c, v in b.items()}, k, digits, False)
            yield pd.DataFrame({"i": a["id"][ask][best.i], "j": b["id"][others][best.j], "d": best.d})

    met = [df.where(F.col(block).isNotNull()).select("id", doubles("v").alias("v"), block, F.lit(of).alias("of")) for df, of in ((asked, False), (rows, True))]
    return _best_per_row(_on_pairs(met[0].unionByName(met[1]), tile, block, compare, "i long, j long, d double"), k)


def _per_row(df: DataFrame, of: Callable[[list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """of: columns of df's rows -> columns of the schema; it gets all rows of an i, df's first column, at once, and those of many."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in of(x)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = x if held is None else [np.concatenate(c) for c in zip(held, x)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last one may go on in the next batch
            if cut:
                yield whole([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield whole(held)

    return df.repartition("i").sortWithinPartitions("i").mapInArrow(run, schema)


def _half_up(x: float, digits: int) -> float:
    """x rounded as F.round() does: halves of its shortest decimal form go up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if np.isfinite(x) else x


def near_links(df: DataFrame, most: float, blocks: str | None = None, tile: int = TILE, scale: float = 1.0, weights: tuple[float, float] = (1.0, 0.0), params: str | None = None, param_scale: float = 1.0, ranges: list[float] | None = None, digits: int | None = None) -> DataFrame:
    """df: id, v and optionally params (array) and blocks (array of the blocks a row belongs to).

    a < b, d: pairs that share a block and whose distance is under `most`, each once. d is
    w0 * |v - v'| / scale + w1 * P / param_scale, P the mean range-normalised difference of
    the params; the second term is only computed where the first is under `most`. digits: d is
    rounded to them, halves upwards as by F.round().
    """
    cols = ["id", doubles("v").alias("v"), *([doubles(params).alias("p")] if params else [])]
    rows = df.select(*cols, *([F.explode(blocks).alias("__b")] if blocks else []))
    w0, w1 = weights
    span = None if ranges is None else np.array(ranges, float)
    reach = most * scale / w0 if w0 else np.inf

    def extra(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for k in range(0, len(i), 4096):
            out[k : k + 4096] = (np.abs(x["p"][i[k : k + 4096]] - y["p"][j[k : k + 4096]]) / span).mean(1)
        return w1 * out / param_scale

    def least(x: dict, y: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
        """No more than the second term, in single precision."""
        if not params or w1 < 0 or not len(x["id"]) or not len(y["id"]):
            return None
        a, b = (w1 * t["p"] / span / t["p"].shape[1] / param_scale for t in (x, y))
        size = float(np.abs(a).max(0).sum() + np.abs(b).max(0).sum())
        if not size < 1e30:
            return None
        short = a.astype(np.float32), b.astype(np.float32)
        slack = (a.shape[1] + 8) * 2.0**-23 * size

        def low(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            diff = short[0][i]
            diff -= short[1][j]
            return np.abs(diff, out=diff).sum(1) - slack

        return low

    def compare(_, ti: int, tj: int, x: dict, y: dict) -> Iterator[pd.DataFrame]:
        low, slip, held, n = least(x, y), 8 * _slip(x["v"]), [], 0

        def out() -> pd.DataFrame:
            a, b, d = (np.concatenate(c) for c in zip(*held))
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d})

        for i, j, d2, slack, scale_of in _close(x["v"], y["v"], reach, ti == tj):
            use = x["id"][i] != y["id"][j]
            if low is not None and np.isfinite(slack):
                first = np.sqrt(np.maximum(d2 - slack, 0)) * (w0 * scale_of / scale)
                use &= ~(first + low(i, j) > most * (1 + 1e-5))
            i, j = i[use], j[use]
            d0 = w0 * (_exact if digits is None else _quick)(x["v"], y["v"], i, j) / scale
            second = extra(x, y, i, j) if params else 0.0
            d = d0 + second
            if digits is not None:
                with np.errstate(over="ignore", invalid="ignore"):
                    at = d * 10.0**digits
                    sure = (np.abs(d0 - most) > most * slip) & (np.abs(d - most) > most * slip) & (np.abs(at - np.floor(at) - 0.5) > at * slip)
                unsure = np.flatnonzero(~sure)
                exact = w0 * _exact(x["v"], y["v"], i[unsure], j[unsure]) / scale
                d0[unsure], d[unsure] = exact, exact + (second[unsure] if params else 0.0)
                whole, d = d, np.round(d, digits)
                d[unsure] = [_half_up(e, digits) for e in whole[unsure].tolist()]
                keep = (d0 < most) & (whole < most)
            else:
                keep = (d0 < most) & (d < most)
            held.append((x["id"][i[keep]], y["id"][j[keep]], d[keep]))
            n += len(held[-1][0])
            if n >= LINKS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    links = _on_pairs(rows, tile, "__b" if blocks else None, compare, "a long, b long, d double")
    return links.dropDuplicates(["a", "b"]) if blocks else links


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; root: each member's least one."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def chains(df: DataFrame, thresholds: list[float], tile: int = TILE) -> DataFrame:
    """df: id, v. a, b, d: edges that join the same rows as the links under each of the thresholds do, but no more of them than rows in a pair of tiles.

    d is the threshold before the one at which the edge joins them (0 for the least), so
    `d < t` gives the edges at t.
    """
    levels = sorted(set(thresholds))
    rows = df.select("id", doubles("v").alias("v"))

    def compare(_, ti: int, tj: int, x: dict, y: dict) -> Iterator[pd.DataFrame]:
        ids = np.unique(np.concatenate([x["id"], y["id"]]))
        mine, theirs = np.searchsorted(ids, x["id"]), np.searchsorted(ids, y["id"])
        roots = [np.arange(len(ids)) for _ in levels]
        for i, j, d2, slack, scale in _close(x["v"], y["v"], levels[-1], ti == tj):
            for root, t in zip(roots, levels):
                limit = (t / scale) ** 2
                new = np.flatnonzero((root[mine[i]] != root[theirs[j]]) & ~(d2 > limit * (1 + 1e-6) + slack))
                unsure = ~(d2[new] < limit * (1 - 1e-6) - slack)
                keep = np.ones(len(new), bool)
                keep[unsure] = _exact(x["v"], y["v"], i[new[unsure]], j[new[unsure]]) < t
                _unite(root, mine[i[new[keep]]], theirs[j[new[keep]]])
        before = np.arange(len(ids))
        for t, root in zip([0.0, *levels], roots):
            a = np.unique(before)
            a = a[root[a] != a]
            yield pd.DataFrame({"a": ids[a], "b": ids[root[a]], "d": np.full(len(a), t)})
            before = root

    return _on_pairs(rows, tile, None, compare, "a long, b long, d double")


def nearest_centroids(vector: Column, centroids: list[tuple[int, list[float]]], keep: int = 2) -> Column:
    """Ids of the `keep` nearest of a bounded list of centroids, nearest first."""
    entries = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in centroids])
    distance = lambda e: F.aggregate(F.zip_with(vector, e["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(F.round(distance(e), 9).alias("d"), e["id"].alias("id"))))
    return F.transform(F.slice(ranked, 1, keep), lambda e: e["id"])


def kmeans_blocks(df: DataFrame, rows_per_block: int = 400, keep: int = 2, seed: int = 1, iterations: int = 40, sample: int = 50_000) -> DataFrame:
    """df with `blocks`: the nearest of ceil(n / rows_per_block) centroids, fitted by k-means on at most `sample` rows (16 for each centroid, if that is more)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    k = max(1, min(-(-n // rows_per_block), n))
    sample = max(sample, 16 * k)
    if k < 2:
        return df.withColumn("blocks", F.array(F.lit(0)))
    fitted = df if n <= sample else df.orderBy(F.xxhash64("id"), "id").limit(sample)
    model = KMeans(k=k, seed=seed, maxIter=iterations, tol=1e-4, featuresCol="features").fit(fitted.select(array_to_vector(doubles("v")).alias("features")))
    centres = df.sparkSession.sparkContext.broadcast(np.array(model.clusterCenters()))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x, c = np.stack(v.to_numpy()), centres.value
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :keep].astype(np.int32)))

    return df.withColumn("blocks", nearest(doubles("v")))


def inertia(df: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """One row: the sum of squared distances of all rows (id, v) to their nearest centroid of a bounded list."""
    distances = F.array(*[F.aggregate(F.zip_with(doubles("v"), F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d) for _, c in centroids])
    return df.agg(F.sum(F.array_min(distances)).alias("inertia"))


def neighbour_candidates(edges: DataFrame, new: str | None = None) -> DataFrame:
    """edges i -> j of a neighbour graph -> pairs (i, j), i < j, that share a neighbour or are one's neighbours' neighbours, and are not linked yet. new: a column that is 1 for edges that have not been looked at; a pair must come by way of one of them."""
    flag = F.col(new) if new else F.lit(1)
    both = edges.select("i", "j", flag.alias("new")).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), flag.alias("new"))).groupBy("i", "j").agg(F.max("new").alias("new"))
    first, second = both.select(F.col("j").alias("mid"), F.col("i").alias("a"), F.col("new").alias("n1")), both.select(F.col("i").alias("mid"), F.col("j").alias("b"), F.col("new").alias("n2"))
    hop = first.join(second, "mid").where("a < b AND n1 + n2 > 0").select(F.col("a").alias("i"), F.col("b").alias("j")).distinct()
    return hop.join(both.select("i", "j"), ["i", "j"], "left_anti")


def _meet(edges: DataFrame, graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """i, j, d, new (1): pairs that share a neighbour by way of a new edge and are near enough for one's list. The neighbours of a row meet in one task, so vectors travel with edges, not with pairs."""
    both = edges.select(F.col("j").alias("mid"), F.col("i").alias("id"), "new").unionByName(edges.select(F.col("i").alias("mid"), F.col("j").alias("id"), "new")).groupBy("mid", "id").agg(F.max("new").cast("int").alias("new"))
    # a row meets its neighbours too
    both = both.unionByName(rows.select(F.col("id").alias("mid"), "id", F.lit(0).alias("new")))
    kth = graph.groupBy("i").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("far"))
    known = rows.join(kth, F.col("id") == F.col("i"), "left").select("id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(x: list[np.ndarray]) -> pa.RecordBatch:
            mid, ids, new, far, v = x
            starts = np.flatnonzero(np.r_[True, mid[1:] != mid[:-1]])
            out = [[], [], []]
            for s, e in zip(starts, np.r_[starts[1:], len(mid)]):
                n = new[s:e].astype(bool)
                if not n.any():
                    continue
                a, b = np.nonzero(np.triu(n[:, None] | n[None, :], 1))
                d = np.round(_exact(v, v, a + s, b + s), 9)
                near = d <= np.maximum(far[a + s], far[b + s])
                for o, c in zip(out, (ids[a[near] + s], ids[b[near] + s], d[near])):
                    o.append(c)
            i, j, d = (np.concatenate(o) if o else np.zeros(0) for o in out)
            i, j = i.astype(np.int64), j.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(d.astype(float))], names=["i", "j", "d"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)] + [batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)]
            held = x if held is None else [np.concatenate(c) for c in zip(held, x)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last row's neighbours may go on in the next batch
            if cut:
                yield whole([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield whole(held)

    met = both.join(known, "id").select("mid", "id", "new", "far", "v").repartition("mid").sortWithinPartitions("mid")
    return met.mapInArrow(run, "i long, j long, d double").distinct().withColumn("new", F.lit(1))


def descent_knn(df: DataFrame, k: int = 12, passes: int = 12, start_block: int = 256, tolerance: float = 0.002, reverse: int = 36) -> DataFrame:
    """Approximate neighbours: exact ones inside k-means blocks, then passes over neighbours of neighbours until few lists change.

    A pass looks only at pairs that meet by an edge which the pass before has found. A row
    that many others have as a neighbour meets the nearest `reverse` of those, so no row's
    pairs grow with the table.
    """
    rows = materialize(df.select("id", doubles("v").alias("v")), "descent-rows")
    blocked = kmeans_blocks(rows, start_block).select("id", "v", F.explode("blocks").alias("block"))
    graph = materialize(knn(blocked, k, block="block").select("i", "j", "d", F.lit(1).alias("new")), "descent")
    n = rows.count()
    for _ in range(passes):
        back = F.row_number().over(Window.partitionBy("j").orderBy("d", "i"))
        found = _meet(graph.withColumn("back", back).where(F.col("back") <= reverse), graph, rows, k)
        merged = graph.withColumn("new", F.lit(0)).unionByName(found).unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), "d", "new"))
        # an edge that is known already may be found from its other end
        merged = merged.groupBy("i", "j").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
        better, before = materialize(merged.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "descent"), graph
        discard(before)
        graph = better
        if better.where("new = 1").count() <= tolerance * n * k:
            break
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return graph.select("i", "j", "d", rank.alias("rank"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found."""
    both = exact.select("i", "j", F.lit(1).alias("n"), F.lit(0).alias("hit")).unionByName(found.select("i", "j", F.lit(0).alias("n"), F.lit(1).alias("hit")))

    def count(x: list[np.ndarray]) -> list[np.ndarray]:
        i, j, n, hit = (c[np.lexsort((x[1], x[0]))] for c in x)
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        n = np.add.reduceat(n.astype(np.int64), starts)
        return [np.array([(n * np.maximum.reduceat(hit, starts)).sum()]), np.array([n.sum()])]

    counts = _per_row(both, count, "hits long, n long")
    return counts.agg((F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("recall"))


def purity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of neighbours that have the row's own label. labels: id, label."""
    own, other = labels.select(F.col("id").alias("i"), F.col("label").alias("li")), labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
    return graph.join(own, "i").join(other, "j").agg((F.count_if(F.col("li") == F.col("lj")) / F.count(F.lit(1))).alias("purity"))


def _weights(d: np.ndarray) -> np.ndarray:
    """Memberships of lists of one length, a row each: 1 up to the least positive distance rho, then exp(-(d - rho) / sigma), with the sigma that makes their sum log2 of the length."""
    n, k = d.shape
    if not k:
        return d
    rho = np.where((d > 0) & np.isfinite(d), d, np.inf).min(1)
    off = d - np.where(np.isfinite(rho), rho, 0.0)[:, None]
    lo, hi, sigma, w = np.zeros(n), np.full(n, np.inf), np.ones(n), np.ones((n, k))
    left = np.arange(n)
    for _ in range(64):
        x = off[left]
        w[left] = np.where(x <= 0, 1.0, np.exp(-np.maximum(x, 0) / sigma[left, None]))
        gap = w[left].sum(1) - np.log2(max(k, 1))
        go = np.abs(gap) >= 1e-5
        left, over = left[go], gap[go] > 0
        if not len(left):
            break
        lo[left], hi[left] = np.where(over, lo[left], sigma[left]), np.where(over, sigma[left], hi[left])
        sigma[left] = np.where(np.isfinite(hi[left]), (lo[left] + np.where(np.isfinite(hi[left]), hi[left], 0)) / 2, sigma[left] * 2)
    return w


def memberships(graph: DataFrame) -> DataFrame:
    """i, j, w: fuzzy memberships of neighbour lists, whose sum per row is log2 of their length (by bisection)."""
    lists = graph.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))  # k entries each

    @F.pandas_udf("array<double>")
    def weigh(near: pd.Series) -> pd.Series:
        out = np.empty(len(near), object)
        sizes = near.map(len).to_numpy()
        for n in np.unique(sizes):  # lists of a length together
            of = np.flatnonzero(sizes == n)
            d = np.array([*near.iloc[of]], float).reshape(len(of), n)
            out[of] = [*_weights(d)]
        return pd.Series(out)

    weighed = lists.select("i", "near", weigh(F.transform("near", lambda e: e["d"])).alias("w"))
    return weighed.select("i", F.explode(F.arrays_zip(F.transform("near", lambda e: e["j"]).alias("j"), "w")).alias("e")).select("i", F.col("e.j").alias("j"), F.col("e.w").alias("w"))


def fuzzy_union(directed: DataFrame) -> DataFrame:
    """a < b, w: both directions' weights as w + w' - w * w'."""
    pair = directed.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("s"), (F.max("w") * F.min("w")).alias("p"), F.count(F.lit(1)).alias("n"))
    return pair.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))
