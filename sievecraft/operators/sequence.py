"""Inherently sequential numerics on bounded inputs: orders along a path, coverage orders, 2-D layouts.

Each runs in one Python task per group; callers bound the group (a selection of at most a few
hundred rows, or the points of one plot).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = 1 << 19  # pairs of points looked at at once


def _distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))


def path_length(x: np.ndarray, order: np.ndarray) -> float:
    return float(np.sqrt(((x[order[1:]] - x[order[:-1]]) ** 2).sum(1)).sum())


def nearest_path(d: np.ndarray, start: int, end: int) -> list[int]:
    """Always on to the nearest unvisited point, the end kept for last."""
    n = len(d)
    left = np.ones(n, bool)
    left[[start, end]] = False
    path = [start]
    while left.any():
        row = np.where(left, d[path[-1]], np.inf)
        path.append(int(row.argmin()))
        left[path[-1]] = False
    return path if end == start else [*path, end]


def _two_opt(path: list[int], d: np.ndarray, passes: int = 60) -> list[int]:
    for _ in range(passes):
        better = False
        p = np.array(path)
        for i in range(len(p) - 3):
            # turning p[i + 1 .. j] around replaces two steps
            j = np.arange(i + 2, len(p) - 1)
            gain = d[p[i], p[i + 1]] + d[p[j], p[j + 1]] - d[p[i], p[j]] - d[p[i + 1], p[j + 1]]
            k = int(gain.argmax())
            if gain[k] > 1e-6:
                p[i + 1 : j[k] + 1] = p[i + 1 : j[k] + 1][::-1]
                better = True
        path = p.tolist()
        if not better:
            break
    return path


def _or_opt(path: list[int], d: np.ndarray, passes: int = 4) -> list[int]:
    for _ in range(passes):
        better = False
        for size in (1, 2, 3):
            i = 1
            while i + size < len(path):
                run, rest = path[i : i + size], path[:i] + path[i + size :]
                saved = d[path[i - 1], run[0]] + d[run[-1], path[i + size]] - d[path[i - 1], path[i + size]]
                a, b = np.array(rest[:-1]), np.array(rest[1:])
                cost = np.stack([d[a, run[0]] + d[run[-1], b], d[a, run[-1]] + d[run[0], b]]) - d[a, b]
                way, at = np.unravel_index(int(cost.argmin()), cost.shape)
                if saved - cost[way, at] > 1e-6:
                    path = rest[: at + 1] + (run if way == 0 else run[::-1]) + rest[at + 1 :]
                    better = True
                i += 1
        if not better:
            break
    return path


def seriate(x: np.ndarray, category: np.ndarray, weight: float = 6.0, rounds: int = 6) -> np.ndarray:
    """A short path through the points; categories pull together. It starts with the most central point of the first category and ends with that of the last."""
    n = len(x)
    if n < 3:
        return np.arange(n)
    present = np.unique(category)
    y = np.hstack([x, (category * weight)[:, None]])
    centre = lambda c: (at := np.flatnonzero(category == c))[np.argmin(((x[at] - x[at].mean(0)) ** 2).sum(1))]
    start, end = int(centre(present[0])), int(centre(present[-1]))
    if start == end:
        end = int(np.argmax(((y - y[start]) ** 2).sum(1)))
    d = _distances(y)
    path = nearest_path(d, start, end)
    for _ in range(rounds):
        before = path
        path = _or_opt(_two_opt(path, d), d)
        if path == before:
            break
    return np.array(path)


def seriate_runs(df: DataFrame, most: int = 512, weight: float = 6.0) -> DataFrame:
    """df: run, id, category (its rank), v -> run, id, position. Each run (pinned, rest, weak ...) is ordered by itself; runs of over `most` rows are refused."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"a run has {len(pdf)} rows; at most {most} can be ordered")
        pdf = pdf.sort_values("id").reset_index(drop=True)
        order = seriate(np.stack(pdf.v.to_numpy()).astype(float), pdf.category.to_numpy(), weight)
        out = pdf.loc[order, ["run", "id"]]
        return out.assign(position=np.arange(len(out), dtype=np.int64))

    return df.select("run", "id", "category", "v").groupBy("run").applyInPandas(go, "run int, id long, position long")


def _plain_coverage(x: np.ndarray, first: int) -> np.ndarray:
    n = len(x)
    order, near = np.empty(n, np.int64), ((x - x[first]) ** 2).sum(1)
    near[first] = -1
    order[0] = first
    for k in range(1, n):
        nxt = int(near.argmax())
        order[k] = nxt
        near = np.where(near < 0, -1, np.minimum(near, ((x - x[nxt]) ** 2).sum(1)))
        near[nxt] = -1
    return order


class _Cells:
    """Points by the cells of a grid over their first two components: rows of a cell follow each other, cells are ordered row by row."""

    def __init__(self, flat: np.ndarray, lo: np.ndarray, side: float):
        at = ((flat - lo) / side).astype(np.int64) + 4
        self.width = int(at[:, 0].max()) + 5
        key = at[:, 1] * self.width + at[:, 0]
        self.place = np.argsort(key, kind="stable")
        self.keys, self.starts = np.unique(key[self.place], return_index=True)
        self.ends = np.append(self.starts[1:], len(key))
        self.of = np.repeat(np.arange(len(self.keys)), self.ends - self.starts)

    def around(self, cells: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (not included) of the cells up to `reach` columns and rows away: a line for each cell, a column for each row of cells."""
        mid = self.keys[cells][:, None] + np.arange(-reach, reach + 1) * self.width
        return np.searchsorted(self.keys, mid - reach), np.searchsorted(self.keys, mid + reach, "right")


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1 and so on."""
    n = last - first
    return np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())


def _distinct(at: np.ndarray, n: int) -> np.ndarray:
    """The entries of at, all under n, once each and in order."""
    if len(at) * 16 < n:
        return np.unique(at)
    found = np.zeros(n, bool)
    found[at] = True
    return np.flatnonzero(found)


def coverage(x: np.ndarray) -> np.ndarray:
    """Indices: the point nearest the mean, then always the point farthest from all before; the first on a tie.

    What is farther from the points before than all that it would come nearer to is chosen for
    certain, at that distance, whatever is chosen elsewhere meanwhile. So all such points are
    chosen at once, and the order is that of their distances. They are found among the cells'
    farthest, in grids that become finer as the distances halve: a new point changes only what
    is nearer to it than the farthest of all is to those before, no more than two cells away.
    """
    n = len(x)
    if n < 3:
        return np.arange(n)
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    flat = x[:, :2] if x.shape[1] > 1 else np.hstack([x, np.zeros((n, 1))])
    lo, span = flat.min(0), np.ptp(flat, axis=0).max()
    with np.errstate(over="ignore", invalid="ignore"):
        near = ((x - x[first]) ** 2).sum(1)
    if not np.isfinite(span) or not np.isfinite(near).all():
        return _plain_coverage(x, first)
    chosen_at = np.zeros(n)  # squared distance from the points before; copies of chosen points have none
    left = np.flatnonzero((near > 0) & (np.arange(n) != first))
    while len(left):
        most = near[left].max()
        side = max(np.sqrt(most) / 2 * (1 + 1e-6), span / 2**28)
        left = _choose(x, flat, lo, side, left, near, most / 4, chosen_at)
    chosen_at[first] = np.inf
    return np.lexsort((np.arange(n), -chosen_at))


def _choose(x: np.ndarray, flat: np.ndarray, lo: np.ndarray, side: float, left: np.ndarray, all_near: np.ndarray, least: float, chosen_at: np.ndarray) -> np.ndarray:
    """Chooses among the points `left` until none is farther than `least` from those before; returns what is left then. No reach is over two sides of a cell."""
    grid = _Cells(flat[left], lo, side)
    own = left[grid.place]  # by cell, then by index
    points, near = np.ascontiguousarray(x[own]), all_near[own]
    farthest, which = np.empty(len(grid.keys)), np.empty(len(grid.keys), np.int64)

    def settle(cells: np.ndarray) -> None:
        first, last = grid.starts[cells], grid.ends[cells]
        at = _spread(first, last)
        sizes = last - first
        cuts, d = np.cumsum(sizes) - sizes, near[at]
        farthest[cells] = top = np.maximum.reduceat(d, cuts)
        which[cells] = np.minimum.reduceat(np.where(d == np.repeat(top, sizes), at, len(own)), cuts)

    steps = sorted(((dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if dx or dy), key=lambda s: s[0] ** 2 + s[1] ** 2)
    look = np.arange(len(grid.keys))
    settle(look)
    while True:
        look = look[farthest[look] > least]
        for dx, dy in steps:
            if not len(look):
                break
            key = grid.keys[look] + dy * grid.width + dx
            other = np.minimum(np.searchsorted(grid.keys, key), len(grid.keys) - 1)
            # chosen earlier than the cell's own: farther, or as far and of a smaller index
            d, e = farthest[look], farthest[other]
            look = look[~((grid.keys[other] == key) & ((e > d) | ((e == d) & (own[which[other]] < own[which[look]]))))]
        if not len(look):
            break
        new = which[look]
        chosen_at[own[new]] = near[new]
        near[new] = -1
        first, last = grid.around(look, 2)
        first, last = grid.starts[np.minimum(first, len(grid.keys) - 1)], np.where(last > first, grid.ends[last - 1], 0)
        last = np.maximum(last, first)
        sizes = (last - first).sum(1)
        touched = [look]
        group = np.cumsum(sizes) // PAIRS
        for part in np.split(np.arange(len(look)), np.flatnonzero(np.diff(group)) + 1):
            at = _spread(first[part].ravel(), last[part].ravel())
            d = ((points[at] - np.repeat(points[new[part]], sizes[part], axis=0)) ** 2).sum(1)
            less = np.flatnonzero(d < near[at])
            at = at[less]
            np.minimum.at(near, at, d[less])
            touched.append(grid.of[at])
        settle(_distinct(np.concatenate(touched), len(grid.keys)))
        # only cells around changed ones can now hold what is chosen next
        a, b = grid.around(look, 4)
        look = _distinct(_spread(a.ravel(), b.ravel()), len(grid.keys))
    all_near[own] = near
    return np.sort(own[near > 0])


def coverage_order(df: DataFrame, group: str = "plot") -> DataFrame:
    """df: plot, id, v -> plot, id, position."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        out = pdf.loc[coverage(np.stack(pdf.v.to_numpy()).astype(float)), [group, "id"]]
        return out.assign(position=np.arange(len(out), dtype=np.int64))

    return df.select(group, "id", "v").groupBy(group).applyInPandas(go, f"{group} int, id long, position long")


def coverage_head(df: DataFrame, k: int) -> list[int]:
    """The first k ids of the coverage order of any number of rows: one pass over the rows per pick."""
    mean = df.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()  # one row per dimension
    to = lambda p: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in p]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    first = df.orderBy(F.round(to([r.m for r in mean]), 9), "id").select("id", "v").first()
    picked, points = [first.id], [first.v]
    while len(picked) < k:
        near = F.least(*[to(p) for p in points]) if len(points) > 1 else to(points[0])
        row = df.where(~F.col("id").isin(*picked)).orderBy(F.round(near, 9).desc(), "id").select("id", "v").first()
        if row is None:
            break
        picked.append(row.id)
        points.append(row.v)
    return picked


def embed(start: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, epochs: int = 200, negatives: int = 5, rate: float = 1.0, min_dist: float = 0.1, span: float = 20.0, seed: int = 42) -> np.ndarray:
    """2-D layout: linked points attract, random others repel. start: n x 2; links a, b with weights w in (0, 1]."""
    rng = np.random.default_rng(seed)
    y = start.astype(float).copy()
    lo, hi = y.min(), y.max()
    y = (y - lo) / max(hi - lo, 1e-12) * span
    pa, pb = max(0.1, 1.929 - 3.53 * min_dist + 2.4 * min_dist**2), max(0.1, 0.7915 + 0.5 * min_dist)
    n, every = len(y), w.max(initial=1e-12) / np.maximum(w, 1e-12)
    due, own = every.copy(), np.arange(n)
    y = np.ascontiguousarray(y.T)

    def push(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        d2 = dx**2 + dy**2
        return 2 * pb / ((0.001 + d2) * (1 + pa * d2**pb))

    def pull(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        d2 = dx**2 + dy**2
        return np.where(d2 > 0, -2 * pa * pb * np.maximum(d2, 1e-12) ** (pb - 1) / (1 + pa * d2**pb), 0)

    def forces(force: Callable, i: np.ndarray, j: np.ndarray, step: float) -> np.ndarray:
        out = np.empty((2, len(i)))
        for c in range(0, len(i), 8192):  # what a processor's own memory holds
            a, b = i[c : c + 8192], j[c : c + 8192]
            dx, dy = y[0][a] - y[0][b], y[1][a] - y[1][b]
            f = force(dx, dy)
            for axis, d in enumerate((dx, dy)):
                np.multiply(np.clip(f * d, -4, 4), step, out=out[axis, c : c + 8192])
        return out

    def add(at: np.ndarray, *by: np.ndarray) -> None:
        """y[at] += by, entry after entry."""
        at = np.concatenate([own, at])
        for axis in range(2):
            y[axis] = np.bincount(at, np.concatenate([y[axis], *(b[axis] for b in by)]), n)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fire = np.flatnonzero(due <= epoch + 1)
        if not len(fire):
            continue
        due[fire] += every[fire]
        i, j = a[fire], b[fire]
        near = forces(pull, i, j, step)
        add(np.concatenate([i, j]), near, -near)
        for _ in range(negatives):
            add(i, forces(push, i, rng.integers(n, size=len(i)), step))  # none from a point itself
    return y.T


def layout(points: DataFrame, links: DataFrame, **options) -> DataFrame:
    """points: id, x, y (the start); links: a, b, w -> id, x, y."""
    both = points.select(F.lit(0).alias("g"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = links.select(F.lit(0).alias("g"), "a", "b", "w")

    def go(key: tuple, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id").reset_index(drop=True)
        e = e.sort_values(["a", "b"])
        ids, ends = p.id.to_numpy(), e[["a", "b"]].to_numpy()
        at = np.minimum(np.searchsorted(ids, ends), len(ids) - 1)
        if (ids[at] != ends).any():
            raise KeyError("a link's end is no point")
        y = embed(p[["x", "y"]].to_numpy(), at[:, 0], at[:, 1], e.w.to_numpy(float), **options)
        return pd.DataFrame({"id": p.id, "x": y[:, 0], "y": y[:, 1]})

    return both.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(go, "id long, x double, y double")
