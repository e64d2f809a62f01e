"""Crossings of segments, whatever their lengths: squares that hold few segments each, and exact tests inside them.

A quadtree parts the plan by the middles of the segments, so crowded places get small squares and empty ones large. Every
segment is sent to the squares it runs through, and a task cuts its square further and tests what stands together. The
driver holds the crowded squares only; their number is that of the segments divided by ``CROWD``, times the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Middles of segments in a square that is not cut up between tasks, and the most halvings of its side.
CROWD, DEPTH = 10_000, 22
#: Segments of a square that are tested pair by pair, and pairs tested at once.
FEW, BLOCK = 48, 1_000_000
#: Squares are so many degrees wider when it is asked what runs through them: more than rounding moves any place of a crossing.
MARGIN = 1e-7
SEGMENTS = "e bigint, seg int, ax double, ay double, bx double, by double"
FOUND = "e1 bigint, s1 int, e2 bigint, s2 int, t1 double, t2 double, lon double, lat double"


def touches(a: np.ndarray, b: np.ndarray, corner: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether the segments a-b (n, 2) touch the squares given by their lower left corner (n, 2) and side, widened by ``MARGIN``."""
    half = side / 2
    mid, reach, d = corner + half[:, None], half + MARGIN, b - a
    near = (np.abs((a + b) / 2 - mid) <= np.abs(d) / 2 + reach[:, None]).all(1)
    off = d[:, 0] * (mid[:, 1] - a[:, 1]) - d[:, 1] * (mid[:, 0] - a[:, 0])
    return near & (np.abs(off) <= reach * np.abs(d).sum(1))


QUARTERS = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])


class Squares:
    """The quadtree: squares by number, ``first`` the number of the first of a square's four quarters, or -1."""

    def __init__(self, corner: tuple[float, float], side: float, crowded: set[tuple[int, int, int]]):
        at, first, todo = [(0, 0, 0)], [-1], [0]
        while todo:
            k = todo.pop()
            level, x, y = at[k]
            if (level, x, y) in crowded:
                first[k] = len(at)
                todo += range(len(at), len(at) + 4)
                at += [(level + 1, 2 * x + dx, 2 * y + dy) for dy in (0, 1) for dx in (0, 1)]
                first += [-1] * 4
        level, x, y = np.array(at).T
        self.side = side / 2.0**level
        self.corner = np.stack([corner[0] + x * self.side, corner[1] + y * self.side], 1)
        self.first = np.array(first)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of segment and square for every uncut square that a segment touches."""
        i, k = np.arange(len(a)), np.zeros(len(a), int)
        out = []
        while len(i):
            whole = self.first[k] < 0
            out.append((i[whole], k[whole]))
            i, k = np.repeat(i[~whole], 4), (self.first[k[~whole]][:, None] + np.arange(4)).ravel()
            hit = touches(a[i], b[i], self.corner[k], self.side[k])
            i, k = i[hit], k[hit]
        return np.concatenate([x for x, _ in out] or [i]), np.concatenate([x for _, x in out] or [k])


    def at(self, p: np.ndarray) -> np.ndarray:
        """Number of the uncut square that holds each place (n, 2)."""
        k = np.zeros(len(p), int)
        while (cut := np.flatnonzero(self.first[k] >= 0)).size:
            low = self.corner[k[cut]] + self.side[k[cut], None] / 2
            k[cut] = self.first[k[cut]] + ((p[cut] >= low) @ np.array([1, 2]))
        return k


def squares(seg: DataFrame, crowd: int = CROWD, smallest: float = 0.0) -> Squares | None:
    """The quadtree of a table of segments, of squares at least ``smallest`` wide; None if it has none."""
    x, y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    box = seg.agg(*[f(c) for f, cs in ((F.min, ("ax", "bx", "ay", "by")), (F.max, ("ax", "bx", "ay", "by"))) for c in cs]).first()
    if box[0] is None:
        return None
    corner = (float(np.floor(min(box[0], box[1]))) - 1, float(np.floor(min(box[2], box[3]))) - 1)
    side = 2.0 ** float(np.ceil(np.log2(max(max(box[4], box[5]) - corner[0], max(box[6], box[7]) - corner[1]) + 1)))
    fine = 2.0**DEPTH / side
    cells = seg.groupBy(F.floor((x - corner[0]) * fine).alias("x"), F.floor((y - corner[1]) * fine).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    up = cells.select("n", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("up"))
    counts = up.groupBy("up", F.expr("shiftright(x, up)").alias("x"), F.expr("shiftright(y, up)").alias("y")).agg(F.sum("n").alias("n")).where(F.col("n") > crowd)
    return Squares(corner, side, {(DEPTH - r["up"], r["x"], r["y"]) for r in counts.collect() if r["up"] and 2.0 ** r["up"] / fine / 2 >= smallest})


def gatherings(a: np.ndarray, b: np.ndarray, corner: np.ndarray, side: float, smallest: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists of segments (their numbers, and the sizes of the groups they stand in one behind the other) that together run
    through one small square: any two that meet in the square given are together in some group. Squares are halved while
    they hold more than ``FEW`` segments, unless that would mostly repeat them."""
    i, g = np.arange(len(a)), np.zeros(len(a), int)
    at = np.asarray(corner, float)[None]
    while len(i):
        n = np.bincount(g, minlength=len(at))
        cut = (n > FEW) & (side / 2 >= smallest)
        if cut.any():
            own = cut[g]
            gi, gg = np.repeat(i[own], 4), np.repeat(g[own], 4)
            q = np.tile(np.arange(4), own.sum())
            sides = np.full(len(gi), side / 2)
            hit = touches(a[gi], b[gi], at[gg] + QUARTERS[q] * (side / 2), sides)
            gi, gg, q = gi[hit], gg[hit], q[hit]
            cut &= np.bincount(gg, minlength=len(at)) < 1.9 * n
            keep = cut[gg]
            gi, key = gi[keep], gg[keep] * 4 + q[keep]
        done = ~cut[g]
        if done.any():
            yield i[done], n[~cut & (n > 0)]
        if not cut.any():
            return
        order = np.argsort(key, kind="stable")
        known, g = np.unique(key[order], return_inverse=True)
        i, at, side = gi[order], at[known // 4] + QUARTERS[known % 4] * (side / 2), side / 2


def pairs_of(i: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups of sizes ``n`` of a list, in blocks."""
    place = np.arange(len(i))
    rest = np.repeat(np.cumsum(n), n) - place - 1
    upto = np.cumsum(rest)
    k = 0
    while k < len(i):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, "right")))
        r = rest[k:stop]
        left = np.repeat(place[k:stop], r)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
        yield i[left], i[right]
        k = stop


def cross(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Twice the signed area of o, p, q."""
    return (p[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (p[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((p < 0) & (q > 0)) | ((p > 0) & (q < 0))


def crossing_pairs(e: np.ndarray, a: np.ndarray, b: np.ndarray, corner: np.ndarray, side: float, smallest: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the segments that cross properly, that of the smaller ``e`` first, each pair once; of those that cross in
    the square all are found."""
    one, two = [], []
    for members, n in gatherings(a, b, corner, side, smallest):
        for i, j in pairs_of(members, n):
            hit = apart(cross(a[i], b[i], a[j]), cross(a[i], b[i], b[j]))
            i, j = i[hit], j[hit]
            hit = apart(cross(a[j], b[j], a[i]), cross(a[j], b[j], b[i])) & (e[i] != e[j])
            i, j = i[hit], j[hit]
            turned = e[i] > e[j]
            one.append(np.where(turned, j, i))
            two.append(np.where(turned, i, j))
    if not one:
        return np.zeros(0, int), np.zeros(0, int)
    key = np.unique(np.concatenate(one) * len(e) + np.concatenate(two))
    return key // len(e), key % len(e)


def crossings(seg: DataFrame, smallest: float, crowd: int = CROWD) -> DataFrame:
    """``FOUND``: the proper crossings of segments (``SEGMENTS``, a written table) of different ``e``, each once. A crossing
    is reported from the square its place falls into. Where two segments are too parallel for the place to be exact, from
    the first square that both run through."""
    tree = squares(seg, crowd)
    if tree is None:
        return seg.sparkSession.createDataFrame([], FOUND)

    def ends(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf[["ax", "ay"]].to_numpy(), pdf[["bx", "by"]].to_numpy()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i, k = tree.of(*ends(pdf))
            yield pdf.iloc[i].assign(square=k.astype("int32"))

    def first_shared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sets = {k: tree.of(a[k : k + 1], b[k : k + 1])[1] for k in {*i.tolist(), *j.tolist()}}
        return np.array([np.intersect1d(sets[p], sets[q]).min() for p, q in zip(i.tolist(), j.tolist(), strict=True)], int)

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, e, s = key[0], pdf["e"].to_numpy(), pdf["seg"].to_numpy()
        a, b = ends(pdf)
        corner, side = tree.corner[k], tree.side[k]
        i, j = crossing_pairs(e, a, b, corner, side, smallest)
        a1, b1, a2, b2 = a[i], b[i], a[j], b[j]
        p, q, r, t = cross(a2, b2, a1), cross(a2, b2, b1), cross(a1, b1, a2), cross(a1, b1, b2)
        t1, t2 = p / (p - q), r / (r - t)
        at = a1 + t1[:, None] * (b1 - a1)
        one, two = np.hypot(*(b1 - a1).T), np.hypot(*(b2 - a2).T)
        unsure = ~(np.abs(p - q) >= 1e-7 * one * two * (one + two))
        own = ((at >= corner) & (at < corner + side)).all(1)
        if unsure.any():
            own[unsure] = first_shared(a, b, i[unsure], j[unsure]) == k
        columns = {"e1": e[i], "s1": s[i], "e2": e[j], "s2": s[j], "t1": t1, "t2": t2, "lon": at[:, 0], "lat": at[:, 1]}
        return pd.DataFrame({c: v[own] for c, v in columns.items()})

    tasks = max(4 * seg.sparkSession.sparkContext.defaultParallelism, int((tree.first < 0).sum()) // 8)
    placed = seg.mapInPandas(place, f"{SEGMENTS}, square int")
    return placed.repartition(tasks, "square").groupBy("square").applyInPandas(test, FOUND)
