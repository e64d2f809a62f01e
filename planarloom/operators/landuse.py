"""How much of each polygon every kind of land use covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarloom.functions import geo
from planarloom.functions.trig import flat
from planarloom.operators import crossing

#: Triangle pairs clipped at once.
BLOCK = 200_000
#: Land uses of a square that is not cut up.
CROWD = 400


def clip_area(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Areas of t ∩ u for arrays (n, 3, 2) of counter-clockwise triangles, by clipping t with the sides of u one by one."""
    poly, valid = t, np.ones(t.shape[:2], bool)
    for i in range(3):
        a, b = u[:, None, i], u[:, None, (i + 1) % 3]
        side = (b[..., 0] - a[..., 0]) * (poly[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (poly[..., 0] - a[..., 0])
        nxt, side2 = np.roll(poly, -1, 1), np.roll(side, -1, 1)
        inside = side >= 0
        crossing = inside != (side2 >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(crossing, side / np.where(side == side2, 1.0, side - side2), 0.0)
        cut = poly + w[..., None] * (nxt - poly)
        # Two places per side: its start if inside, and where it crosses; unused places repeat the point before.
        both = np.stack([poly, cut], 2).reshape(len(poly), -1, 2)
        used = np.stack([inside, crossing], 2).reshape(len(poly), -1)
        at = np.where(used, np.arange(used.shape[1]), -1)
        at = np.maximum.accumulate(at, 1)
        at = np.where(at < 0, at.max(1, keepdims=True), at)
        empty = at[:, -1] < 0
        poly = np.take_along_axis(both, np.maximum(at, 0)[..., None], 1)
        poly[empty] = 0.0
    x, y = poly[..., 0], poly[..., 1]
    return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def fan(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Counter-clockwise triangles of a closed ring from its first point, their signs, and the ring's signed area."""
    p = ring[:-1]
    t = np.stack([np.broadcast_to(p[0], (max(0, len(p) - 2), 2)), p[1:-1], p[2:]], 1)
    twice = (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])
    back = twice < 0
    t = t.copy()
    t[back, 1], t[back, 2] = t[back, 2].copy(), t[back, 1].copy()
    return t[twice != 0], np.sign(twice[twice != 0]), float(twice.sum() / 2)


def common_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two closed simple rings (n, 2), of any shape: the sum over pairs of fan triangles, each
    counted by both signs."""
    origin = a[0]
    t, s, area_a = fan(a - origin)
    u, r, area_b = fan(b - origin)
    if not area_a or not area_b:
        return 0.0
    total = 0.0
    step = max(1, BLOCK // max(1, len(u)))
    for i in range(0, len(t), step):
        ti, si = t[i : i + step], s[i : i + step]
        n, m = len(ti), len(u)
        total += float((clip_area(np.repeat(ti, m, 0), np.tile(u, (n, 1, 1))) * np.repeat(si, m) * np.tile(r, n)).sum())
    return max(0.0, total * np.sign(area_a) * np.sign(area_b))


def half(ring: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
    """The part of an open ring on one side of a line along an axis; parts of it are joined along that line."""
    off = ring[:, axis] - at if above else at - ring[:, axis]
    inside, nxt = off >= 0, np.roll(off, -1)
    if inside.all() or not inside.any():
        return ring if inside[0] else ring[:0]
    turned = np.roll(ring, -1, 0)
    crossing = inside != (nxt >= 0)
    w = np.where(crossing, off / np.where(crossing, off - nxt, 1.0), 0.0)
    cut = ring + w[:, None] * (turned - ring)
    cut[:, axis] = np.where(crossing, at, cut[:, axis])
    return np.stack([ring, cut], 1).reshape(-1, 2)[np.stack([inside, crossing], 1).ravel()]


def pieces(ring: np.ndarray, tree: crossing.Squares) -> Iterator[tuple[int, np.ndarray]]:
    """Square and part of an open ring in every square that it has a part in."""
    todo = [(0, ring)]
    while todo:
        k, part = todo.pop()
        if len(part) < 3:
            continue
        if tree.first[k] < 0:
            yield k, part
            continue
        x, y = tree.corner[k] + tree.side[k] / 2
        for dx in (0, 1):
            column = half(part, 0, x, dx == 1)
            if len(column) > 2:
                todo += [(tree.first[k] + 2 * dy + dx, half(column, 1, y, dy == 1)) for dy in (0, 1)]


def fans(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counter-clockwise triangles of open rings from their first points, their signs, how many each ring has, and the
    rings' signed areas."""
    n = np.maximum(np.diff(starts) - 2, 0)
    own = np.repeat(np.arange(len(n)), n)
    first = starts[:-1][own]
    at = first + 1 + np.arange(len(own)) - (np.cumsum(n) - n)[own]
    t = np.stack([points[first], points[at], points[at + 1]], 1)
    d, f = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    twice = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]
    t[twice < 0] = t[twice < 0][:, [0, 2, 1]]
    return t, np.sign(twice), n, np.bincount(own, twice / 2, len(n))


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of sizes ``n`` one behind the other: the list of each place, and the place in its list."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - (np.cumsum(n) - n)[own]


def common_areas(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of two open rings and the area they have in common, by the signs of both, where their boxes meet and nothing
    shows that they are apart. ``a`` and ``b``: points and where each ring begins."""
    (pa_, sa), (pb, sb) = a, b
    low = lambda p, s: (np.minimum.reduceat(p, s[:-1]), np.maximum.reduceat(p, s[:-1]))
    (la, ha), (lb, hb) = low(*a), low(*b)
    ta, ra, na, _ = fans(*a)
    tb, rb, nb, _ = fans(*b)
    fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
    # Across its longest side a ring may be far thinner than its box.
    own, k = spread(np.diff(sa))
    d = pa_[sa[own] + (k + 1) % np.diff(sa)[own]] - pa_
    size = np.hypot(d[:, 0], d[:, 1])
    order = np.lexsort((size, own))
    d = d[order[sa[1:] - 1]]
    across = np.stack([-d[:, 1], d[:, 0]], 1)
    over = (pa_ * across[own]).sum(1)
    lo, hi = np.minimum.reduceat(over, sa[:-1]), np.maximum.reduceat(over, sa[:-1])
    mid, reach = (lb + hb) / 2, (hb - lb) / 2
    step = max(1, BLOCK * 5 // max(1, len(lb)))
    for at in range(0, len(la), step):
        part = slice(at, at + step)
        i, j = np.nonzero(((la[part, None] <= hb) & (lb <= ha[part, None])).all(2))
        i += at
        m, r = (mid[j] * across[i]).sum(1), (reach[j] * np.abs(across[i])).sum(1) + 1e-9 * np.abs(across[i]).sum(1)
        near = (m + r >= lo[i]) & (m - r <= hi[i])
        i, j = i[near], j[near]
        upto = np.cumsum(na[i] * nb[j])
        k = 0
        while k < len(i):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, "right")))
            one, two = i[k:stop], j[k:stop]
            total = np.zeros(len(one))
            pair, place = spread(na[one] * nb[two])
            for z in range(0, len(pair), BLOCK):
                q, w = pair[z : z + BLOCK], place[z : z + BLOCK]
                t, u = fa[one[q]] + w // nb[two[q]], fb[two[q]] + w % nb[two[q]]
                origin = pa_[sa[one[q]]][:, None]
                x, y = ta[t] - origin, tb[u] - origin
                meet = ((x.min(1) <= y.max(1)) & (y.min(1) <= x.max(1))).all(1)
                total += np.bincount(q[meet], clip_area(x[meet], y[meet]) * ra[t[meet]] * rb[u[meet]], len(one))
            yield one, two, total
            k = stop


def overlaps(polygons: DataFrame, landuse: DataFrame, size: float) -> DataFrame:
    """``face``, ``way_id``, ``share``: the part of each polygon (face, ring) that each land use (way_id, ring) covers, where it is
    more than nothing. Squares of a quadtree hold some hundred land uses each, or are ``size`` wide; polygons are cut along
    them, so a polygon meets the land uses of the squares it runs through only, however large its box is."""
    box = geo.to_box(F.col("ring"))
    use = landuse.select("way_id", "ring", box.alias("b")).where(" and ".join(f"abs(b.{k}) < double('inf')" for k in ("left", "top", "right", "bottom")))
    seg = use.select(F.col("b.left").alias("ax"), F.col("b.bottom").alias("ay"), F.col("b.right").alias("bx"), F.col("b.top").alias("by"))
    tree = crossing.squares(seg, CROWD, size)
    if tree is None:
        return polygons.sparkSession.createDataFrame([], "face bigint, way_id bigint, share double")

    def place(batches: Iterator[pa.RecordBatch], name: str, boxes_only: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            points, starts = flat(batch.column("ring"))
            low, high = np.minimum.reduceat(points, starts[:-1]), np.maximum.reduceat(points, starts[:-1])
            ids = batch.column(name).to_numpy()
            # Rings are closed: the last point is left out.
            last = np.delete(points, starts[1:] - 1, 0)
            begin = starts - np.arange(len(starts))
            area = fans(last, begin)[3]
            first, far = tree.at(low), tree.at(high)
            one = np.flatnonzero(first == far)
            square, own, parts = [first[one]], [one], [last[begin[i] : begin[i + 1]] for i in one]
            for i in np.flatnonzero(first != far):
                ring = last[begin[i] : begin[i + 1]]
                shape = np.array([low[i], (high[i, 0], low[i, 1]), high[i], (low[i, 0], high[i, 1])]) if boxes_only else ring
                for k, part in pieces(shape, tree):
                    square.append([k])
                    own.append([i])
                    parts.append(ring if boxes_only else part)
            square, own = np.concatenate(square).astype("int32"), np.concatenate(own).astype(int)
            offsets = np.concatenate([[0], np.cumsum([2 * len(p) for p in parts])]).astype("int32")
            ring = pa.ListArray.from_arrays(offsets, np.concatenate([*parts, np.zeros((0, 2))]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(area[own]), ring, pa.array(square)], names=["id", "area", "ring", "square"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("face", pa.int64()), ("way_id", pa.int64()), ("common", pa.float64()), ("area", pa.float64()))})
        left, right = left.combine_chunks(), right.combine_chunks()
        a, b = flat(left["ring"].combine_chunks()), flat(right["ring"].combine_chunks())
        found = list(common_areas(a, b))
        i, j, common = (np.concatenate([f[k] for f in found] or [np.zeros(0)]) for k in range(3))
        i, j = i.astype(int), j.astype(int)
        area_a, area_b = left["area"].to_numpy()[i], right["area"].to_numpy()[j]
        common = common * np.sign(area_a) * np.sign(area_b)
        some = common != 0
        return pa.table({"face": left["id"].to_numpy()[i][some], "way_id": right["id"].to_numpy()[j][some], "common": common[some], "area": np.abs(area_a)[some]})

    placed = "id bigint, area double, ring array<double>, square int"
    a = polygons.select("face", "ring").mapInArrow(lambda it: place(it, "face", False), placed)
    b = use.select("way_id", "ring").mapInArrow(lambda it: place(it, "way_id", True), placed)
    tasks = max(4 * polygons.sparkSession.sparkContext.defaultParallelism, int((tree.first < 0).sum()) // 8)
    a, b = (x.repartition(tasks, "square").groupBy("square") for x in (a, b))
    met = a.cogroup(b).applyInArrow(meet, "face bigint, way_id bigint, common double, area double")
    shares = met.groupBy("face", "way_id").agg(F.sum("common").alias("common"), F.first("area").alias("area"))
    return shares.where("area > 0 and common > 1e-9 * area").select("face", "way_id", F.least(F.lit(1.0), F.col("common") / F.col("area")).alias("share"))


def share_by_type(overlapping: DataFrame, landuse: DataFrame) -> DataFrame:
    """``face``, ``type``, ``share``: the shares of each type's land uses added up; overlapping ones can add up to more than 1."""
    return overlapping.join(landuse.select("way_id", "type"), "way_id").groupBy("face", "type").agg(F.sum("share").alias("share"))


def dominant(shares: DataFrame, ident: str, type_: str = "type", share: str = "share") -> DataFrame:
    """``ident``, ``type``: the type of the largest share; of equal ones the first by name."""
    best = F.min(F.struct((-F.col(share)).alias("s"), F.col(type_).alias("t")))
    return shares.where(F.col(type_).isNotNull()).groupBy(ident).agg(best.alias("b")).select(ident, F.col("b.t").alias("type"))
