"""Exact and vectorised planar predicates for Arrow functions."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa

#: Relative error bound of a 2x2 orientation determinant in double precision, generously.
DET_ERR = 8 * np.finfo(float).eps


def orient(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> int:
    """Sign of the turn a, b, c: 1 counter-clockwise, -1 clockwise, 0 collinear. Exact for doubles."""
    p, q = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = p - q
    if abs(det) > DET_ERR * (abs(p) + abs(q)):
        return 1 if det > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (det > 0) - (det < 0)


def orient_many(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """``orient`` over arrays: doubles first, exact arithmetic where rounding could decide."""
    ax, ay, bx, by, cx, cy = np.broadcast_arrays(ax, ay, bx, by, cx, cy)
    p, q = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = p - q
    out = np.sign(det).astype(np.int8)
    for i in np.flatnonzero(np.abs(det) <= DET_ERR * (np.abs(p) + np.abs(q))):
        out.flat[i] = orient(ax.flat[i], ay.flat[i], bx.flat[i], by.flat[i], cx.flat[i], cy.flat[i])
    return out


def clean_ring(xs: list, ys: list) -> list[tuple[float, float]]:
    """The ring without its closing point and without points repeated in a row."""
    out: list[tuple[float, float]] = []
    for p in zip(xs, ys, strict=True):
        if not out or out[-1] != p:
            out.append(p)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def twice_area(ring: list[tuple[float, float]]) -> float:
    """Twice the signed area of a ring given without its closing point; its sign, and whether it is 0, are exact."""
    x, y = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
    terms = (x - x[0]) * (np.roll(y, -1) - y[0]), (np.roll(x, -1) - x[0]) * (y - y[0])
    total = float(np.sum(terms[0] - terms[1]))
    if abs(total) > DET_ERR * len(ring) * float(np.sum(np.abs(terms[0]) + np.abs(terms[1]))):
        return total
    fx, fy = [Fraction(v) for v in x.tolist()], [Fraction(v) for v in y.tolist()]
    exact = sum(fx[i - 1] * fy[i] - fx[i] * fy[i - 1] for i in range(len(ring)))
    return float((exact > 0) - (exact < 0)) if exact else 0.0


def touching(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Whether segments a-b and c-d have a point in common, over arrays; exact."""
    met = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
    out = np.zeros(met.shape, bool)
    at = np.flatnonzero(met)
    if len(at):
        ax, ay, bx, by, cx, cy, dx, dy = (np.broadcast_to(v, met.shape).ravel()[at] for v in (ax, ay, bx, by, cx, cy, dx, dy))
        one = orient_many(ax, ay, bx, by, cx, cy) * orient_many(ax, ay, bx, by, dx, dy) <= 0
        out.ravel()[at] = one & (orient_many(cx, cy, dx, dy, ax, ay) * orient_many(cx, cy, dx, dy, bx, by) <= 0)
    return out


def simple_rings(x: np.ndarray, y: np.ndarray, block: int = 1_000_000) -> np.ndarray:
    """Which of the rings (rows of ``x`` and ``y``, without closing points) neither cross nor touch themselves."""
    r, n = x.shape
    ok = np.ones(r, bool)
    if n < 3:
        return ok
    x2, y2 = np.roll(x, -1, 1), np.roll(y, -1, 1)
    x3, y3 = np.roll(x, -2, 1), np.roll(y, -2, 1)
    flat = orient_many(x, y, x2, y2, x3, y3) == 0  # a side that turns straight back on the one before
    ok &= ~(flat & ((x2 - x) * (x3 - x2) + (y2 - y) * (y3 - y2) < 0)).any(1)
    if n == 3:
        return ok
    # Sides in the order of their western ends; each meets only those that begin before it ends.
    if n > 64:
        for k in range(r):
            west, east = np.minimum(x[k], x2[k]), np.maximum(x[k], x2[k])
            order = np.argsort(west, kind="stable")
            stop = np.searchsorted(west[order], east[order], side="right")
            first = 0
            while ok[k] and first < n:
                last = first + 1
                while last < n and int((stop[first : last + 1] - np.arange(first, last + 1) - 1).sum()) < block:
                    last += max(1, (last - first) // 2)
                last = min(last, n)
                counts = np.maximum(stop[first:last] - np.arange(first, last) - 1, 0)
                i = np.repeat(np.arange(first, last), counts)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
                i, j = order[i], order[j]
                apart = (np.abs(i - j) > 1) & (np.abs(i - j) < n - 1)
                i, j = i[apart], j[apart]
                ok[k] = not touching(x[k][i], y[k][i], x2[k][i], y2[k][i], x[k][j], y[k][j], x2[k][j], y2[k][j]).any()
                first = last
        return ok
    i, j = np.triu_indices(n, 2)
    i, j = i[j - i < n - 1], j[j - i < n - 1]
    step = max(1, block // max(1, len(i)))
    for k in range(0, r, step):
        s = slice(k, k + step)
        ok[s] &= ~touching(x[s][:, i], y[s][:, i], x2[s][:, i], y2[s][:, i], x[s][:, j], y[s][:, j], x2[s][:, j], y2[s][:, j]).any(1)
    return ok


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]] | None:
    """Triangles (indexes, counter-clockwise) of a simple ring given without its closing point; None for rings that cross or
    touch themselves."""
    n = len(ring)
    if n < 3:
        return []
    x, y = np.array([[p[0] for p in ring]]), np.array([[p[1] for p in ring]])
    return clip_simple(ring) if simple_rings(x, y)[0] else None


def clip_simple(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]] | None:
    """Ears of a simple ring, cut off one by one. Only reflex corners can lie in an ear; they are looked up in a grid of about
    as many cells as there are corners, so a long ring takes time in proportion to its length."""
    n = len(ring)
    twice = twice_area(ring)
    if twice == 0:
        return None
    ahead = [(i + 1) % n for i in range(n)] if twice > 0 else [(i - 1) % n for i in range(n)]
    behind = [0] * n
    for i, j in enumerate(ahead):
        behind[j] = i

    def turn(i: int) -> int:
        return orient(*ring[behind[i]], *ring[i], *ring[ahead[i]])

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    left, bottom = min(xs), min(ys)
    side = max(1, int(n**0.5))
    wide, high = (max(xs) - left) / side or 1.0, (max(ys) - bottom) / side or 1.0
    col = [min(side - 1, int((v - left) / wide)) for v in xs]
    row = [min(side - 1, int((v - bottom) / high)) for v in ys]
    grid: dict[tuple[int, int], set[int]] = {}
    reflex = [turn(i) <= 0 for i in range(n)]
    for i in range(n):
        if reflex[i]:
            grid.setdefault((col[i], row[i]), set()).add(i)

    def is_ear(a: int, b: int, c: int) -> bool:
        (ax, ay), (bx, by), (cx, cy) = ring[a], ring[b], ring[c]
        low_x, top_x, low_y, top_y = min(ax, bx, cx), max(ax, bx, cx), min(ay, by, cy), max(ay, by, cy)
        cells = range(min(col[a], col[b], col[c]), max(col[a], col[b], col[c]) + 1), range(min(row[a], row[b], row[c]), max(row[a], row[b], row[c]) + 1)
        some = [grid[k] for k in ((p, q) for p in cells[0] for q in cells[1]) if k in grid] if len(cells[0]) * len(cells[1]) <= len(grid) else grid.values()
        for own in some:
            for i in own:
                if i in (a, b, c) or not (low_x <= xs[i] <= top_x and low_y <= ys[i] <= top_y):
                    continue
                p, q = xs[i], ys[i]
                if orient(ax, ay, bx, by, p, q) >= 0 and orient(bx, by, cx, cy, p, q) >= 0 and orient(cx, cy, ax, ay, p, q) >= 0:
                    return False
        return True

    out: list[tuple[int, int, int]] = []
    left_over, at, since = n, 0, 0
    while left_over > 3:
        if since > left_over:
            return None
        a, c = behind[at], ahead[at]
        t = turn(at)
        if t == 0 or (t > 0 and is_ear(a, at, c)):
            if t:
                out.append((a, at, c))
            ahead[a], behind[c] = c, a
            if reflex[at]:
                grid[col[at], row[at]].discard(at)
            left_over, since = left_over - 1, 0
            for i in (a, c):  # corners can only become convex
                if reflex[i] and turn(i) > 0:
                    reflex[i] = False
                    grid[col[i], row[i]].discard(i)
            at = a
        else:
            at, since = c, since + 1
    a, c = behind[at], ahead[at]
    t = turn(at)
    if t > 0:
        out.append((a, at, c))
    return None if t < 0 else out


def triangles(rings: list[list[tuple[float, float]]]) -> list[list[tuple[int, int, int]] | None]:
    """``ear_clip`` of many rings. Rings of one length are tested together, and convex ones are cut as a fan, whose triangles
    are ears all."""
    out: list[list[tuple[int, int, int]] | None] = [[] for _ in rings]
    by_n: dict[int, list[int]] = {}
    for k, ring in enumerate(rings):
        if len(ring) >= 3:
            by_n.setdefault(len(ring), []).append(k)
    for n, ks in by_n.items():
        pts = np.array([rings[k] for k in ks], float)
        x, y = pts[..., 0], pts[..., 1]
        simple = simple_rings(x, y)
        turns = orient_many(x, y, np.roll(x, -1, 1), np.roll(y, -1, 1), np.roll(x, -2, 1), np.roll(y, -2, 1))
        fan_left, fan_right = [(0, i, i + 1) for i in range(1, n - 1)], [(0, i + 1, i) for i in range(1, n - 1)]
        for k, ok, low, top in zip(ks, simple, turns.min(1), turns.max(1), strict=True):
            out[k] = None if not ok else fan_left if low > 0 else fan_right if top < 0 else clip_simple(rings[k])
    return out


class BoxTree:
    """A bounding-volume hierarchy over boxes (left, bottom, right, top) in their given order, leaf size 4.

    The order should follow a space-filling curve. Nodes form an implicit binary tree over blocks of consecutive boxes.
    """

    LEAF = 4

    def __init__(self, boxes: np.ndarray):
        self.boxes = boxes
        n = max(1, -(-len(boxes) // self.LEAF))
        width = 1 << (n - 1).bit_length()
        empty = np.array([np.inf, np.inf, -np.inf, -np.inf])
        level = np.tile(empty, (width, 1))
        for k in range(self.LEAF):
            part = boxes[k :: self.LEAF]
            level[: len(part), :2] = np.minimum(level[: len(part), :2], part[:, :2])
            level[: len(part), 2:] = np.maximum(level[: len(part), 2:], part[:, 2:])
        self.levels = [level]
        while len(level) > 1:
            level = np.hstack([np.minimum(level[::2, :2], level[1::2, :2]), np.maximum(level[::2, 2:], level[1::2, 2:])])
            self.levels.append(level)

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, box index) of every box that holds a point, borders included."""
        pts, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            if depth < len(self.levels) - 1:
                pts, node = np.repeat(pts, 2), np.stack([node * 2, node * 2 + 1], 1).ravel()
            b = self.levels[depth][node]
            ok = (x[pts] >= b[:, 0]) & (y[pts] >= b[:, 1]) & (x[pts] <= b[:, 2]) & (y[pts] <= b[:, 3])
            pts, node = pts[ok], node[ok]
        pts, box = np.repeat(pts, self.LEAF), (node[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
        ok = box < len(self.boxes)
        pts, box = pts[ok], box[ok]
        b = self.boxes[box]
        ok = (x[pts] >= b[:, 0]) & (y[pts] >= b[:, 1]) & (x[pts] <= b[:, 2]) & (y[pts] <= b[:, 3])
        return pts[ok], box[ok]


def morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Z-order of degrees: 31 bits of each axis interleaved."""
    out = np.zeros(len(x), np.int64)
    for v, shift in ((x, 0), (y, 1)):
        n = np.clip((v + 360.0) / 720.0 * 2**31, 0, 2**31 - 1).astype(np.int64)
        for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = (n | (n << step)) & mask
        out |= n << shift
    return out


def flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Points (n, 2) of an Arrow array of rings, of structs or of pairs one behind the other, and where each ring begins."""
    values, starts = rings.flatten(), rings.offsets.to_numpy().astype(int)
    if pa.types.is_struct(values.type):
        points = np.stack([f.to_numpy(zero_copy_only=False) for f in values.flatten()], 1)
        return points, starts - starts[0]
    return values.to_numpy(zero_copy_only=False).reshape(-1, 2), (starts - starts[0]) // 2
