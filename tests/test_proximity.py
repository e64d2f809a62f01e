import math
import random

import pytest

from planarloom.functions.trig import clean_ring, ear_clip
from planarloom.operators import proximity as P
from planarloom.runtime import Workspace

PTS = "v bigint, lon double, lat double, id string"
POLY = "way_id bigint, ring array<struct<lon double, lat double>>, id string"


def dist(a, b):
    s = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * P.EARTH_M * math.asin(min(1, math.sqrt(s)))


@pytest.mark.parametrize(("lon", "lat", "metres"), [(4.7, 51.2, 0.25), (179.9999995, -33.0, 5.0), (12.0, 89.99999, 3.0), (-180.0, 0.0, 1000.0), (77.0, -90.0, 50.0)])
def test_near_pairs_against_brute_force(spark, lon, lat, metres):
    rnd = random.Random(3)
    step = metres / 111_000 * 4
    pts = {}
    for i in range(120):
        y = lat + rnd.uniform(-step, step)
        y = min(90.0, max(-90.0, y))
        x = lon + rnd.uniform(-step, step) / max(0.01, math.cos(math.radians(y)))
        x = (x + 540) % 360 - 180
        pts[i] = (x, y)
    rows = [(i, *p, "x") for i, p in pts.items()] + [(0, *pts[0], "again"), (500, None, 1.0, ""), (501, float("nan"), 1.0, ""), (None, *pts[0], "")]
    got = {tuple(r) for r in P.near_pairs(spark.createDataFrame(rows, PTS), "v", metres).collect()}
    want = {(a, b) for a in pts for b in pts if a < b and dist(pts[a], pts[b]) <= metres}
    assert got == want and (len(want) > 10)


def even_odd(x, y, ring):
    ok = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            ok = not ok
    return ok


def rings():
    rnd = random.Random(5)
    out = {}
    for k in range(12):
        cx, cy, n = rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.choice([4, 7, 12, 40])
        pts = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rnd.uniform(0.2, 1.5)]]
        out[k] = (pts[::-1] if k % 2 else pts) + [pts[-1] if k % 2 else pts[0]]
    out[20] = [(0.0, 0.0), (3.0, 3.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)]  # crosses itself
    out[21] = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]  # a point twice
    return out


@pytest.mark.parametrize("block", [7, 50_000])
def test_points_in_rings_against_brute_force(spark, block):
    rnd = random.Random(9)
    pts = {i: (rnd.uniform(-1, 5), rnd.uniform(-1, 5)) for i in range(200)}
    bad = {30: None, 31: [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 32: [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], 33: [], 34: [(0.0, 0.0)] * 5, 35: [(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 0.0)]}
    rs = rings()
    poly = spark.createDataFrame([(k, r, "i") for k, r in [*rs.items(), *bad.items(), (0, rs[0])]], POLY)
    v = spark.createDataFrame([(i, *p, "x") for i, p in [*pts.items(), (0, pts[0])]] + [(900, None, None, "x")], PTS)
    got = [tuple(r) for r in P.points_in_rings(v, "v", poly, "way_id", "ring", Workspace(spark, "t"), treelets=5, block=block).collect()]
    want = {(i, k) for i, p in pts.items() for k, r in rs.items() if even_odd(*p, r)}
    assert len(got) == len(set(got)) and set(got) == want
    none = P.points_in_rings(v, "v", spark.createDataFrame([], POLY), "way_id", "ring", Workspace(spark, "t"))
    assert none.count() == 0
    assert P.points_in_rings(spark.createDataFrame([], PTS), "v", poly, "way_id", "ring", Workspace(spark, "t")).count() == 0


def test_shared_edge_counts_once(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    poly = spark.createDataFrame([(1, square, "")], POLY)
    v = spark.createDataFrame([(1, 1.0, 1.0, ""), (2, 0.0, 0.0, ""), (3, 2.0, 1.0, ""), (4, 2.1, 1.0, "")], PTS)
    assert sorted(tuple(r) for r in P.points_in_rings(v, "v", poly, "way_id", "ring", Workspace(spark, "t")).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_ear_clipping_keeps_the_area():
    for k, r in rings().items():
        ring = clean_ring([p[0] for p in r], [p[1] for p in r])
        ears = ear_clip(ring)
        if k == 20:
            continue
        area = lambda t: sum(t[i][0] * t[(i + 1) % len(t)][1] - t[(i + 1) % len(t)][0] * t[i][1] for i in range(len(t))) / 2
        assert sum(area([ring[i] for i in t]) for t in ears) == pytest.approx(abs(area(ring)))


def test_crossing_ring_keeps_points_on_fan_diagonals(spark):
    from fractions import Fraction

    crossing = {
        1: [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (5.0, 8.0), (7.0, 8.0), (0.0, 6.0), (0.0, 0.0)],
        2: [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)],
        3: [(4.0, 8.0), (6.0, 0.0), (0.0, 5.0), (8.0, 5.0), (2.0, 0.0), (4.0, 8.0)],
    }
    assert all(ear_clip(clean_ring([p[0] for p in r], [p[1] for p in r])) is None for r in crossing.values())
    pts = {17 * i + j: (i / 2, j / 2) for i in range(17) for j in range(17)}
    whole = {k: [(Fraction(x), Fraction(y)) for x, y in r] for k, r in crossing.items()}
    want = {(i, k) for i, (x, y) in pts.items() for k, r in whole.items() if even_odd(Fraction(x), Fraction(y), r)}
    assert (17 * 6 + 6, 1) in want  # (3, 3)
    poly = spark.createDataFrame([(k, r, "") for k, r in crossing.items()], POLY)
    v = spark.createDataFrame([(i, *p, "") for i, p in pts.items()], PTS)
    for treelets in (1, 5):
        assert {tuple(r) for r in P.points_in_rings(v, "v", poly, "way_id", "ring", Workspace(spark, "t"), treelets=treelets).collect()} == want


def test_rings_that_cross_themselves_are_told_apart():
    from planarloom.functions.trig import simple_rings, triangles

    def crosses(r):
        n = len(r)
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        for i in range(n):
            for j in range(i + 2, n - (i == 0)):
                a, b, c, d = r[i], r[(i + 1) % n], r[j], r[(j + 1) % n]
                if turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                    return True
        return False

    rnd = random.Random(11)
    cases = [[(rnd.random(), rnd.random()) for _ in range(n)] for n in (5, 6, 8, 12) for _ in range(150)]
    made = triangles(cases)
    assert [t is None for t in made] == [crosses(r) for r in cases] and any(t is not None for t in made)
    area = lambda t: sum(t[i][0] * t[(i + 1) % len(t)][1] - t[(i + 1) % len(t)][0] * t[i][1] for i in range(len(t))) / 2
    for r, t in zip(cases, made, strict=True):
        if t is not None:
            assert sum(abs(area([r[i] for i in x])) for x in t) == pytest.approx(abs(area(r)))
    import numpy as np

    wave = [(math.cos(2 * math.pi * i / 3000) * (1 + 0.2 * math.sin(i)), math.sin(2 * math.pi * i / 3000) * (1 + 0.2 * math.sin(i))) for i in range(3000)]
    a = np.array(wave)
    assert simple_rings(a[None, :, 0], a[None, :, 1])[0]
    ears = ear_clip(wave)
    assert sum(area([wave[i] for i in t]) for t in ears) == pytest.approx(abs(area(wave)))


def test_touching_order_of_the_points_given_in_the_review(spark):
    ring = [(0.0, 0.0), (4.0, 4.0), (2.0, 6.0), (0.0, 4.0), (6.0, 2.0), (4.0, 0.0), (0.0, 0.0)]
    poly = spark.createDataFrame([(1, ring, "")], POLY)
    v = spark.createDataFrame([(1, 3.0, 1.0, "")], PTS)
    assert P.points_in_rings(v, "v", poly, "way_id", "ring", Workspace(spark, "t")).count() == 1


def test_triangles_and_points_are_both_dealt_out(spark):
    rnd = random.Random(2)
    rs = rings() | {50 + i: [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)] for i in range(20)}
    pts = {i: (rnd.uniform(-1, 5), rnd.uniform(-1, 5)) for i in range(150)}
    poly = spark.createDataFrame([(k, r, "i") for k, r in rs.items()], POLY)
    v = spark.createDataFrame([(i, *p, "x") for i, p in pts.items()], PTS)
    got = {tuple(r) for r in P.points_in_rings(v, "v", poly, "way_id", "ring", Workspace(spark, "t"), treelets=1, block=40, tri_block=7).collect()}
    assert got == {(i, k) for i, p in pts.items() for k, r in rs.items() if even_odd(*p, r)}


def test_many_points_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_POINTS", 5)
    v = spark.createDataFrame([(i, 4.0, 51.0, "") for i in range(40)], PTS)
    assert P.near_pairs(v, "v", 0.25).count() == 40 * 39 // 2
