import math
import random

import pytest
from pyspark.sql import functions as F

from planarloom.functions import geo, identity, rules, tiles
from planarloom.operators import faces, graph, landuse
from planarloom.runtime import Workspace

P = "struct<lon: double, lat: double>"
EDGE = f"e bigint, v1 bigint, v2 bigint, pts array<{P}>, tags array<struct<k: string, v: string>>, extra string"
TAG = [("highway", "residential")]


def edges(spark, places, pairs, tags=None):
    rows = [(e, a, b, [places[a], places[b]], (tags or {}).get(e, TAG), "x") for e, (a, b) in pairs.items()]
    return spark.createDataFrame(rows, EDGE)


TRIANGLE = {0: (4.788075685501099, 51.26676188180721), 1: (4.786123037338257, 51.26496276736555), 2: (4.790832996368408, 51.265137311403734)}


def test_triangle_has_an_inner_and_an_outer_face(spark):
    for pairs in ({1: (0, 1), 2: (1, 2), 3: (2, 0)}, {1: (0, 1), 2: (2, 1), 3: (2, 0)}):
        g = edges(spark, TRIANGLE, pairs)
        a = faces.assign_faces(g, Workspace(spark, "t")).collect()
        assert len(a) == 6 and len({r["face"] for r in a}) == 2
        for face in {r["face"] for r in a}:
            own = {r["v_from"]: r["v_to"] for r in a if r["face"] == face}
            assert len(own) == 3 and len(set(own.values())) == 3
        p = faces.polygons(faces.rings(faces.assign_faces(g, Workspace(spark, "t")), g, Workspace(spark, "t"))).collect()
        assert sorted(r["is_outer"] for r in p) == [False, True]
        assert p[0]["signed_area"] == pytest.approx(-p[1]["signed_area"]) and all(len(r["ring"]) == 4 for r in p)
        # the inner face lies on the right of its edges, so it runs clockwise: P, R, Q
        inner = next(r for r in p if not r["is_outer"])
        ring = [tuple(x) for x in inner["ring"]]
        at = ring.index(TRIANGLE[0])
        assert [ring[(at + i) % 3] for i in range(3)] == [TRIANGLE[0], TRIANGLE[2], TRIANGLE[1]]


def test_one_edge_has_no_face(spark):
    g = edges(spark, TRIANGLE, {1: (0, 1)})
    assert faces.assign_faces(g, Workspace(spark, "t")).count() == 0
    assert [r["nx"] for r in faces.turn(faces.half_edges(g)).collect()] == [None, None]


def test_order_around_a_vertex(spark):
    at = {0: (4.801325798034667, 51.268153126307524), 1: (4.801331162452698, 51.267829233580834), 2: (4.801816642284393, 51.26783426820025), 3: (4.801317751407623, 51.26754225936128)}
    g = edges(spark, at, {1: (0, 1), 2: (1, 2), 3: (1, 3)})
    half = faces.half_edges(g)
    # arriving from the north (half-edge 2) the sharpest right turn leads south, then east
    nx = {r["h"]: r["nx"] for r in faces.turn(half).collect()}
    assert nx[2] == 6
    order = sorted((r["rank"], r["h"]) for r in faces.clockwise_order(half).where("v = 1").collect())
    ring = [h for _, h in order]
    i = ring.index(3)  # back to the north
    assert [ring[(i + k) % 3] for k in (1, 2)] == [6, 4]


def test_bridges_and_spurs_bound_no_face(spark):
    at = {i: (x, y) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (3, 0), (4, 0), (3, 1), (9, 9)])}
    at = {i: (4 + x / 100, 51 + y / 100) for i, (x, y) in at.items()}
    g = edges(spark, at, {1: (0, 1), 2: (1, 2), 3: (2, 0), 4: (1, 3), 5: (3, 4), 6: (4, 5), 7: (5, 3), 8: (4, 6)})
    a = faces.assign_faces(g, Workspace(spark, "t")).collect()
    assert {r["e"] for r in a} == {1, 2, 3, 5, 6, 7} and len({r["face"] for r in a}) == 4
    assert faces.adjacency(faces.assign_faces(g, Workspace(spark, "t"))).count() == 2


def lattice(n, seed):
    """A grid with jitter and some edges left out, as places and pairs."""
    rnd = random.Random(seed)
    at = {i * n + j: (4.7 + 0.002 * i + rnd.uniform(-3e-4, 3e-4), 51.2 + 0.002 * j + rnd.uniform(-3e-4, 3e-4)) for i in range(n) for j in range(n)}
    pairs = {}
    for i in range(n):
        for j in range(n):
            for d, (a, b) in enumerate(((i + 1, j), (i, j + 1))):
                if a < n and b < n and rnd.random() < 0.75:
                    pairs[2 * (i * n + j) + d] = (i * n + j, a * n + b)
    return at, pairs


def trace(at, pairs):
    """Loops of always turning right, half-edge by half-edge."""
    half = {2 * e: (a, b) for e, (a, b) in pairs.items()} | {2 * e + 1: (b, a) for e, (a, b) in pairs.items()}
    angle = lambda h: math.atan2(at[half[h][1]][1] - at[half[h][0]][1], at[half[h][1]][0] - at[half[h][0]][0])
    out = {}
    for h in half:
        out.setdefault(half[h][0], []).append(h)
    nx = {}
    for h in half:
        own = [k for k in out[half[h][1]] if k != h ^ 1]
        back = angle(h ^ 1)
        nx[h] = min(own, key=lambda k: (angle(k) - back) % (2 * math.pi)) if own else None
    return nx


def test_faces_of_a_lattice_against_a_tracer(spark):
    at, pairs = lattice(7, 3)
    g = edges(spark, at, pairs)
    work = Workspace(spark, "t")
    assert {r["h"]: r["nx"] for r in faces.turn(faces.half_edges(g)).collect()} == trace(at, pairs)
    core = graph.prune_dead_ends(g, work)
    left = dict(pairs)
    while True:
        deg = {}
        for a, b in left.values():
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
        gone = [e for e, (a, b) in left.items() if deg[a] == 1 or deg[b] == 1]
        if not gone:
            break
        for e in gone:
            del left[e]
    assert {r["e"] for r in core.collect()} == set(left)
    nx = trace(at, left)
    orbit = {}
    for h in nx:
        k, m = h, h
        while (k := nx[k]) != h:
            m = min(m, k)
        orbit[h] = m
    loops = {r["h"]: r["loop"] for r in faces.loops(faces.half_edges(core), work).collect()}
    assert loops == orbit
    # Euler: every component has its own outer loop
    seen, parts = set(), 0
    near = {}
    for a, b in left.values():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for v in near:
        if v not in seen:
            parts, todo = parts + 1, [v]
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen.add(u)
                    todo += near[u]
    assert len(near) - len(left) + len(set(orbit.values())) == 2 * parts
    p = faces.polygons(faces.rings(faces.assign_faces(core, Workspace(spark, "u")), core, Workspace(spark, "v"))).collect()
    assert sum(r["signed_area"] for r in p) == pytest.approx(0, abs=1e-12)


def test_chains_become_one_edge(spark):
    at = {i: (4.0 + i / 100, 51.0 + (i % 2) / 1000) for i in range(20)}
    other = [("highway", "track")]
    g = edges(spark, at, {1: (0, 1), 2: (2, 1), 3: (2, 3), 4: (3, 4), 5: (4, 5), 6: (4, 6), 7: (10, 11), 8: (11, 12), 9: (12, 10)}, {4: other})
    got = {r["e"]: r for r in graph.contract_chains(g, Workspace(spark, "t")).collect()}
    assert {e: r["n_edges"] for e, r in got.items()} == {1: 3, 4: 1, 5: 1, 6: 1, 7: 3}
    assert {got[1]["v1"], got[1]["v2"]} == {0, 3} and len(got[1]["pts"]) == 4
    line = [tuple(p) for p in got[1]["pts"]]
    assert line in ([at[0], at[1], at[2], at[3]], [at[3], at[2], at[1], at[0]])
    assert got[7]["v1"] == got[7]["v2"] == 10 and [tuple(p) for p in got[7]["pts"]] == [at[10], at[11], at[12], at[10]]
    assert graph.contract_chains(g.limit(0), Workspace(spark, "t")).count() == 0


def test_crossing_edges_are_split(spark):
    at = {0: (4.7522735595703125, 50.97918242660188), 1: (4.752531051635742, 50.97851368626033), 2: (4.752981662750244, 50.978996666362015), 3: (4.7518390417099, 50.97881090537897)}
    g = edges(spark, at, {1: (0, 1), 2: (2, 3)})
    s = graph.split(g).collect()
    assert sorted((r["e"], r["piece"]) for r in s) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    x = {tuple(r["pts"][-1 if r["piece"] == 0 else 0]) for r in s}
    assert all(p == pytest.approx((4.752375483512878, 50.97889534228157), abs=2e-5) for p in x)
    ends = [v for r in s for v in (r["v1"], r["v2"])]
    assert max(ends.count(v) for v in ends) == 4 and len(set(ends)) == 5


def test_only_proper_crossings_split(spark):
    at = {0: (0.0, 0.0), 1: (0.01, 0.0), 2: (0.005, 0.0), 3: (0.005, 0.01), 4: (0.002, 0.0), 5: (0.008, 0.0), 6: (0.01, 0.01)}
    # a T-junction, a shared end, an overlap
    g = edges(spark, at, {1: (0, 1), 2: (2, 3), 3: (1, 6), 4: (4, 5)})
    assert graph.crossings(g).count() == 0 and graph.split(g).count() == 4


def test_long_and_steep_edges_against_brute_force(spark):
    rnd = random.Random(8)
    at = {i: (rnd.uniform(0, 0.05), rnd.uniform(0, 0.05)) for i in range(40)}
    at |= {50: (0.0, 0.0), 51: (0.05, 0.0499), 52: (0.02, 0.0), 53: (0.02, 0.05), 54: (0.0, 0.031), 55: (0.05, 0.031)}
    pairs = {i: (2 * i, 2 * i + 1) for i in range(20)} | {30: (50, 51), 31: (52, 53), 32: (54, 55)}
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    want = set()
    for e, (a, b) in pairs.items():
        for f, (c, d) in pairs.items():
            a_, b_, c_, d_ = (at[k] for k in (a, b, c, d))
            if e < f and turn(a_, b_, c_) * turn(a_, b_, d_) < 0 and turn(c_, d_, a_) * turn(c_, d_, b_) < 0:
                want.add((e, f))
    got = [(r["e1"], r["e2"]) for r in graph.crossings(edges(spark, at, pairs), 0.003).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_way_edges_pass_over_missing_nodes(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4, 5], TAG), (2, [6, 3, 7], TAG), (3, [9, 8], [("building", "yes")]), (4, [], TAG), (5, None, TAG), (6, [1, 99, 2], None)], "way_id bigint, refs array<bigint>, tags array<struct<k: string, v: string>>")
    nodes = spark.createDataFrame([(i, (float(i), 1.0)) for i in (1, 2, 3, 5, 6, 7)], f"node_id bigint, loc {P}")
    barrier = graph.barrier_ways(ways)
    assert sorted(r["way_id"] for r in barrier.collect()) == [1, 2]
    assert sorted(r["node_id"] for r in graph.vertex_nodes(barrier, nodes).collect()) == [1, 3, 5, 6, 7]
    got = sorted((r["way_id"], r["seq"], r["node1"], r["node2"], len(r["pts"])) for r in graph.way_edges(barrier, nodes).collect())
    assert got == [(1, 1, 1, 3, 3), (1, 2, 3, 5, 2), (2, 1, 6, 3, 2), (2, 2, 3, 7, 2)]


def test_common_area():
    import numpy as np

    ring = lambda *p: np.array([*p, p[0]], float)
    u = ring((0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3))
    bar = ring((-1, 2), (4, 2), (4, 2.5), (-1, 2.5))
    assert landuse.common_area(u, bar) == pytest.approx(1.0)
    assert landuse.common_area(u[::-1], bar) == pytest.approx(1.0)
    assert landuse.common_area(u, u) == pytest.approx(7.0)
    assert landuse.common_area(u, bar + 100) == 0.0
    rnd = random.Random(4)
    for _ in range(30):
        a, b, c, d = sorted(rnd.random() for _ in range(2)), sorted(rnd.random() for _ in range(2)), sorted(rnd.random() for _ in range(2)), sorted(rnd.random() for _ in range(2))
        one = ring((a[0], b[0]), (a[1], b[0]), (a[1], b[1]), (a[0], b[1]))
        two = ring((c[0], d[0]), (c[1], d[0]), (c[1], d[1]), (c[0], d[1]))
        want = max(0, min(a[1], c[1]) - max(a[0], c[0])) * max(0, min(b[1], d[1]) - max(b[0], d[0]))
        assert landuse.common_area(one, two) == pytest.approx(want, abs=1e-12)


def test_shares_by_type(spark):
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    poly = spark.createDataFrame([(1, sq(0.0, 0.0, 0.02)), (2, sq(1.0, 1.0, 0.02))], f"face bigint, ring array<{P}>")
    use = spark.createDataFrame([(10, "rural", sq(0.0, 0.0, 0.01)), (11, "rural", sq(0.01, 0.01, 0.05)), (12, "water", sq(-1.0, -1.0, 0.5))], f"way_id bigint, type string, ring array<{P}>")
    over = landuse.overlaps(poly, use, 0.01)
    assert sorted((r["face"], r["way_id"], round(r["share"], 9)) for r in over.collect()) == [(1, 10, 0.25), (1, 11, 0.25)]
    shares = landuse.share_by_type(over, use)
    assert [(r["face"], r["type"], round(r["share"], 9)) for r in shares.collect()] == [(1, "rural", 0.5)]
    assert [tuple(r) for r in landuse.dominant(shares, "face").collect()] == [(1, "rural")]


def test_rules_take_the_first_tag_that_has_one(spark):
    rows = [([("name", "x"), ("railway", "tram"), ("highway", "primary")],), ([("highway", "corridor"), ("waterway", "stream")],), ([("highway", None), (None, "x")],), (None,), ([],)]
    df = spark.createDataFrame(rows, "tags array<struct<k: string, v: string>>")
    assert [r[0] for r in df.select(rules.classify(F.col("tags"), rules.BARRIER_RULES)).collect()] == [30, 5, None, None, None]


def test_guids_and_quantised_places(spark):
    import struct
    import uuid

    df = spark.createDataFrame([(4.7522735595703125, 50.97918242660188)], "lon double, lat double")
    c, g = df.select(tiles.quantize(F.col("lon"), F.col("lat")).alias("c")).select("c", identity.vertex_guid(F.col("c")).alias("g")).first()
    ns = uuid.UUID(identity.VERTEX_NS)
    name = struct.pack("<Iii", c["tile"], c["x"], c["y"])
    import hashlib

    raw = bytearray(hashlib.sha1(ns.bytes + name).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x50, raw[8] & 0x3F | 0x80
    assert g == str(uuid.UUID(bytes=bytes(raw)))
    ring = [(1, 5), (3, 5), (3, 2), (1, 2)]
    cells = lambda r: [(x, y, 7) for x, y in [*r, r[0]]]
    turned = [cells(ring[k:] + ring[:k]) for k in range(4)]
    rows = spark.createDataFrame([(r,) for r in turned], "c array<struct<x: int, y: int, tile: bigint>>")
    out = rows.select(identity.face_guid(F.col("c"), F.transform("c", lambda q: F.struct(q["x"].cast("double").alias("lon"), (-q["y"]).cast("double").alias("lat")))).alias("g")).collect()
    assert len({r["g"] for r in out}) == 1 and out[0]["g"] is not None


def test_angles(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    got = spark.range(1).select(*[geo.turn_angle(a, b, c) for a, b, c in [(p(0, 1), p(0, 0), p(0, -1)), (p(0, 1), p(0, 0), p(1, 0)), (p(0, 1), p(0, 0), p(-1, 0)), (p(0, 1), p(0, 0), p(0, 2)), (p(0, 0), p(0, 0), p(0, 2))]]).first()
    assert [None if x is None else round(x / math.pi, 9) for x in got] == [1.0, 1.5, 0.5, 2.0, None]


def test_boxes_in_tiles_of_any_size(spark):
    rnd = random.Random(6)
    box = lambda l, b, r, t: {"left": l, "top": t, "right": r, "bottom": b}
    rows = [(i, box(x, y, x + s, y + s)) for i, (x, y, s) in enumerate((rnd.uniform(4, 5), rnd.uniform(50, 51), rnd.choice([0.001, 0.05, 0.8])) for _ in range(30))] + [(99, box(-170.0, -80.0, 170.0, 80.0)), (100, None)]
    df = spark.createDataFrame(rows, "face bigint, box struct<left: double, top: double, right: double, bottom: double>")
    pts = spark.createDataFrame([(rnd.uniform(3.9, 5.9), rnd.uniform(49.9, 51.9)) for _ in range(60)], "lon double, lat double")
    known = pts.select(tiles.tile_of(F.col("lon"), F.col("lat")).alias("tile")).distinct()
    got = {tuple(r) for r in faces.boxes_in_tiles(df, "face", "box", known).collect()}
    tile = lambda lon, lat: (math.floor((lon + 180) / 360 * 2**14), math.floor((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 2**14))
    want = set()
    for i, b in rows:
        if b:
            (x0, y0), (x1, y1) = tile(b["left"], b["top"]), tile(b["right"], b["bottom"])
            want |= {(t, i) for t in (r["tile"] for r in known.collect()) if x0 <= t % 2**14 <= x1 and y0 <= t // 2**14 <= y1}
    assert got == want


def test_boxes_of_all_sizes_meet(spark):
    from planarloom.operators import boxes

    rnd = random.Random(7)
    kind = "id bigint, box struct<left: double, top: double, right: double, bottom: double>"

    def some(n, seed):
        rnd.seed(seed)
        out = []
        for i in range(n):
            x, y, s = rnd.uniform(0, 2), rnd.uniform(0, 2), rnd.choice([0.0, 0.004, 0.03, 0.5, 60.0])
            out.append((i, (x, y + s, x + s, y)))
        return [*out, (n, None)]

    a, b = some(40, 1), some(40, 2)
    got = boxes.meeting(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "id", "box", 0.01).collect()
    want = {(i, j) for i, p in a for j, q in b if p and q and p[0] <= q[2] and q[0] <= p[2] and q[3] <= p[1] and p[3] <= q[1]}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 100


def test_cells_and_face_guids_of_arrays_are_those_of_columns(spark):
    import numpy as np

    rnd = random.Random(3)
    rings = [[(rnd.uniform(3, 6), rnd.uniform(49, 52)) for _ in range(n)] for n in (3, 4, 9, 30)] + [[(50.5, 4.1), (4.1, 50.5), (-4.2, -50.1)]]
    rings = [r + r[:1] for r in rings]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], f"id int, ring array<{P}>")
    cells = F.transform("ring", lambda p: tiles.quantize(p["lon"], p["lat"]))
    rows = df.withColumn("c", cells).select("id", "c", identity.face_guid(F.col("c"), F.transform("c", lambda c: tiles.dequantize(c))).alias("g")).orderBy("id").collect()
    points, starts = np.array([p for r in rings for p in r]), np.cumsum([0, *map(len, rings)])
    assert identity.face_guids(points, starts) == [r["g"] for r in rows]
    assert identity.cell_keys(points).tolist() == [(c["tile"] << 28) + (c["x"] << 14) + c["y"] for r in rows for c in r["c"]]


def test_long_loops_and_short_ones_against_a_walk(spark):
    # the short cycles are done first and no longer joined; the place of each id on its cycle comes with it
    rnd = random.Random(6)
    ids = list(range(0, 900, 3))
    rnd.shuffle(ids)
    nx, at = {}, 0
    for size in (1, 2, 3, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 100, 61):
        own, at = ids[at : at + size], at + size
        nx |= dict(zip(own, own[1:] + own[:1], strict=True))
    rows = graph.cycles(spark.createDataFrame(list(nx.items()), "id bigint, nx bigint"), Workspace(spark, "c"), "c").collect()
    assert len(rows) == len(nx) == 300
    for r in rows:
        k, way = r["id"], []
        while not way or k != r["id"]:
            way.append(k)
            k = nx[k]
        assert (r["nx"], r["least"], r["ahead"]) == (nx[r["id"]], min(way), way.index(min(way)))


def test_shares_of_wide_and_thin_polygons_against_single_pairs(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    centres = np.vstack([rnd.uniform(4, 5, (150, 2)), 4.5 + rnd.normal(0, 0.002, (150, 2))])
    star = [(c + np.array([np.cos(k), np.sin(k)]).T * r[:, None]) for c, r, k in ((c, rnd.uniform(0.001, 0.004, 7), np.sort(rnd.uniform(0, 6.28, 7))) for c in centres)]
    uses = [[*map(tuple, s.tolist()), tuple(s[0].tolist())] for s in star]
    faces_ = [[(3.0, 3.0), (3.0, 50.0), (50.0, 3.0), (3.0, 3.0)], [(4.0, 4.0), (50.0, 50.1), (50.0, 50.0), (4.0, 4.0)], [(4.499, 4.499), (4.499, 4.503), (4.502, 4.5), (4.499, 4.499)], [(30.0, 30.0), (30.0, 31.0), (31.0, 31.0), (30.0, 30.0)]]
    poly = spark.createDataFrame(list(enumerate(faces_)), f"face bigint, ring array<{P}>")
    use = spark.createDataFrame([(k, "x", r) for k, r in enumerate(uses)], f"way_id bigint, type string, ring array<{P}>")
    landuse.CROWD, kept = 12, landuse.CROWD
    try:
        got = {(r["face"], r["way_id"]): r["share"] for r in landuse.overlaps(poly, use, 1e-4).collect()}
    finally:
        landuse.CROWD = kept
    want = {}
    for f, ring in enumerate(faces_):
        a = np.array(ring)
        area = abs(landuse.fan(a - a[0])[2])
        for w, r in enumerate(uses):
            common = landuse.common_area(a, np.array(r))
            if common > 1e-9 * area:
                want[f, w] = min(1.0, common / area)
    assert set(got) == set(want) and len(want) > 300 and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert landuse.overlaps(poly, use.limit(0), 1e-4).count() == 0


def some_boxes(rnd):
    box = lambda l, b, r, t: {"left": l, "top": t, "right": r, "bottom": b}
    rows = [(i, box(x, y, x + s, y + s)) for i, (x, y, s) in enumerate((rnd.uniform(4, 5), rnd.uniform(50, 51), rnd.choice([0.0, 0.01, 0.3, 2.0])) for _ in range(200))]
    return [*rows, (998, box(-200.0, -85.0, 200.0, 89.9)), (999, None)]


BOXES = "face bigint, box struct<left: double, top: double, right: double, bottom: double>"


def test_tiles_of_boxes_are_looked_up_without_a_join(spark, monkeypatch):
    rnd = random.Random(8)
    df = spark.createDataFrame(some_boxes(rnd), BOXES)
    known = spark.createDataFrame([(rnd.uniform(3.9, 7.1), rnd.uniform(49.9, 53.1)) for _ in range(300)], "lon double, lat double").select(tiles.tile_of(F.col("lon"), F.col("lat")).alias("tile"))
    known = known.unionByName(spark.createDataFrame([(None,), (0,), (2**28 - 1,)], "tile bigint"))
    looked = faces.boxes_in_tiles(df, "face", "box", known)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(faces, "HELD", 5)
    joined = faces.boxes_in_tiles(df, "face", "box", known.distinct())
    got = sorted(map(tuple, looked.collect()))
    assert got == sorted(map(tuple, joined.collect())) and len(got) > 1000


def test_outer_boxes_shuffle_a_row_for_every_tile_only(spark, monkeypatch):
    rnd = random.Random(9)
    rows = some_boxes(rnd)
    df = spark.createDataFrame(rows, BOXES)
    known = spark.createDataFrame([(rnd.uniform(3.9, 7.1), rnd.uniform(49.9, 53.1)) for _ in range(300)], "lon double, lat double").select(tiles.tile_of(F.col("lon"), F.col("lat")).alias("tile")).distinct()
    met = faces.boxes_in_tiles(df, "face", "box", known).collect()
    want, boxes = {}, dict(rows)
    for t, i in met:
        want.setdefault(t, []).append(boxes[i])
    want = {(t, min(b["left"] for b in of), max(b["top"] for b in of), max(b["right"] for b in of), min(b["bottom"] for b in of)) for t, of in want.items()}
    found = faces.outer_boxes(df, "box", known)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    monkeypatch.setattr(faces, "HELD", 5)
    assert {tuple(r) for r in faces.outer_boxes(df, "box", known).collect()} == want


def test_index_of_tiles_forms_few_pairs_at_once():
    import numpy as np

    tile = np.array([y * 2**14 + x for y in range(0, 60, 3) for x in range(5, 90, 2)])
    n = 400
    rnd = np.random.default_rng(3)
    x0, y0 = rnd.integers(-5, 95, n), rnd.integers(-5, 65, n)
    x1, y1 = x0 + rnd.integers(0, 60, n), y0 + rnd.integers(0, 60, n)
    index = faces.KnownTiles(tile, 14)
    got = [p for i, t in index.touched(x0, x1, y0, y1) for p in zip(i.tolist(), index.tile[t].tolist(), strict=True)]
    want = {(i, int(t)) for i in range(n) for t in tile if x0[i] <= t % 2**14 <= x1[i] and y0[i] <= t // 2**14 <= y1[i]}
    assert len(got) == len(want) and set(got) == want
    sizes = np.array([3, 9, 1, 0, 2, 2, 7])
    assert [(c.start, c.stop) for c in faces.chunks(sizes, 4)] == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 7)]
