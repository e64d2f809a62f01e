"""Points near other points, and the regions that hold a point.

``near_pairs`` is a grid equi-join on columns only. ``points_in_rings`` cuts each ring into triangles by ear clipping and
spreads them over a bounding-volume hierarchy: triangles in Z-order fall into ranges, the treelets, and these into ``FINE``
equal parts. The boxes of all parts, whose number is bounded, are the upper tree that every task holds; points descend it and
those in no box are dropped. Parts of one treelet that hold no more than ``tri_block`` triangles together meet their points
in tasks of bounded size, which build the lower tree and test the candidate triangles exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarloom.functions.trig import BoxTree, clean_ring, morton, orient_many, triangles
from planarloom.runtime import Workspace, broadcast_if_small

EARTH_M = 6_371_000.0
#: Points of a cell that one task compares with the others.
CELL_POINTS = 2_000
#: Triangles per treelet, as long as their number is not bounded, and parts of a treelet.
TREELET, FINE = 512, 128
#: Rows and cells of the grid are this many times the distance wide, so most points are looked for in one cell only.
CELL_WIDTHS = 16


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two locations on a sphere of radius ``EARTH_M``."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), s))))


def located(points: DataFrame, ident: str) -> DataFrame:
    """Distinct (``ident``, lon, lat) without nulls and NaN."""
    rows = points.select(F.col(ident).alias("id"), "lon", "lat").where("id is not null and lon is not null and lat is not null")
    return rows.where(~F.isnan("lon") & ~F.isnan("lat")).distinct()


def near_pairs(points: DataFrame, ident: str, metres: float) -> DataFrame:
    """``id_a`` < ``id_b`` of all pairs of different ``ident`` whose locations are at most ``metres`` apart.

    Latitude rows are ``CELL_WIDTHS`` times the distance high; in a row, cells are as many times as wide as the largest
    longitude difference the distance allows there, in a whole number around the globe, so the antimeridian and the poles need no special case.
    Each point stands once in its own cell and is looked for in the one to four cells its surroundings touch, so a pair
    is made once. Rows with null or NaN coordinates are left out; repeated rows and several locations per ``ident``
    count once; empty input gives no rows.
    """
    dlat = float(np.degrees(metres / EARTH_M) * (1 + 1e-6))
    half = float(np.sin(metres / EARTH_M / 2) * (1 + 1e-6))
    height = CELL_WIDTHS * dlat
    pts = located(points, ident)

    def cells(row: Column) -> tuple[Column, Column]:
        """Largest longitude difference in a row and the number of its cells."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + dlat)
        dlon = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(half) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)))))
        return dlon, F.greatest(F.lit(1), F.floor(F.lit(360.0 / CELL_WIDTHS) / dlon))

    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    row = F.floor(F.col("lat") / height)
    home = pts.select(F.col("id").alias("id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), row.alias("row"), east.alias("_e"))
    _, n = cells(F.col("row"))
    home = home.withColumn("cell", F.least(n - 1, F.floor(F.col("_e") / (F.lit(360.0) / n)))).drop("_e")
    rows = F.sequence(F.floor((F.col("lat") - dlat) / height), F.floor((F.col("lat") + dlat) / height))
    probe = pts.select(F.col("id").alias("id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), east.alias("_e"), F.explode(rows).alias("row"))
    dlon, n = cells(F.col("row"))
    width = F.lit(360.0) / n
    span = F.sequence(F.floor((F.col("_e") - dlon) / width), F.floor((F.col("_e") + dlon) / width))
    around = F.when(n <= 4, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array_distinct(F.transform(span, lambda c: F.pmod(c, n))))
    probe = probe.withColumn("cell", F.explode(around)).drop("_e")
    # A cell of very many points is dealt out: its points to one task each, those looked for in it to all of them.
    crowded = home.groupBy("row", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_POINTS).cast("int").alias("_n")).where("_n > 1")
    crowded = broadcast_if_small(crowded, 100_000)
    parts = F.coalesce("_n", F.lit(1))
    home = home.join(crowded, ["row", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("id_a"), parts).cast("int")).drop("_n")
    probe = probe.join(crowded, ["row", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    close = haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) <= metres
    return home.join(probe, ["row", "cell", "salt"]).where(F.col("id_a") < F.col("id_b")).where(close).select("id_a", "id_b").distinct()


TRIANGLES = "region bigint, parity boolean, ax double, ay double, bx double, by double, cx double, cy double, z bigint"


def triangulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triangles of rings (region, xs, ys). A ring that crosses itself, so that ear clipping stops, gives the fan of
    triangles from its first point with ``parity``: a point is inside iff an odd number of them holds it by the half-open
    even-odd test, in which the diagonals that two of them share cancel and the ring's own edges are left."""
    names = [c.split()[0] for c in TRIANGLES.split(", ")]
    for pdf in batches:
        ids, rings = [], []
        for region, xs, ys in zip(pdf["region"], pdf["xs"], pdf["ys"], strict=True):
            ring = clean_ring(list(xs), list(ys))
            if np.isfinite(np.array(ring, float)).all():
                ids.append(region)
                rings.append(ring)
        rows = []
        for region, ring, ears in zip(ids, rings, triangles(rings), strict=True):
            for a, b, c in [(0, i, i + 1) for i in range(1, len(ring) - 1)] if ears is None else ears:
                rows.append((region, ears is None, *ring[a], *ring[b], *ring[c]))
        t = pd.DataFrame(rows, columns=names[:-1])
        x, y = t[["ax", "bx", "cx"]].to_numpy(float), t[["ay", "by", "cy"]].to_numpy(float)
        t["z"] = morton(x.mean(1), y.mean(1)) if len(t) else np.zeros(0, np.int64)
        yield t


def regions(polygons: DataFrame, ident: str, ring: str) -> DataFrame:
    """``region``, ``xs``, ``ys`` of each distinct ring of four or more points whose last equals its first.

    Null rings, rings with null points or coordinates, unclosed and short ones are no regions.
    """
    r = F.col("r")
    closed = (F.size(r) >= 4) & (F.try_element_at(r, F.lit(1))["lon"] == F.try_element_at(r, F.lit(-1))["lon"]) & (F.try_element_at(r, F.lit(1))["lat"] == F.try_element_at(r, F.lit(-1))["lat"])
    whole = ~F.exists(r, lambda p: p["lon"].isNull() | p["lat"].isNull())
    rows = polygons.select(F.col(ident).alias("region"), F.col(ring).alias("r")).where("region is not null and r is not null").where(closed & whole)
    return rows.select("region", F.transform("r", lambda p: p["lon"]).alias("xs"), F.transform("r", lambda p: p["lat"]).alias("ys")).distinct()


def points_in_rings(points: DataFrame, ident: str, polygons: DataFrame, region: str, ring: str, work: Workspace, treelets: int = 512, block: int = 50_000, tri_block: int = 100_000) -> DataFrame:
    """``id``, ``region`` of every point inside or on the border of a region; each pair once. Of a ring that crosses or touches
    itself, points inside by the half-open even-odd test on its edges count.

    ``treelets`` times ``FINE`` bounds the upper tree, whose boxes go to the driver and to every task; the treelets then grow
    with the data, and a task still gets no more than ``tri_block`` triangles and ``block`` points. See ``regions`` and
    ``located`` for the rows left out; an ``ident`` with several locations counts for each; empty input gives no rows.
    """
    tri = work.cut(regions(polygons, region, ring).mapInPandas(triangulate, TRIANGLES), "triangles")
    n_tri = tri.count()
    n_let = max(1, min(treelets, n_tri // TREELET))
    steps = [i / n_let for i in range(1, n_let)]
    bounds = sorted({int(x) for x in tri.approxQuantile("z", steps, 1 / (4 * n_let)) or []}) if n_tri and steps else []
    let_of = F.expr("0") if not bounds else _treelet(F.col("z"), bounds)
    order = Window.partitionBy("let").orderBy("z", "region", "ax", "ay", "bx", "by", "cx", "cy")
    placed = tri.withColumn("let", let_of.cast("int")).withColumn("fine", F.ntile(FINE).over(order) - 1)
    groups = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("let")) / tri_block)
    placed = work.cut(placed.withColumn("part", F.floor(F.col("fine") * F.least(groups, F.lit(FINE)) / FINE).cast("int")), "placed")
    low = lambda c: F.min(F.least(*[f"{p}{c}" for p in "abc"]))
    top = lambda c: F.max(F.greatest(*[f"{p}{c}" for p in "abc"]))
    upper = placed.groupBy("let", "fine", "part").agg(low("x").alias("l"), low("y").alias("b"), top("x").alias("r"), top("y").alias("t"), F.count(F.lit(1)).alias("n")).toPandas()
    upper = upper.sort_values(["let", "fine"])
    boxes = upper[["l", "b", "r", "t"]].to_numpy(float).reshape(-1, 4)
    keys = upper[["let", "part"]].to_numpy(np.int64).reshape(-1, 2)
    place = keys[:, 0] * FINE + keys[:, 1]
    deals = {int(k): -(-int(n) // tri_block) for k, n in upper["n"].groupby(place).sum().items()}

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = BoxTree(boxes)
        for pdf in batches:
            x, y = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
            p, k = tree.hits(x, y) if len(boxes) else (np.zeros(0, int), np.zeros(0, int))
            # A point in several boxes of one group is sent there once.
            pairs = np.unique(p * (1 << 32) + place[k])
            p, k = pairs >> 32, pairs & ((1 << 32) - 1)
            yield pd.DataFrame({"grp": k.astype(np.int32), "id": pdf["id"].to_numpy()[p], "lon": x[p], "lat": y[p]})

    probes = work.cut(located(points, ident).mapInPandas(descend, "grp int, id bigint, lon double, lat double"), "probes")
    shares = {r[0]: r[1] for r in probes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")).collect()}  # a row per group
    table = [(g, n, deals.get(g, 1)) for g, n in shares.items()]
    per = broadcast_if_small(points.sparkSession.createDataFrame(table, "grp int, n int, deals int"), 1 << 17)
    # Both sides are dealt out: points over n tasks, triangles over ``deals``; every pair of shares meets once.
    left = probes.join(per, "grp").withColumn("salt", F.pmod(F.xxhash64("id", "lon", "lat"), F.col("n")).cast("int"))
    left = left.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("grp", "salt", "deal", "id", "lon", "lat")
    right = placed.withColumn("grp", F.col("let") * FINE + F.col("part")).join(per, "grp").withColumn("deal", F.pmod(F.xxhash64("region", "ax", "ay", "bx", "by", "cx", "cy"), F.col("deals")).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n", "deals", "let", "fine", "part")

    def test(pts: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if pts.empty or ts.empty:
            return pd.DataFrame({"id": [], "region": [], "parity": [], "lon": [], "lat": []})
        ts = ts.sort_values("z")
        c = ts[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float)
        xs, ys = c[:, ::2], c[:, 1::2]
        tree = BoxTree(np.stack([xs.min(1), ys.min(1), xs.max(1), ys.max(1)], 1))
        x, y = pts["lon"].to_numpy(float), pts["lat"].to_numpy(float)
        p, k = tree.hits(x, y)
        d = [orient_many(xs[k, i], ys[k, i], xs[k, (i + 1) % 3], ys[k, (i + 1) % 3], x[p], y[p]) for i in range(3)]
        m = np.stack(d)
        ok = (m.min(0) >= 0) | (m.max(0) <= 0)
        parity = ts["parity"].to_numpy(bool)[k]
        if parity.any():
            crossed = np.zeros(len(p), bool)
            for i in range(3):
                ya, yb = ys[k, i], ys[k, (i + 1) % 3]
                crossed ^= ((ya > y[p]) != (yb > y[p])) & (np.where(yb > ya, d[i], -d[i]) > 0)
            ok = np.where(parity, crossed, ok)
        p, k = p[ok], k[ok]
        return pd.DataFrame({"id": pts["id"].to_numpy()[p], "region": ts["region"].to_numpy()[k], "parity": parity[ok], "lon": x[p], "lat": y[p]})

    keys = ["grp", "salt", "deal"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(test, "id bigint, region bigint, parity boolean, lon double, lat double")
    # A point on a shared edge, or in triangles of several parts, has several rows: one assignment is left of them. All of a
    # pair's rows meet by the pair, so that one shuffle serves both steps.
    met = found.repartition("id", "region").groupBy("id", "region", "lon", "lat").agg(F.bool_or(~F.col("parity")).alias("plain"), F.count(F.lit(1)).alias("n"))
    return met.where(F.col("plain") | (F.col("n") % 2 == 1)).select("id", "region").distinct()


def _treelet(z: Column, bounds: list[int]) -> Column:
    """Index of the range of ``bounds`` that holds ``z``, by binary search in one pass of Arrow batches."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, s.to_numpy(), side="right").astype(np.int32))

    return place(z)
