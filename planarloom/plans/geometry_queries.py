"""Queries of geometry scalars, boxes, lines and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import geo, tiles
from planarloom.operators import boxes, proximity
from planarloom.plans.data_queries import ORACLE as DATA_SQL
from planarloom.plans.registry import query
from planarloom.plans.tile_queries import BOXES, N14, TILES, left, top, tx, ty
from planarloom.runtime import Workspace
from planarloom.sources.tables import ctes, edge_lines, landuses, table, vertices, ways

SIDES = ("left", "top", "right", "bottom")
#: Rings of at least three different places, closed.
RINGS = "rg AS (SELECT way_id, ring FROM lx WHERE ring IS NOT NULL AND len(ring) >= 4 AND ring[1] = ring[len(ring)])"


def box_sql(pts: str) -> str:
    side = lambda f, k: f"{f}([q.{k} FOR q IN {pts}])"
    return f"{{'left': {side('list_min', 'lon')}, 'top': {side('list_max', 'lat')}, 'right': {side('list_max', 'lon')}, 'bottom': {side('list_min', 'lat')}}}"


def metres_sql(a: str, b: str) -> str:
    return f"(sqrt(pow((radians({b}.lon) - radians({a}.lon)) * cos((radians({a}.lat) + radians({b}.lat)) / 2.0), 2) + pow(radians({b}.lat) - radians({a}.lat), 2)) * 6371000.0)"


def text_sql(pts: str) -> str:
    return f"array_to_string([CAST(CAST(round(q.lon * 1e7) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(q.lat * 1e7) AS BIGINT) AS VARCHAR) FOR q IN {pts}], ';')"


def overlaps_sql(a: str, b: str) -> str:
    return f"{a}.left - {b}.right <= 1e-8 AND {b}.bottom - {a}.top <= 1e-8 AND {b}.left - {a}.right <= 1e-8 AND {a}.bottom - {b}.top <= 1e-8"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_id``, ``ring`` of the closed rings of four or more points."""
    r = F.col("ring")
    ends = (F.try_element_at(r, F.lit(1))["lon"] == F.try_element_at(r, F.lit(-1))["lon"]) & (F.try_element_at(r, F.lit(1))["lat"] == F.try_element_at(r, F.lit(-1))["lat"])
    return landuses(spark, sf_dir).where(r.isNotNull() & (F.size(r) >= 4) & ends).select("way_id", "ring")


@query(
    f"""{ctes('lx')}, {RINGS}, t AS (SELECT way_id, i, ring[i] AS a, ring[i + 1] AS b, ring[i + 2] AS c FROM (SELECT way_id, ring, unnest(range(1, len(ring) - 1)) AS i FROM rg)),
    d AS (SELECT way_id, i, atan2(c.lat - b.lat, c.lon - b.lon) - atan2(a.lat - b.lat, a.lon - b.lon) AS d FROM t WHERE a <> b AND b <> c),
    u AS (SELECT way_id, i, CASE WHEN d < 1e-9 THEN d + 2 * pi() ELSE d END AS d FROM d)
    SELECT way_id, i AS corner, round(CASE WHEN d < 1e-9 THEN 2 * pi() ELSE d END, 6) AS angle FROM u"""
)
def turn_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle at every corner of the rings, from the line arriving to the one leaving."""
    r = F.col("ring")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(r) - 2), lambda i: geo.turn_angle(F.get(r, i - 1), F.get(r, i), F.get(r, i + 1))))
    return rings(spark, sf_dir).select("way_id", at.alias("pos", "a")).where("a is not null").select("way_id", (F.col("pos") + 1).cast("bigint").alias("corner"), F.round("a", 6).alias("angle"))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, s AS (SELECT e, pts[i] AS a, pts[i + 1] AS b FROM (SELECT e, pts, unnest(range(1, len(pts))) AS i FROM eg))
    SELECT e, round(sum({metres_sql('a', 'b')}), 3) AS metres FROM s GROUP BY e"""
)
def edge_length_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every edge's line in metres."""
    p = F.col("pts")
    steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), geo.metres)
    return edge_lines(spark, sf_dir).select("e", F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 3).alias("metres"))


@query(f"{ctes('vx')}, p AS (SELECT v, loc, {{'lon': loc.lon + 0.001, 'lat': loc.lat}} AS o FROM vx) SELECT v, round(loc.lon + 100.0 / {metres_sql('o', 'loc')} * 0.001, 7) AS lon, loc.lat AS lat FROM p")
def offset_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every located vertex moved 100 m to the east."""
    return vertices(spark, sf_dir).select("v", geo.offset_x(F.col("loc"), 100.0).alias("p")).select("v", F.round("p.lon", 7).alias("lon"), "p.lat")


@query(
    """WITH b AS (SELECT DISTINCT way_id, ring, box_left AS bl, box_top AS bt, box_right AS br, box_bottom AS bb FROM landuse
      WHERE way_id IS NOT NULL AND box_left IS NOT NULL AND box_top IS NOT NULL AND box_right IS NOT NULL AND box_bottom IS NOT NULL AND ring IS NOT NULL AND len(ring) > 0),
    x AS (SELECT way_id, least(bl, list_min([q.lon FOR q IN ring])) AS l, greatest(bt, list_max([q.lat FOR q IN ring])) AS t, greatest(br, list_max([q.lon FOR q IN ring])) AS r, least(bb, list_min([q.lat FOR q IN ring])) AS b FROM b)
    SELECT way_id, l AS "left", t AS top, r AS "right", b AS bottom, round((t - b) * (r - l), 12) AS surface FROM x"""
)
def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored box of every land use, widened to hold its ring, and its surface."""
    b = table(spark, sf_dir, "landuse").where("way_id is not null and box_left is not null and box_top is not null and box_right is not null and box_bottom is not null and size(ring) > 0")
    b = b.select("way_id", "ring", *[f"box_{k}" for k in SIDES]).distinct()
    own = F.struct(*[F.col(f"box_{k}").alias(k) for k in SIDES])
    b = b.select("way_id", geo.expand(own, geo.to_box(F.col("ring"))).alias("b"))
    return b.select("way_id", "b.*", F.round(geo.surface(F.col("b")), 12).alias("surface"))


@query(f"{ctes('vx', 'ex', 'eg')}, b AS (SELECT e, {box_sql('pts')} AS b FROM eg) SELECT e, b.left AS \"left\", b.top AS top, b.right AS \"right\", b.bottom AS bottom FROM b")
def edge_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of every edge's line."""
    return edge_lines(spark, sf_dir).select("e", geo.to_box(F.col("pts")).alias("b")).select("e", "b.*")


@query(
    f"""WITH {TILES}, {BOXES}, p AS (SELECT DISTINCT v, lon, lat, tile FROM vertex WHERE v IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND tile IS NOT NULL)
    SELECT v, tile, lon, lat, b < lat AND lat <= t AND l < lon AND lon <= r AS inside FROM p JOIN bx USING (tile)"""
)
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each location lies in the box of the tile it is filed under."""
    p = table(spark, sf_dir, "vertex").where("v is not null and lon is not null and lat is not null and tile is not null").select("v", "tile", "lon", "lat").distinct()
    return p.withColumn("inside", geo.holds(tiles.box(F.col("tile")), F.col("lon"), F.col("lat")))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, b AS (SELECT e, {box_sql('pts')} AS b, {tx('pts[1].lon')} AS x, {ty('pts[1].lat')} AS y FROM eg),
    t AS (SELECT e, b, {left('x')} AS l, {top('y')} AS t, {left('x + 1')} AS r, {top('y + 1')} AS bt FROM b)
    SELECT e, bt < b.top AND b.top <= t AND l < b.left AND b.left <= r AND bt < b.bottom AND b.bottom <= t AND l < b.right AND b.right <= r AS covered, FALSE AS covers_itself FROM t"""
)
def box_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the box of an edge's first tile covers the edge's box, and whether that covers itself (never)."""
    b = F.col("b")
    e = edge_lines(spark, sf_dir).select("e", geo.to_box(F.col("pts")).alias("b"), tiles.box(tiles.tile_of(F.col("pts")[0]["lon"], F.col("pts")[0]["lat"])).alias("t"))
    return e.select("e", geo.covers(F.col("t"), b).alias("covered"), geo.covers(b, b).alias("covers_itself"))


CELL = 0.01


def _ring_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(spark, sf_dir).select("way_id", geo.to_box(F.col("ring")).alias("box")).distinct()


CELLS_SQL = f"""b AS (SELECT DISTINCT way_id, {box_sql('ring')} AS box FROM rg),
    g AS (SELECT way_id, box, unnest(range(CAST(floor(box.left / {CELL}) AS BIGINT) - 1, CAST(floor(box.right / {CELL}) AS BIGINT) + 2)) AS cx FROM b),
    c AS (SELECT way_id, box, cx, unnest(range(CAST(floor(box.bottom / {CELL}) AS BIGINT) - 1, CAST(floor(box.top / {CELL}) AS BIGINT) + 2)) AS cy FROM g)"""


@query(f"{ctes('lx')}, {RINGS}, {CELLS_SQL} SELECT DISTINCT p.way_id AS way_a, q.way_id AS way_b FROM c p JOIN c q USING (cx, cy) WHERE p.way_id < q.way_id AND {overlaps_sql('p.box', 'q.box')}")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of land uses whose rings' boxes meet."""
    b = _ring_boxes(spark, sf_dir)
    return boxes.overlapping_pairs(b, "way_id", "box", CELL).select(F.col("id_a").alias("way_a"), F.col("id_b").alias("way_b")).distinct()


@query(
    f"""{ctes('vx', 'lx')}, {RINGS}, {CELLS_SQL}
    SELECT DISTINCT way_id, v FROM vx JOIN c ON CAST(floor(loc.lon / {CELL}) AS BIGINT) = cx AND CAST(floor(loc.lat / {CELL}) AS BIGINT) = cy
    WHERE box.bottom < loc.lat AND loc.lat <= box.top AND box.left < loc.lon AND loc.lon <= box.right"""
)
def rtree_box_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices in the box of each land use's ring."""
    p = vertices(spark, sf_dir).select("v", F.col("loc.lon").alias("lon"), F.col("loc.lat").alias("lat"))
    return boxes.points_in_boxes(p, "v", _ring_boxes(spark, sf_dir), "way_id", "box", CELL).distinct()


_INSIDE = DATA_SQL["p5_found"].split("ring AS (SELECT", 1)[1].split("SELECT 'near' AS kind")[0]


@query("WITH p AS (SELECT v, loc.lon AS lon, loc.lat AS lat FROM (SELECT v, min({'lon': lon, 'lat': lat}) AS loc FROM vertex WHERE v IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY v)), ring AS (SELECT" + _INSIDE + "SELECT id_a AS v, id_b AS way_id FROM inside")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land uses that hold each located vertex."""
    p = vertices(spark, sf_dir).select("v", F.col("loc.lon").alias("lon"), F.col("loc.lat").alias("lat"))
    inside = proximity.points_in_rings(p, "v", table(spark, sf_dir, "landuse"), "way_id", "ring", Workspace(spark, "pip"))
    return inside.select(F.col("id").alias("v"), F.col("region").alias("way_id"))


@query(
    f"""{ctes('lx')}, {RINGS}, s AS (SELECT way_id, ring, ring[i].lon - ring[1].lon AS x1, ring[i].lat - ring[1].lat AS y1, ring[i + 1].lon - ring[1].lon AS x2, ring[i + 1].lat - ring[1].lat AS y2
      FROM (SELECT way_id, ring, unnest(range(1, len(ring))) AS i FROM rg)), a AS (SELECT way_id, ring, sum((x2 - x1) * (y2 + y1)) / 2.0 AS a FROM s GROUP BY way_id, ring)
    SELECT way_id, round(a, 14) AS signed_area, a > 0 AS is_clockwise FROM a"""
)
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed area of every ring, and whether it runs clockwise."""
    a = rings(spark, sf_dir).select("way_id", geo.signed_area(F.col("ring")).alias("a"))
    return a.select("way_id", F.round("a", 14).alias("signed_area"), (F.col("a") > 0).alias("is_clockwise"))


@query(f"{ctes('vx', 'ex', 'eg')} SELECT e, CAST(len(pts) AS INTEGER) AS n_points, {text_sql('pts')} AS forward, {text_sql('list_reverse(pts)')} AS backward FROM eg")
def complete_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line of every edge, in both directions."""
    return edge_lines(spark, sf_dir).select("e", F.size("pts").alias("n_points"), geo.points_text(F.col("pts")).alias("forward"), geo.points_text(F.reverse("pts")).alias("backward"))


@query(
    f"""{ctes('vx', 'ex', 'eg')} SELECT e, CAST(i - 1 AS INTEGER) AS seg, pts[i].lon AS lon1, pts[i].lat AS lat1, pts[i + 1].lon AS lon2, pts[i + 1].lat AS lat2
    FROM (SELECT e, pts, unnest(range(1, len(pts))) AS i FROM eg)"""
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every straight piece of the edges' lines, numbered."""
    s = boxes.segments(edge_lines(spark, sf_dir), "pts", "e")
    return s.select("e", "seg", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"))


@query(f"{ctes('wx')} SELECT way_id, CAST(i - 1 AS INTEGER) AS pos, refs[i] AS a, refs[i + 1] AS b FROM (SELECT way_id, refs, unnest(range(1, len(refs))) AS i FROM wx)")
def way_id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pairs of node ids in every way."""
    r = F.col("refs")
    pairs = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return ways(spark, sf_dir).where(F.size("refs") > 1).select("way_id", F.posexplode(pairs).alias("pos", "p")).select("way_id", "pos", "p.a", "p.b")
