"""Queries of half-edges, turns, loops and faces, and the flow from ways to scored polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import geo, tiles
from planarloom.operators import faces, graph, landuse
from planarloom.plans.geometry_queries import rings
from planarloom.plans.registry import query
from planarloom.plans.tile_queries import N14, TILES
from planarloom.runtime import Workspace
from planarloom.sources.tables import ctes, landuses, line_edges, table, vertices

HALVES = """he AS (SELECT e * 2 AS h, e, v1 AS v_from, v2 AS v_to, atan2(pts[2].lat - pts[1].lat, pts[2].lon - pts[1].lon) AS azimuth FROM eg WHERE v1 <> v2
      UNION ALL SELECT e * 2 + 1, e, v2, v1, atan2(pts[len(pts) - 1].lat - pts[len(pts)].lat, pts[len(pts) - 1].lon - pts[len(pts)].lon) FROM eg WHERE v1 <> v2)"""
AROUND = "(PARTITION BY v_from ORDER BY azimuth, h)"
WHOLE = "(PARTITION BY v_from ORDER BY azimuth, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
RIGHT = f"tr AS (SELECT xor(h, 1) AS h, nullif(coalesce(lead(h) OVER {AROUND}, first_value(h) OVER {WHOLE}), h) AS nx FROM he)"
LEFT = f"tr AS (SELECT xor(h, 1) AS h, nullif(coalesce(lag(h) OVER {AROUND}, last_value(h) OVER {WHOLE}), h) AS nx FROM he)"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.half_edges(line_edges(spark, sf_dir))


@query(f"{ctes('vx', 'ex', 'eg')}, {HALVES} SELECT h, e, v_from, v_to, round(azimuth, 9) AS azimuth FROM he")
def half_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of every edge, with the direction in which they leave."""
    return _halves(spark, sf_dir).withColumn("azimuth", F.round("azimuth", 9))


@query(f"{ctes('vx', 'ex', 'eg')}, {HALVES} SELECT h, v_from AS v, row_number() OVER {AROUND} AS rank, count(*) OVER (PARTITION BY v_from) AS degree FROM he")
def next_clockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the edges around every vertex."""
    return faces.clockwise_order(_halves(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{ctes('vx', 'ex', 'eg')}, {HALVES}, {RIGHT} SELECT h, nx FROM tr")
def next_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-edge that follows by the sharpest turn to the right."""
    return faces.turn(_halves(spark, sf_dir))


@query(f"{ctes('vx', 'ex', 'eg')}, {HALVES}, {LEFT} SELECT h, nx FROM tr")
def next_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-edge that follows by the sharpest turn to the left."""
    return faces.turn(_halves(spark, sf_dir), right=False)


def doubled_sql(source: str, name: str, rounds: int = 22) -> str:
    """Pointer doubling of ``source`` (h, nx): ``name`` (id, nx, mn) holds the cycles only, as ways that end drop out."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT h AS id, nx, least(h, nx) AS mn FROM {source} WHERE nx IS NOT NULL)"]
    for k in range(rounds):
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT a.id, b.nx, least(a.mn, b.mn) AS mn FROM {name}{k} a JOIN {name}{k} b ON a.nx = b.id)")
    steps.append(f"{name} AS (SELECT id, mn FROM {name}{rounds})")
    return ", ".join(steps)


@query(f"{ctes('vx', 'ex', 'eg')}, {HALVES}, {RIGHT}, {doubled_sql('tr', 'cy')} SELECT h, mn AS loop FROM tr LEFT JOIN cy ON id = h")
def face_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop every half-edge lies on when one always turns right."""
    return faces.loops(_halves(spark, sf_dir), Workspace(spark, "loops"))


#: Side in degrees of the smallest squares in which faces meet land uses.
USE_SQUARE = 1e-4

#: Tables of the flow written already, per session and folder of tables: each is built once and read by all queries.
_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


def forget(spark: SparkSession) -> None:
    """Drop what earlier queries of the session have built, so that it is built anew."""
    for key in [k for k in _built if k[0] == spark.sparkContext.applicationId]:
        del _built[key]


def built(spark: SparkSession, sf_dir: str, upto: str) -> dict[str, DataFrame]:
    """Stages of the flow up to ``upto``: ``graph``, the barrier graph of the edge table cut at crossings, without dead ends,
    chains contracted, edges from west to east; ``assigned``, its half-edges with their face; ``rings`` and ``polygons``."""
    have = _built.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    work = Workspace(spark, "flow")

    if "graph" not in have:
        pieces = graph.numbered(graph.split(line_edges(spark, sf_dir), work=work), work)
        work.drop("crossings")
        chains = graph.contract_blocks(graph.prune_blocks(pieces, work), work)
        have["graph"] = graph.standardize(chains).drop("reversed")
        work.drop_all_but("chained", "rest-chains")
    if upto != "graph" and "assigned" not in have:
        have["assigned"], have["rings"] = faces.trace(have["graph"], work)
        work.drop_all_but("chained", "rest-chains", "traced", "rest-faces", "rest-rings")
    if upto == "polygons" and "polygons" not in have:
        have["polygons"] = work.cut(faces.polygons(have["rings"]), "polygons")
    return have


@query()
def assign_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face on the left and on the right of every edge of the planar graph."""
    a = built(spark, sf_dir, "assigned")["assigned"]
    side = lambda b: F.max(F.when(F.col("h") % 2 == b, F.col("face")))
    return a.groupBy("e").agg(side(1).alias("left_face"), side(0).alias("right_face"))


@query()
def face_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of every face of the planar graph."""
    r = built(spark, sf_dir, "rings")["rings"]
    return r.select("face", "n_edges", F.size("ring").alias("n_points"), geo.points_text(F.col("ring")).alias("ring"))


@query()
def face_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon, identifier, area and kind of every face of the planar graph."""
    p = built(spark, sf_dir, "polygons")["polygons"]
    return p.select("face", "face_guid", "n_edges", "signed_area", "is_outer", geo.points_text(F.col("ring")).alias("ring"))


@query()
def face_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of every face of the planar graph."""
    return built(spark, sf_dir, "polygons")["polygons"].select("face", "face_guid")


@query()
def face_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the planar graph that share edges, and how many."""
    return faces.adjacency(built(spark, sf_dir, "assigned")["assigned"])


def _known_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vertex").where("tile is not null").select("tile").distinct()


@query()
def faces_in_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the planar graph whose box touches each tile with vertices."""
    p = built(spark, sf_dir, "polygons")["polygons"]
    return faces.boxes_in_tiles(p.withColumn("box", geo.to_box(F.col("ring"))), "face", "box", _known_tiles(spark, sf_dir))


@query()
def outer_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of all faces of the planar graph that touch each tile with vertices."""
    p = built(spark, sf_dir, "polygons")["polygons"]
    return faces.outer_boxes(p.select(geo.to_box(F.col("ring")).alias("box")), "box", _known_tiles(spark, sf_dir))


@query(
    f"""WITH f AS (SELECT DISTINCT face_guid, face, (tile // {N14} // 4) * 4096 + (tile % {N14}) // 4 AS tile12 FROM face WHERE face_guid IS NOT NULL AND tile IS NOT NULL AND face IS NOT NULL)
    SELECT tile12, face_guid, min(face) AS face FROM f GROUP BY tile12, face_guid"""
)
def faces_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of every tile of zoom 12, put together from its tiles of zoom 14, each identifier once."""
    f = table(spark, sf_dir, "face").where("face_guid is not null and tile is not null and face is not null")
    t = F.col("tile")
    tile12 = tiles.local_id(F.shiftright(tiles.x_of(t), 2), F.shiftright(tiles.y_of(t), 2), 12)
    return f.groupBy(tile12.alias("tile12"), "face_guid").agg(F.min("face").alias("face"))


@query()
def urban_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow: faces of the planar graph with their identifier, their dominant land use and its share."""
    work = Workspace(spark, "urban")
    p = built(spark, sf_dir, "polygons")["polygons"]
    inner = p.where("not is_outer")
    use = rings(spark, sf_dir).join(landuses(spark, sf_dir).select("way_id", "type").distinct(), "way_id").select("way_id", F.lower(F.trim("type")).alias("type"), "ring")
    use = work.cut(use.where("type <> ''").dropDuplicates(["way_id"]), "landuse")
    shares = work.cut(landuse.share_by_type(landuse.overlaps(inner.select("face", "ring"), use, USE_SQUARE), use), "shares")
    # Shares that differ by rounding only are equal; of equal ones the first by name.
    best = shares.groupBy("face").agg(F.min(F.struct((-F.round("share", 9)).alias("s"), F.col("type").alias("t"))).alias("b"))
    out = inner.join(best, "face", "left")
    return out.select("face", "face_guid", "n_edges", "signed_area", F.col("b.t").alias("type"), F.round(-F.col("b.s"), 6).alias("share"))
