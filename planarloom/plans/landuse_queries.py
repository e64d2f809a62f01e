"""Queries of land-use polygons, their overlap with faces and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import geo, rules, tiles
from planarloom.operators import landuse
from planarloom.plans.face_queries import USE_SQUARE, built
from planarloom.plans.geometry_queries import RINGS, box_sql, rings
from planarloom.plans.registry import query
from planarloom.plans.tile_queries import N14, classified_sql, tx, ty
from planarloom.runtime import Workspace
from planarloom.sources.tables import CTE, ctes, landuses, nodes, ways


@query(
    f"""{classified_sql(rules.LANDUSE_RULES, 'landuse')}, {CTE['nx']}, cw AS (SELECT way_id, refs, landuse FROM wx JOIN best USING (way_id) WHERE len(refs) > 0 AND refs[1] = refs[len(refs)]),
    n AS (SELECT way_id, landuse, unnest(refs) AS node_id FROM cw)
    SELECT way_id, landuse, CAST(count(*) AS BIGINT) AS n_refs, count(loc) AS n_located FROM n LEFT JOIN nx USING (node_id) GROUP BY way_id, landuse"""
)
def landuse_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed ways with a land use: those whose first node is the last."""
    w = ways(spark, sf_dir).where((F.size("refs") > 0) & (F.try_element_at("refs", F.lit(1)) == F.try_element_at("refs", F.lit(-1))))
    w = w.select("way_id", "refs", rules.classify(F.col("tags"), rules.LANDUSE_RULES).alias("landuse")).where("landuse is not null")
    n = w.select("way_id", "landuse", F.explode("refs").alias("node_id")).join(nodes(spark, sf_dir), "node_id", "left")
    return n.groupBy("way_id", "landuse").agg(F.count(F.lit(1)).alias("n_refs"), F.count("loc").alias("n_located"))


@query(
    f"""{ctes('lx')}, {RINGS}, b AS (SELECT way_id, {box_sql('ring')} AS b FROM rg), x AS (SELECT way_id, b, unnest(range({tx('b.left')}, {tx('b.right')} + 1)) AS x FROM b),
    y AS (SELECT way_id, x, unnest(range({ty('b.top')}, {ty('b.bottom')} + 1)) AS y FROM x) SELECT DISTINCT y * {N14} + x AS tile, way_id FROM y"""
)
def landuse_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land uses whose ring's box touches each tile, each once."""
    b = rings(spark, sf_dir).select("way_id", geo.to_box(F.col("ring")).alias("b"))
    t = b.select("way_id", F.explode(tiles.tiles_for(F.col("b.left"), F.col("b.top"), F.col("b.right"), F.col("b.bottom"))).alias("t"))
    return t.select(tiles.local_id(F.col("t.x"), F.col("t.y")).alias("tile"), "way_id").distinct()


def _use(spark: SparkSession, sf_dir: str, work: Workspace) -> DataFrame:
    """``way_id``, ``type``, ``ring``: closed rings with a type, each way once."""
    kinds = landuses(spark, sf_dir).select("way_id", F.lower(F.trim("type")).alias("type")).where("type <> ''").groupBy("way_id").agg(F.min("type").alias("type"))
    one = rings(spark, sf_dir).groupBy("way_id").agg(F.min("ring").alias("ring"))
    return work.cut(one.join(kinds, "way_id"), "landuse")


def _overlaps(spark: SparkSession, sf_dir: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    p = built(spark, sf_dir, "polygons")["polygons"]
    use = _use(spark, sf_dir, work)
    return work.cut(landuse.overlaps(p.where("not is_outer").select("face", "ring"), use, USE_SQUARE), "overlaps"), use


@query()
def landuse_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each inner face of the planar graph that each land use covers."""
    return _overlaps(spark, sf_dir, Workspace(spark, "overlap"))[0].withColumn("share", F.round("share", 9))


@query()
def landuse_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each inner face of the planar graph that each type of land use covers."""
    return landuse.share_by_type(*_overlaps(spark, sf_dir, Workspace(spark, "share"))).withColumn("share", F.round("share", 9))


@query(
    f"""{ctes('lx')}, {RINGS}, k AS (SELECT way_id, min(lower(trim(type))) AS type FROM lx WHERE trim(type) <> '' GROUP BY way_id), r AS (SELECT way_id, min(ring) AS ring FROM rg GROUP BY way_id),
    s AS (SELECT way_id, type, {ty('ring[1].lat')} * {N14} + {tx('ring[1].lon')} AS tile, len(ring) AS n FROM r JOIN k USING (way_id)),
    w AS (SELECT tile, type, sum(n) AS weight FROM s GROUP BY tile, type)
    SELECT tile, arg_min(type, {{'a': -weight, 'b': type}}) AS type FROM w GROUP BY tile"""
)
def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of land use with the most outline points in each tile; of equal ones the first by name."""
    use = _use(spark, sf_dir, Workspace(spark, "dominant"))
    at = use.select(tiles.tile_of(F.col("ring")[0]["lon"], F.col("ring")[0]["lat"]).alias("tile"), "type", F.size("ring").alias("n"))
    return landuse.dominant(at.groupBy("tile", "type").agg(F.sum("n").alias("share")), "tile")
