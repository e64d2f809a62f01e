"""Queries of tile partitioning, features, vector tiles and artefacts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import geo, tiles
from planarloom.functions.trig import flat
from planarloom.operators import faces, graph
from planarloom.plans.face_queries import built, urban_polygons
from planarloom.plans.geometry_queries import RINGS, rings, text_sql
from planarloom.plans.registry import query
from planarloom.plans.tile_queries import N14, tx, ty
from planarloom.runtime import Workspace
from planarloom.sources import artifact, features, osm_xml
from planarloom.sources.tables import CTE, ctes, edge_lines, landuses, nodes, vertices, ways

#: Tiles of located nodes (nt) and of ways by their nodes (wt).
WAY_TILES = f"""nt AS (SELECT node_id, {ty('loc.lat')} * {N14} + {tx('loc.lon')} AS tile FROM nx), wn AS (SELECT DISTINCT way_id, unnest(refs) AS node_id FROM wx),
    wt AS (SELECT DISTINCT way_id, tile FROM wn JOIN nt USING (node_id))"""


def _node_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", tiles.tile_of(F.col("loc.lon"), F.col("loc.lat")).alias("tile"))


def _way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.way_nodes(ways(spark, sf_dir)).select("way_id", "node_id").distinct()


@query(f"{ctes('wx', 'nx')}, {WAY_TILES} SELECT way_id, tile FROM wt")
def way_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of each way's nodes."""
    return _way_nodes(spark, sf_dir).join(_node_tiles(spark, sf_dir), "node_id").select("way_id", "tile").distinct()


@query(f"{ctes('wx', 'nx')}, {WAY_TILES} SELECT DISTINCT node_id, wt.tile FROM wn JOIN nt USING (node_id) JOIN wt USING (way_id) WHERE wt.tile <> nt.tile")
def node_extra_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further tiles each node is needed in: those of the ways that use it."""
    at = _way_nodes(spark, sf_dir).join(_node_tiles(spark, sf_dir), "node_id")
    other = at.select("way_id", F.col("tile").alias("other")).distinct()
    return at.join(other, "way_id").where("other <> tile").select("node_id", F.col("other").alias("tile")).distinct()


@query(
    f"""{ctes('wx', 'nx')}, {WAY_TILES}, x AS (SELECT DISTINCT node_id, wt.tile FROM wn JOIN nt USING (node_id) JOIN wt USING (way_id) WHERE wt.tile <> nt.tile),
    n AS (SELECT tile, count(*) AS n FROM (SELECT node_id, tile FROM nt UNION ALL SELECT node_id, tile FROM x) GROUP BY tile), w AS (SELECT tile, count(*) AS n FROM wt GROUP BY tile)
    SELECT tile, coalesce(n.n, 0) AS n_nodes, coalesce(w.n, 0) AS n_ways FROM n FULL JOIN w USING (tile)"""
)
def tile_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and ways of every tile, as written to and read from XML files partitioned by tile: nodes in their own tile and in
    those of the ways that use them."""
    work = Workspace(spark, "partition")
    own = nodes(spark, sf_dir).select("node_id", "loc.lon", "loc.lat", F.array().cast("array<struct<k:string,v:string>>").alias("tags"))
    at = _node_tiles(spark, sf_dir).unionByName(node_extra_tiles(spark, sf_dir))
    osm_xml.write_nodes(own.join(at, "node_id"), f"{work.path}/nodes")
    osm_xml.write_ways(ways(spark, sf_dir).join(way_tiles(spark, sf_dir), "way_id"), f"{work.path}/ways")
    n = osm_xml.nodes(spark, f"{work.path}/nodes/*/*").select("node_id", F.regexp_extract(F.col("_metadata.file_path"), r"tile=(\d+)", 1).cast("bigint").alias("tile"))
    w = osm_xml.ways(spark, f"{work.path}/ways/*/*").select("way_id", F.regexp_extract(F.col("_metadata.file_path"), r"tile=(\d+)", 1).cast("bigint").alias("tile"))
    n, w = (x.groupBy("tile").agg(F.count(F.lit(1)).alias(c)) for x, c in ((n, "n_nodes"), (w, "n_ways")))
    return n.join(w, "tile", "full").select("tile", F.coalesce("n_nodes", F.lit(0)).cast("bigint").alias("n_nodes"), F.coalesce("n_ways", F.lit(0)).cast("bigint").alias("n_ways"))


@query(f"{ctes('vx')}, t AS (SELECT {ty('loc.lat')} * {N14} + {tx('loc.lon')} AS tile FROM vx) SELECT tile, count(*) AS n_vertices, CASE WHEN tile % 2 = 0 THEN 1 ELSE 2 END AS written_by FROM t GROUP BY tile")
def incremental_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of vertices written in two runs: the first writes the even tiles, the second all that are not there yet."""
    path = f"{Workspace(spark, 'incremental').path}/tiles"
    v = vertices(spark, sf_dir).select("v", tiles.tile_of(F.col("loc.lon"), F.col("loc.lat")).alias("tile"))
    write_missing_tiles(v.where(F.col("tile") % 2 == 0).withColumn("written_by", F.lit(1)), path)
    write_missing_tiles(v.withColumn("written_by", F.lit(2)), path)
    return spark.read.parquet(path).groupBy(F.col("tile").cast("bigint").alias("tile")).agg(F.count(F.lit(1)).alias("n_vertices"), F.min("written_by").alias("written_by"))


def write_missing_tiles(rows: DataFrame, path: str) -> None:
    """Write the tiles of ``rows`` that are not below ``path`` yet, partitioned by tile; those that are stay as they are."""
    spark = rows.sparkSession
    from planarloom.runtime import hadoop_path

    fs, p = hadoop_path(spark, path)
    done = [(int(x.getPath().getName().split("=")[1]),) for x in fs.listStatus(p) if x.getPath().getName().startswith("tile=")] if fs.exists(p) else []
    known = spark.createDataFrame(done, "tile bigint")
    rows.join(known, "tile", "left_anti").write.mode("append").partitionBy("tile").parquet(path)


@query(f"{ctes('lx')}, {RINGS} SELECT DISTINCT rg.way_id, lx.type, 'Polygon' AS kind, {text_sql('rg.ring')} AS points FROM rg JOIN lx ON lx.way_id = rg.way_id AND lx.ring = rg.ring")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land uses written as GeoJSON features, one per line, and read back."""
    work = Workspace(spark, "geojson")
    rows = landuses(spark, sf_dir).join(rings(spark, sf_dir).distinct(), ["way_id", "ring"], "left_semi")
    f = rows.select(features.feature("Polygon", F.col("ring"), F.struct(F.col("way_id").cast("string").alias("way_id"), "type")).alias("value"))
    f.write.text(f"{work.path}/features")
    back = features.read_features(spark.read.text(f"{work.path}/features"), "value")
    return back.select(F.col("properties")["way_id"].cast("bigint").alias("way_id"), F.col("properties")["type"].alias("type"), "kind", geo.points_text(F.col("points")).alias("points")).distinct()


@query(
    f"""{ctes('vx', 'ex', 'eg', 'lx')}, {RINGS} SELECT 'edge' AS kind, e AS id, {text_sql('pts')} AS points FROM eg UNION ALL SELECT 'vertex', v, {text_sql('[loc]')} FROM vx
    UNION ALL SELECT 'landuse', way_id, {text_sql('ring')} FROM (SELECT DISTINCT way_id, ring FROM rg)"""
)
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of features in one table: lines of edges, points of vertices, outlines of land uses."""
    e = edge_lines(spark, sf_dir).select(F.lit("edge").alias("kind"), F.col("e").alias("id"), "pts")
    v = vertices(spark, sf_dir).select(F.lit("vertex").alias("kind"), F.col("v").alias("id"), F.array("loc").alias("pts"))
    r = rings(spark, sf_dir).distinct().select(F.lit("landuse").alias("kind"), F.col("way_id").alias("id"), F.col("ring").alias("pts"))
    return e.unionByName(v).unionByName(r).select("kind", "id", geo.points_text(F.col("pts")).alias("points"))


def _artifact(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = built(spark, sf_dir, "polygons")
    return artifact.tables(t["graph"], t["assigned"], t["polygons"])


@query()
def artifact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every tile of the artefact of the planar graph, written and read back with all references met."""
    work = Workspace(spark, "artifact")
    artifact.write(_artifact(spark, sf_dir), f"{work.path}/artifact")
    back = artifact.read(spark, f"{work.path}/artifact")
    counts = [df.groupBy(F.col("tile").cast("bigint").alias("tile")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name)) for name, df in back.items()]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.select("tile", "kind", "n")


@query()
def artifact_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, edges and faces of every binary tile of the planar graph, read back from the files."""
    work = Workspace(spark, "binary")
    files = work.cut(artifact.binary_tiles(_artifact(spark, sf_dir)), "files")
    return artifact.read_binary(files).drop("guids")


@query()
def vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer of the scored polygons in every tile with vertices that they touch, as vector tiles."""
    work = Workspace(spark, "mvt")
    scored = work.cut(urban_polygons(spark, sf_dir).select("face", "face_guid", "type", "share"), "scored")
    p = built(spark, sf_dir, "polygons")["polygons"]
    known = vertices(spark, sf_dir).select(tiles.tile_of(F.col("loc.lon"), F.col("loc.lat")).alias("tile")).distinct()
    rows = scored.join(p.select("face", "ring"), "face").drop("face")
    return layers(drawn(rows, known))


def drawn(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``tile``, ``face_guid``, ``type``, ``share``, ``commands``: each polygon (ring) in every tile of ``known`` that its box touches,
    drawn in the tile's units. Every task holds the tiles; for more than ``faces.HELD``, polygons and tiles are joined."""
    box, spark = geo.to_box(F.col("ring")), rows.sparkSession
    index, keep, sides = faces.known_tiles(known), ["face_guid", "type", "share"], ["left", "top", "right", "bottom"]
    if index is None:
        rows = Workspace(spark, "drawn").cut(rows.withColumn("_i", F.monotonically_increasing_id()), "rows")
        met = faces.boxes_in_many_tiles(rows.withColumn("box", box), "_i", "box", known).join(rows, "_i")
        at = met.withColumn("b", tiles.box(F.col("tile"))).select("tile", *keep, "ring", "b.*")
        held = None
    else:
        at = rows.where(box.isNotNull()).select(*keep, "ring", *faces.spans(box)).dropna(subset=["x0", "x1", "y0", "y1"])
        b = spark.createDataFrame(pa.table({"tile": index.tile})).withColumn("b", tiles.box(F.col("tile"))).select("tile", "b.*").toArrow().sort_by("tile")
        held = spark.sparkContext.broadcast((index.tile, np.stack([b[k].to_numpy() for k in sides], 1)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None:
            all_tiles, corners = held.value
            index = faces.KnownTiles(all_tiles, tiles.ZOOM)
        for batch in batches:
            if not len(batch):
                continue
            points, starts = flat(batch.column("ring"))
            if held is None:
                i, own = np.arange(len(batch)), batch.column("tile").to_numpy()
                found = [(i, own, np.stack([batch.column(k).to_numpy() for k in sides], 1))]
            else:
                found = ((i, index.tile[t], corners[t]) for i, t in index.touched(*(batch.column(k).to_numpy() for k in ("x0", "x1", "y0", "y1"))))
            for i, tile, corner in found:
                for few in faces.chunks(np.diff(starts)[i]):
                    j = pa.array(i[few])
                    commands = features.outlines(points, starts, i[few], corner[few]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(tile[few]), *[batch.column(k).take(j) for k in keep], commands], names=["tile", *keep, "commands"])

    return at.mapInArrow(draw, "tile bigint, face_guid string, type string, share double, commands binary")


def layers(drawings: DataFrame) -> DataFrame:
    """``tile``, ``n_features``, ``n_bytes``, ``mvt``: the layer of every tile."""

    def layer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("face_guid", "ascending"), ("commands", "ascending")])
        columns = (table[k].to_pylist() for k in ("commands", "face_guid", "type", "share"))
        made = [(c, {"face_guid": g, "type": t, "share": None if s != s else s}) for c, g, t, s in zip(*columns, strict=True)]
        raw = features.encoded_layer("urban-polygons", made)
        return pa.table({"tile": [key[0].as_py()], "n_features": pa.array([len(made)], pa.int32()), "n_bytes": pa.array([len(raw)], pa.int32()), "mvt": [raw]})

    return drawings.groupBy("tile").applyInArrow(layer, "tile bigint, n_features int, n_bytes int, mvt binary")


@query("SELECT 'urban-polygons' AS layer, 9 AS min_zoom, 14 AS max_zoom UNION ALL SELECT 'landuse', 14, 14")
def tile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of the two tile sets."""
    sets = [("urban-polygons", 9, 14), ("landuse", 14, 14)]
    rows = [(layer, low, top, json.dumps(features.tile_json(layer, low, top, f"{layer}/{{z}}/{{x}}/{{y}}.mvt", layer))) for layer, low, top in sets]
    return spark.createDataFrame(rows, "layer string, min_zoom int, max_zoom int, json string").drop("json")
