"""Queries of the general data-preparation problems (2, 3 and 5) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.operators import compaction, keyed_stats, proximity
from planarloom.plans import registry
from planarloom.runtime import Workspace
from planarloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that stands complete in a file of a cache folder, once, from the compacted folders."""
    return compaction.compact_folders(table(spark, sf_dir, "cache_file"), Workspace(spark, "p2")).select("cache_folder", "kind", "elem_id", "rev")


def p2_folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files, files under 4,096 bytes and bytes each folder has. Compaction chooses by its own, larger limit."""
    stats = compaction.folder_stats(table(spark, sf_dir, "cache_file"), 4096)
    return stats.select("cache_folder", "n_files", "n_small", F.col("n_bytes").cast("bigint").alias("n_bytes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that hold more than 2 % of all distinct vertices."""
    return keyed_stats.hot_keys(table(spark, sf_dir, "vertex"), "tile", "v", 0.02).select("tile")


def p3_tile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, boxes and degrees of every tile."""
    return keyed_stats.tile_summary(table(spark, sf_dir, "vertex"), table(spark, sf_dir, "edge"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices at most 0.25 m apart, and the land-use outlines each vertex lies in."""
    vertex = table(spark, sf_dir, "vertex")
    near = proximity.near_pairs(vertex, "v", 0.25).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = proximity.points_in_rings(vertex, "v", table(spark, sf_dir, "landuse"), "way_id", "ring", Workspace(spark, "p5"))
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b")))


QUERIES = {"p2_found": p2_found, "p2_folder_stats": p2_folder_stats, "p3_found": p3_found, "p3_tile_summary": p3_tile_summary, "p5_found": p5_found}

ORACLE = {
    "p2_found": r"""
        WITH line AS (
          SELECT cache_folder, trim(unnest(string_split(content, chr(10))), ' ' || chr(9) || chr(13)) AS l FROM cache_file WHERE cache_folder IS NOT NULL),
        obj AS (SELECT cache_folder, l::JSON AS j FROM line WHERE l LIKE '{%' AND json_valid(l)),
        rec AS (SELECT cache_folder, j->>'kind' AS kind, TRY_CAST(j->>'id' AS BIGINT) AS elem_id, TRY_CAST(j->>'rev' AS INTEGER) AS rev FROM obj)
        SELECT DISTINCT cache_folder, kind, elem_id, rev FROM rec WHERE kind IN ('n','w') AND elem_id IS NOT NULL AND rev IS NOT NULL""",
    "p2_folder_stats": """
        SELECT cache_folder, count(*) AS n_files, count(*) FILTER (coalesce(strlen(content), 0) < 4096) AS n_small, CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS n_bytes
        FROM cache_file WHERE cache_folder IS NOT NULL GROUP BY cache_folder""",
    "p3_found": """
        SELECT tile FROM vertex WHERE tile IS NOT NULL GROUP BY tile
        HAVING count(DISTINCT v) > 0.02 * (SELECT count(DISTINCT v) FROM vertex)""",
    "p3_tile_summary": """
        WITH ends AS (SELECT DISTINCT e, v FROM (SELECT e, v1 AS v FROM edge UNION ALL SELECT e, v2 FROM edge) WHERE e IS NOT NULL AND v IS NOT NULL),
        degree AS (SELECT v, count(*) AS degree FROM ends GROUP BY v),
        own AS (SELECT tile, v, count(*) AS n_rows, max({'lon': lon, 'lat': lat}) FILTER (lon IS NOT NULL AND lat IS NOT NULL) AS loc
          FROM vertex WHERE tile IS NOT NULL AND v IS NOT NULL GROUP BY tile, v)
        SELECT tile, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_vertices, count(loc) AS n_located,
          min(loc.lon) AS box_left, max(loc.lat) AS box_top, max(loc.lon) AS box_right, min(loc.lat) AS box_bottom,
          CAST(sum(coalesce(degree, 0)) AS BIGINT) AS degree_sum, max(coalesce(degree, 0)) AS degree_max
        FROM own LEFT JOIN degree USING (v) GROUP BY tile""",
    "p5_found": """
        WITH p AS (SELECT DISTINCT v, lon, lat, CAST(floor(lat / 2.25e-6) AS BIGINT) AS r, CAST(floor(lon / 5e-6) AS BIGINT) AS c FROM vertex WHERE lon IS NOT NULL AND lat IS NOT NULL),
        around AS (SELECT v, lon, lat, r + dr AS r, c + dc AS c FROM p, (VALUES (-1),(0),(1)) AS a(dr), (VALUES (-1),(0),(1)) AS b(dc)),
        near AS (SELECT DISTINCT p.v AS id_a, q.v AS id_b FROM p JOIN around q ON p.r = q.r AND p.c = q.c AND p.v < q.v
          WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) <= 0.25),
        ring AS (SELECT DISTINCT way_id, ring FROM landuse WHERE ring IS NOT NULL AND len(ring) >= 4 AND ring[1] = ring[len(ring)]),
        box AS (SELECT way_id, ring, list_min([x.lon FOR x IN ring]) AS l, list_max([x.lon FOR x IN ring]) AS rr, list_min([x.lat FOR x IN ring]) AS b, list_max([x.lat FOR x IN ring]) AS t FROM ring),
        cell AS (SELECT box.*, g.cx, h.cy FROM box, LATERAL (SELECT unnest(range(CAST(floor(l / 0.005) AS BIGINT), CAST(floor(rr / 0.005) AS BIGINT) + 1)) AS cx) g,
          LATERAL (SELECT unnest(range(CAST(floor(b / 0.005) AS BIGINT), CAST(floor(t / 0.005) AS BIGINT) + 1)) AS cy) h),
        cand AS (SELECT p.v, p.lon, p.lat, c.way_id, c.ring FROM p JOIN cell c ON CAST(floor(p.lon / 0.005) AS BIGINT) = c.cx AND CAST(floor(p.lat / 0.005) AS BIGINT) = c.cy
          WHERE p.lon BETWEEN c.l AND c.rr AND p.lat BETWEEN c.b AND c.t),
        seg AS (SELECT v, way_id, lon, lat, ring[i] AS a, ring[i + 1] AS z FROM (SELECT *, unnest(range(1, len(ring))) AS i FROM cand)),
        inside AS (SELECT v AS id_a, way_id AS id_b FROM seg GROUP BY v, way_id
          HAVING count(*) FILTER ((a.lat > lat) <> (z.lat > lat) AND lon < (z.lon - a.lon) * (lat - a.lat) / (z.lat - a.lat) + a.lon) % 2 = 1)
        SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT 'inside', id_a, id_b FROM inside""",
}

registry.QUERIES.update(QUERIES)
registry.ORACLE.update(ORACLE)
