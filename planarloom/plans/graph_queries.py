"""Queries of scans, way geometry, graph building, crossings and fix-points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import geo, rules, tiles
from planarloom.operators import graph
from planarloom.plans.geometry_queries import box_sql, text_sql
from planarloom.plans.registry import query
from planarloom.plans.tile_queries import LOADED, N14, cell_sql, classified_sql, tx, ty
from planarloom.runtime import Workspace
from planarloom.sources.tables import CTE, ctes, edge_lines, edges, line_edges, nodes, table, ways


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.barrier_ways(ways(spark, sf_dir))


#: Ways that are barriers (bw), their refs (wn), located refs (ln), and the vertex nodes among these (vn).
BARRIERS = f"""{classified_sql(rules.BARRIER_RULES, 'resistance')}, bw AS (SELECT wx.* FROM wx JOIN best USING (way_id) WHERE len(refs) > 0),
    wn AS (SELECT way_id, i - 1 AS pos, refs[i] AS node_id, i = 1 OR i = len(refs) AS is_end FROM (SELECT way_id, refs, unnest(range(1, len(refs) + 1)) AS i FROM bw) WHERE refs[i] IS NOT NULL),
    {CTE['nx']}, vn AS (SELECT node_id, count(*) AS n_uses, bool_or(is_end) AS is_end FROM wn WHERE node_id IN (SELECT node_id FROM nx) GROUP BY node_id HAVING count(*) > 1 OR bool_or(is_end))"""


@query(f"{ctes('nx')} SELECT node_id, loc.lon AS lon, loc.lat AS lat FROM nx")
def scan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located nodes."""
    return nodes(spark, sf_dir).select("node_id", "loc.lon", "loc.lat")


@query(f"{BARRIERS} SELECT way_id, CAST(len(refs) AS INTEGER) AS n_refs, CAST(len(tags) AS INTEGER) AS n_tags FROM bw")
def scan_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with refs and tags that are barriers."""
    return barriers(spark, sf_dir).select("way_id", F.size("refs").alias("n_refs"), F.size("tags").alias("n_tags"))


@query(
    f"""{ctes('wx', 'nx')}, wn AS (SELECT way_id, i, refs[i] AS node_id FROM (SELECT way_id, refs, unnest(range(1, len(refs) + 1)) AS i FROM wx) WHERE refs[i] IS NOT NULL),
    g AS (SELECT way_id, count(*) - count(loc) AS n_missing, coalesce(list(loc ORDER BY i) FILTER (loc IS NOT NULL), []) AS pts FROM wn LEFT JOIN nx USING (node_id) GROUP BY way_id)
    SELECT way_id, n_missing, CAST(len(pts) AS INTEGER) AS n_points, {text_sql('pts')} AS line FROM g"""
)
def way_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line of every way through its located nodes, and how many refs have no location."""
    wn = graph.way_nodes(ways(spark, sf_dir)).join(nodes(spark, sf_dir), "node_id", "left")
    g = wn.groupBy("way_id").agg(F.count(F.when(F.col("loc").isNull(), 1)).alias("n_missing"), F.array_sort(F.collect_list(F.when(F.col("loc").isNotNull(), F.struct("pos", "loc")))).alias("r"))
    pts = F.transform("r", lambda x: x["loc"])
    return g.select("way_id", "n_missing", F.size("r").alias("n_points"), geo.points_text(pts).alias("line"))


@query("SELECT way_id, min(loaded_at) AS first_loaded, count(*) AS n_deliveries FROM way WHERE way_id IS NOT NULL GROUP BY way_id")
def dedup_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way once, with its first delivery."""
    w = table(spark, sf_dir, "way").where("way_id is not null")
    return w.groupBy("way_id").agg(F.min("loaded_at").alias("first_loaded"), F.count(F.lit(1)).alias("n_deliveries"))


@query(f"{BARRIERS} SELECT node_id, n_uses, is_end FROM vn")
def vertex_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at which barrier ways meet or end."""
    return graph.vertex_nodes(barriers(spark, sf_dir), nodes(spark, sf_dir))


@query(
    f"""{BARRIERS}, r AS (SELECT way_id, pos, node_id, loc, vn.node_id IS NOT NULL AS is_v FROM wn JOIN nx USING (node_id) LEFT JOIN vn USING (node_id)),
    s AS (SELECT *, CAST(sum(CAST(is_v AS INTEGER)) OVER (PARTITION BY way_id ORDER BY pos) AS BIGINT) AS seq FROM r),
    g AS (SELECT way_id, seq, arg_min(node_id, pos) AS node1, list(loc ORDER BY pos) AS own FROM s WHERE seq > 0 GROUP BY way_id, seq),
    n AS (SELECT *, lead(node1) OVER (PARTITION BY way_id ORDER BY seq) AS node2, lead(own[1]) OVER (PARTITION BY way_id ORDER BY seq) AS last FROM g)
    SELECT way_id, seq, node1, node2, CAST(len(own) - 1 AS INTEGER) AS n_shape, {text_sql('list_append(own, last)')} AS line FROM n WHERE node2 IS NOT NULL"""
)
def way_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barrier ways cut into edges between vertices."""
    e = graph.way_edges(barriers(spark, sf_dir), nodes(spark, sf_dir))
    return e.select("way_id", "seq", "node1", "node2", (F.size("pts") - 2).alias("n_shape"), geo.points_text(F.col("pts")).alias("line"))


ENDS = "en AS (SELECT e, v1 AS v, v2 AS other, TRUE AS forward FROM ex UNION ALL SELECT e, v2, v1, FALSE FROM ex WHERE v1 <> v2)"


@query(f"{ctes('ex')}, {ENDS} SELECT v, count(*) AS degree FROM en GROUP BY v")
def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at every vertex; a loop counts once."""
    return graph.degrees(edges(spark, sf_dir))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, b AS (SELECT v1, v2, {box_sql('pts')} AS b FROM eg), u AS (SELECT v1 AS v, b FROM b UNION ALL SELECT v2, b FROM b)
    SELECT v, min(b.left) AS "left", max(b.top) AS top, max(b.right) AS "right", min(b.bottom) AS bottom FROM u GROUP BY v"""
)
def vertex_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of all edges at every vertex."""
    return graph.vertex_boxes(edge_lines(spark, sf_dir))


@query(f"{ctes('ex')}, {ENDS} SELECT v, e, other, forward FROM en")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex's edges, with the vertex at the other end and the direction."""
    return graph.ends(edges(spark, sf_dir)).select("v", "e", "other", "forward")


def cross_sql(o: str, p: str, q: str) -> str:
    return f"(({p}.lon - {o}.lon) * ({q}.lat - {o}.lat) - ({p}.lat - {o}.lat) * ({q}.lon - {o}.lon))"


def apart_sql(p: str, q: str) -> str:
    return f"(({p} < 0 AND {q} > 0) OR ({p} > 0 AND {q} < 0))"


_X1, _X2 = (cross_sql("p.a", "p.b", f"q.{z}") for z in "ab")
_X3, _X4 = (cross_sql("q.a", "q.b", f"p.{z}") for z in "ab")
CROSSINGS = f"""sg AS (SELECT e, i - 1 AS seg, pts[i] AS a, pts[i + 1] AS b FROM (SELECT e, pts, unnest(range(1, len(pts))) AS i FROM eg WHERE v1 <> v2) WHERE pts[i] <> pts[i + 1]),
    xs AS (SELECT *, least(a.lon, b.lon) AS l, greatest(a.lon, b.lon) AS r, least(a.lat, b.lat) AS bt, greatest(a.lat, b.lat) AS t FROM sg),
    cr AS (SELECT p.e AS e1, p.seg AS s1, q.e AS e2, q.seg AS s2, p.a AS a1, p.b AS b1, {_X3} / ({_X3} - {_X4}) AS t1, {_X1} / ({_X1} - {_X2}) AS t2
      FROM xs p JOIN xs q ON p.e < q.e AND p.l <= q.r AND q.l <= p.r AND p.bt <= q.t AND q.bt <= p.t WHERE {apart_sql(_X1, _X2)} AND {apart_sql(_X3, _X4)}),
    cx AS (SELECT *, a1.lon + t1 * (b1.lon - a1.lon) AS lon, a1.lat + t1 * (b1.lat - a1.lat) AS lat FROM cr)"""


@query(f"{ctes('vx', 'ex', 'eg')}, {CROSSINGS} SELECT e1, CAST(s1 AS INTEGER) AS s1, e2, CAST(s2 AS INTEGER) AS s2, round(lon, 9) AS lon, round(lat, 9) AS lat FROM cx")
def segment_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper crossings of the edges' segments."""
    return graph.crossings(line_edges(spark, sf_dir)).select("e1", "s1", "e2", "s2", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, {CROSSINGS}, ct AS (SELECT e1 AS e, s1 AS seg, t1 AS t, lon, lat, 1 AS c FROM cx UNION ALL SELECT e2, s2, t2, lon, lat, 1 FROM cx
      UNION ALL SELECT e, i - 1, 0.0, pts[i].lon, pts[i].lat, 0 FROM (SELECT e, pts, unnest(range(1, len(pts) + 1)) AS i FROM eg WHERE v1 <> v2)),
    o AS (SELECT *, row_number() OVER w AS i, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ct WINDOW w AS (PARTITION BY e ORDER BY seg, t, lon, lat)),
    pc AS (SELECT e, i, lon, lat, k AS piece FROM o UNION ALL SELECT e, i, lon, lat, k + 1 FROM o WHERE c = 1)
    SELECT e, CAST(piece AS BIGINT) AS piece, CAST(count(*) AS INTEGER) AS n_points, round(arg_min(lon, i), 9) AS lon1, round(arg_min(lat, i), 9) AS lat1, round(arg_max(lon, i), 9) AS lon2, round(arg_max(lat, i), 9) AS lat2
    FROM pc GROUP BY e, piece"""
)
def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges cut at every proper crossing."""
    s = graph.pieces(line_edges(spark, sf_dir))
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    return s.select("e", F.col("piece").cast("bigint").alias("piece"), F.size("pts").alias("n_points"), F.round(a["lon"], 9).alias("lon1"), F.round(a["lat"], 9).alias("lat1"), F.round(b["lon"], 9).alias("lon2"), F.round(b["lat"], 9).alias("lat2"))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, s AS (SELECT *, pts[len(pts)].lon < pts[1].lon OR (pts[len(pts)].lon = pts[1].lon AND pts[len(pts)].lat > pts[1].lat) AS reversed FROM eg)
    SELECT e, CASE WHEN reversed THEN v2 ELSE v1 END AS v1, CASE WHEN reversed THEN v1 ELSE v2 END AS v2, reversed, {text_sql('(CASE WHEN reversed THEN list_reverse(pts) ELSE pts END)')} AS line FROM s"""
)
def standardize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges turned to run from west to east."""
    s = graph.standardize(edge_lines(spark, sf_dir))
    return s.select("e", "v1", "v2", "reversed", geo.points_text(F.col("pts")).alias("line"))


def _pruned_sql(rounds: int = 40) -> str:
    """Rounds of removing edges at vertices of degree 1, one after the other, with the count after the last two."""
    steps = ["p0 AS MATERIALIZED (SELECT e, v1, v2 FROM ex)"]
    for k in range(rounds):
        d = f"(SELECT v FROM (SELECT v1 AS v FROM p{k} UNION ALL SELECT v2 FROM p{k} WHERE v1 <> v2) GROUP BY v HAVING count(*) = 1)"
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} WHERE v1 = v2 OR NOT (v1 IN {d} OR v2 IN {d}))")
    return f"{ctes('ex')}, {', '.join(steps)} SELECT e, v1, v2 FROM p{rounds}"


@query(_pruned_sql())
def prune_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left when dead ends are removed again and again."""
    return graph.prune_dead_ends(edges(spark, sf_dir).select("e", "v1", "v2"), Workspace(spark, "prune"))


@query(
    f"""WITH RECURSIVE {CTE['ex']}, {CTE['vx']}, {CTE['eg']}, pl AS (SELECT * FROM eg WHERE v1 <> v2), en AS (SELECT e, v1 AS v, tags FROM eg UNION ALL SELECT e, v2, tags FROM eg WHERE v1 <> v2),
    two AS (SELECT v, min(e) AS a, max(e) AS b FROM en GROUP BY v HAVING count(*) = 2 AND len(list_distinct(list(list_sort(coalesce(tags, []))))) = 1),
    ok AS (SELECT a, b FROM two WHERE v NOT IN (SELECT v1 FROM eg WHERE v1 = v2)), nb AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
    reach AS (SELECT e, e AS other FROM pl UNION SELECT e, b FROM reach JOIN nb ON other = a), chain AS (SELECT e, min(other) AS c FROM reach GROUP BY e)
    SELECT c AS e, count(*) AS n_edges, CAST(sum(len(pts) - 1) AS BIGINT) AS n_segments FROM chain JOIN pl USING (e) GROUP BY c
    UNION ALL SELECT e, 1, CAST(len(pts) - 1 AS BIGINT) FROM eg WHERE v1 = v2"""
)
def contract_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of edges with equal tags as one edge each."""
    c = graph.contract_chains(edge_lines(spark, sf_dir), Workspace(spark, "chains"))
    return c.select("e", "n_edges", (F.size("pts") - 1).cast("bigint").alias("n_segments"))


@query(
    f"""WITH RECURSIVE {CTE['ex']}, {CTE['vx']}, {CTE['eg']}, {LOADED}, et AS (SELECT DISTINCT e, {ty('p.lat')} * {N14} + {tx('p.lon')} AS tile FROM (SELECT e, unnest(pts) AS p FROM eg)),
    nb AS (SELECT DISTINCT a.tile AS a, b.tile AS b FROM et a JOIN et b USING (e) WHERE a.tile <> b.tile), st AS (SELECT min(tile) AS tile FROM et WHERE tile IN (SELECT tile FROM loaded)),
    reach AS (SELECT tile FROM st UNION SELECT b FROM reach JOIN nb ON tile = a) SELECT tile FROM reach WHERE tile NOT IN (SELECT tile FROM st)"""
)
def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that loading the first tile with faces brings in, until none is missing."""
    pts = edge_lines(spark, sf_dir).select("e", F.explode("pts").alias("p")).select("e", tiles.tile_of(F.col("p.lon"), F.col("p.lat")).alias("tile")).distinct()
    loaded = table(spark, sf_dir, "face").where("tile is not null").select("tile").distinct()
    start = pts.join(loaded, "tile", "left_semi").agg(F.min("tile").alias("tile")).where("tile is not null")
    return graph.reachable_tiles(pts, start, Workspace(spark, "tiles")).join(start, "tile", "left_anti")
