"""Queries of the tile maths, quantisation, identifiers and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import identity, rules, tiles
from planarloom.plans.registry import query
from planarloom.sources.tables import CTE, ctes, edge_lines, landuses, table, vertices, ways

N14 = 2**14


def tx(lon: str, z: int = 14) -> str:
    return f"CAST(floor(({lon} + 180.0) / 360.0 * {2**z}.0) AS BIGINT)"


def ty(lat: str, z: int = 14) -> str:
    return f"CAST(floor((1.0 - ln(tan({lat} / 180.0 * pi()) + 1.0 / cos({lat} / 180.0 * pi())) / pi()) / 2.0 * {2**z}.0) AS BIGINT)"


def left(x: str, z: int = 14) -> str:
    return f"(({x}) / {2**z}.0 * 360.0 - 180.0)"


def top(y: str, z: int = 14) -> str:
    return f"(atan(sinh(pi() - (2.0 * pi() * ({y})) / {2**z}.0)) * (180.0 / pi()))"


#: Distinct tiles of the vertices with x, y and box; located vertices with x, y and tile; with their cell in the tile.
TILES = f"tl AS (SELECT tile, tile % {N14} AS x, tile // {N14} AS y FROM (SELECT DISTINCT tile FROM vertex WHERE tile IS NOT NULL))"
BOXES = f"bx AS (SELECT *, {left('x')} AS l, {top('y')} AS t, {left('x + 1')} AS r, {top('y + 1')} AS b FROM tl)"
XY = f"xy AS (SELECT v, loc, {tx('loc.lon')} AS x, {ty('loc.lat')} AS y FROM vx)"


def cell_sql(p: str) -> str:
    """A point's quantised cell as a struct (x, y, tile)."""
    x, y = tx(f"{p}.lon"), ty(f"{p}.lat")
    cx = f"CAST(trunc(({p}.lon - {left(x)}) / (({left(x + ' + 1')} - {left(x)}) / 16384.0)) AS INTEGER)"
    cy = f"CAST(trunc(({top(y)} - {p}.lat) / (({top(y)} - {top(y + ' + 1')}) / 16384.0)) AS INTEGER)"
    return f"{{'x': {cx}, 'y': {cy}, 'tile': {y} * {N14} + {x}}}"


def le32_sql(n: str) -> str:
    h = f"printf('%08x', CAST({n} AS BIGINT))"
    return f"(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"


def cell_hex_sql(c: str) -> str:
    return f"({le32_sql(c + '.tile')} || {le32_sql(c + '.x')} || {le32_sql(c + '.y')})"


def guid_sql(namespace: str, name_hex: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}' || {name_hex}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile``, ``x``, ``y`` of every tile that vertices name."""
    t = table(spark, sf_dir, "vertex").where("tile is not null").select("tile").distinct()
    return t.select("tile", tiles.x_of(F.col("tile")).alias("x"), tiles.y_of(F.col("tile")).alias("y"))


def _at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).select("v", F.col("loc.lon").alias("lon"), F.col("loc.lat").alias("lat"))


@query(f"{ctes('vx')}, {XY} SELECT v, x, y FROM xy")
def tile_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column and row of every located vertex's tile at zoom 14."""
    return _at(spark, sf_dir).select("v", tiles.tile_x(F.col("lon")).alias("x"), tiles.tile_y(F.col("lat")).alias("y"))


@query(f"{ctes('vx')}, {XY}, t AS (SELECT v, y * {N14} + x AS tile FROM xy) SELECT v, tile, tile % {N14} AS x, tile // {N14} AS y FROM t")
def tile_local_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local id of every located vertex's tile, and column and row taken back from it."""
    t = _at(spark, sf_dir).select("v", tiles.tile_of(F.col("lon"), F.col("lat")).alias("tile"))
    return t.select("v", "tile", tiles.x_of(F.col("tile")).alias("x"), tiles.y_of(F.col("tile")).alias("y"))


@query(f'WITH {TILES}, {BOXES} SELECT tile, round(l, 9) AS "left", round(t, 9) AS top, round(r, 9) AS "right", round(b, 9) AS bottom FROM bx')
def tile_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of every tile that vertices name."""
    b = _tiles(spark, sf_dir).withColumn("b", tiles.box(F.col("tile")))
    return b.select("tile", *[F.round(f"b.{k}", 9).alias(k) for k in ("left", "top", "right", "bottom")])


@query(f"{ctes('vx')}, c AS (SELECT v, {cell_sql('loc')} AS c FROM vx) SELECT v, c.x AS x, c.y AS y, c.tile AS tile FROM c")
def quantize_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell of every located vertex in its tile."""
    return _at(spark, sf_dir).select("v", tiles.quantize(F.col("lon"), F.col("lat")).alias("c")).select("v", "c.x", "c.y", "c.tile")


@query(
    f"""{ctes('vx')}, c AS (SELECT v, {cell_sql('loc')} AS c FROM vx), p AS (SELECT v, c, c.tile % {N14} AS x, c.tile // {N14} AS y FROM c)
    SELECT v, round({left('x')} + ({left('x + 1')} - {left('x')}) / 16384.0 * c.x, 9) AS lon, round({top('y')} - c.y * (({top('y')} - {top('y + 1')}) / 16384.0), 9) AS lat FROM p"""
)
def dequantize_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of the corner of every located vertex's cell."""
    c = _at(spark, sf_dir).select("v", tiles.dequantize(tiles.quantize(F.col("lon"), F.col("lat"))).alias("p"))
    return c.select("v", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query(
    f"""WITH b AS (SELECT DISTINCT way_id, box_left AS l, box_top AS t, box_right AS r, box_bottom AS b FROM landuse
      WHERE way_id IS NOT NULL AND box_left <= box_right AND box_bottom <= box_top),
    x AS (SELECT *, unnest(range({tx('l')}, {tx('r')} + 1)) AS x FROM b),
    y AS (SELECT *, unnest(range({ty('t')}, {ty('b')} + 1)) AS y FROM x)
    SELECT DISTINCT way_id, x, y FROM y"""
)
def tiles_for_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles that the stored box of a land use touches."""
    b = table(spark, sf_dir, "landuse").where("way_id is not null and box_left <= box_right and box_bottom <= box_top")
    b = b.select("way_id", "box_left", "box_top", "box_right", "box_bottom").distinct()
    t = b.select("way_id", F.explode(tiles.tiles_for(*[F.col(f"box_{k}") for k in ("left", "top", "right", "bottom")])).alias("t"))
    return t.select("way_id", "t.x", "t.y").distinct()


@query(
    f"""WITH {TILES}, p AS (SELECT DISTINCT x // 4 AS px, y // 4 AS py FROM tl)
    SELECT py * 4096 + px AS tile12, px * 4 + i AS x, py * 4 + j AS y FROM p, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)"""
)
def sub_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of zoom 14 that make up each tile of zoom 12 with vertices."""
    p = _tiles(spark, sf_dir).select(F.shiftright("x", 2).alias("px"), F.shiftright("y", 2).alias("py")).distinct()
    s = p.select(tiles.local_id(F.col("px"), F.col("py"), 12).alias("tile12"), F.explode(tiles.sub_tiles(F.col("px"), F.col("py"), 2)).alias("s"))
    return s.select("tile12", "s.x", "s.y")


@query(f"{ctes('vx')}, {XY} SELECT v, {tiles.first_id(14)} + y * {N14} + x AS gid, 14 AS zoom FROM xy")
def global_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global id of every located vertex's tile, and the zoom taken back from it."""
    g = _at(spark, sf_dir).select("v", tiles.global_id(tiles.tile_x(F.col("lon")), tiles.tile_y(F.col("lat"))).alias("gid"))
    return g.select("v", "gid", tiles.zoom_of(F.col("gid")).alias("zoom"))


@query(
    f"""WITH {TILES}, {BOXES}, f AS (SELECT *, CAST(l AS FLOAT) AS fl, CAST(t AS FLOAT) AS ft, CAST(r AS FLOAT) AS fr, CAST(b AS FLOAT) AS fb FROM bx)
    SELECT tile, x || 'x-' || y || 'y@14z' AS name, {tiles.first_id(13)} + (y // 2) * 8192 + x // 2 AS parent, x >= 0 AND y >= 0 AND x < {N14} AND y < {N14} AS is_valid,
      round(CAST(CAST((CAST(fl AS DOUBLE) + CAST(fr AS DOUBLE)) / 2.0 AS FLOAT) AS DOUBLE), 4) AS mid_lon, round(CAST(CAST((CAST(ft AS DOUBLE) + CAST(fb AS DOUBLE)) / 2.0 AS FLOAT) AS DOUBLE), 4) AS mid_lat FROM f"""
)
def tile_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, name, validity and centre of every tile that vertices name."""
    x, y = F.col("x"), F.col("y")
    t = _tiles(spark, sf_dir).withColumn("b", tiles.rounded_box(F.col("tile")))
    name = F.concat(x.cast("string"), F.lit("x-"), y.cast("string"), F.lit("y@14z"))
    parent = tiles.global_id(F.shiftright(x, 1), F.shiftright(y, 1), 13)
    valid = (x >= 0) & (y >= 0) & (x < N14) & (y < N14)
    return t.select("tile", name.alias("name"), parent.alias("parent"), valid.alias("is_valid"), F.round(F.col("b.mid_lon").cast("double"), 4).alias("mid_lon"), F.round(F.col("b.mid_lat").cast("double"), 4).alias("mid_lat"))


@query(f"WITH {TILES} SELECT a.tile AS tile_a, b.tile AS tile_b FROM tl a JOIN tl b ON (a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1)")
def tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tiles with vertices that share a side: an equi-join on the four neighbours' places."""
    t = _tiles(spark, sf_dir)
    around = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0))])
    a = t.select(F.col("tile").alias("tile_a"), F.explode(around).alias("n")).select("tile_a", "n.x", "n.y")
    return a.join(t.withColumnRenamed("tile", "tile_b"), ["x", "y"]).select("tile_a", "tile_b")


@query(
    f"""SELECT DISTINCT v, lon, lat, CASE WHEN abs(lat) <= 85.0511 THEN {tiles.first_id(14)} + {ty('lat')} * {N14} + {tx('(CASE WHEN lon = 180 THEN lon - 0.000001 ELSE lon END)')} END AS gid
    FROM vertex WHERE v IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL"""
)
def tile_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global id of the tile around each location as written, null where there is none."""
    rows = table(spark, sf_dir, "vertex").where("v is not null and lon is not null and lat is not null").select("v", "lon", "lat").distinct()
    return rows.withColumn("gid", tiles.around(F.col("lon"), F.col("lat")))


@query(
    f"""{ctes('vx')}, {XY}, f AS (SELECT *, CAST({left('x')} AS FLOAT) AS fl, CAST({top('y')} AS FLOAT) AS ft, CAST({left('x + 1')} AS FLOAT) AS fr, CAST({top('y + 1')} AS FLOAT) AS fb FROM xy),
    m AS (SELECT *, CAST(CAST((CAST(fl AS DOUBLE) + CAST(fr AS DOUBLE)) / 2.0 AS FLOAT) AS DOUBLE) AS mx, CAST(CAST((CAST(ft AS DOUBLE) + CAST(fb AS DOUBLE)) / 2.0 AS FLOAT) AS DOUBLE) AS my FROM f)
    SELECT v, {tiles.first_id(15)} + (y * 2 + (CASE WHEN loc.lat >= my THEN 0 ELSE 1 END)) * 32768 + x * 2 + (CASE WHEN loc.lon < mx THEN 0 ELSE 1 END) AS sub_gid,
      {N14} - x - 1 AS inv_x, {N14} - y - 1 AS inv_y FROM m"""
)
def tile_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of its tile each vertex lies in, and the mirrored column and row."""
    x, y = tiles.tile_x(F.col("lon")), tiles.tile_y(F.col("lat"))
    t = _at(spark, sf_dir).withColumns({"x": x, "y": y}).withColumn("b", tiles.rounded_box(tiles.local_id(F.col("x"), F.col("y"))))
    sx = F.col("x") * 2 + F.when(F.col("lon") < F.col("b.mid_lon").cast("double"), 0).otherwise(1)
    sy = F.col("y") * 2 + F.when(F.col("lat") >= F.col("b.mid_lat").cast("double"), 0).otherwise(1)
    return t.select("v", tiles.global_id(sx, sy, 15).alias("sub_gid"), (F.lit(N14) - F.col("x") - 1).alias("inv_x"), (F.lit(N14) - F.col("y") - 1).alias("inv_y"))


@query(
    f"""WITH {TILES}, {BOXES}, s AS (SELECT tile, 1 AS side, l AS lon1, t AS lat1, r AS lon2, t AS lat2 FROM bx UNION ALL SELECT tile, 2, r, t, r, b FROM bx
      UNION ALL SELECT tile, 3, r, b, l, b FROM bx UNION ALL SELECT tile, 4, l, b, l, t FROM bx)
    SELECT tile, side, round(lon1, 9) AS lon1, round(lat1, 9) AS lat1, round(lon2, 9) AS lon2, round(lat2, 9) AS lat2, '_tile_edge=yes' AS tag FROM s"""
)
def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four border lines of every tile that vertices name, clockwise from the top."""
    b = _tiles(spark, sf_dir).select("tile", tiles.box(F.col("tile")).alias("b")).select("tile", "b.*")
    corners = [("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom")]
    side = lambda i: F.struct(F.lit(i + 1).alias("side"), *[F.round(c, 9).alias(n) for c, n in zip((*corners[i], *corners[(i + 1) % 4]), ("lon1", "lat1", "lon2", "lat2"), strict=True)])
    return b.select("tile", F.explode(F.array(*[side(i) for i in range(4)])).alias("s")).select("tile", "s.*", F.lit("_tile_edge=yes").alias("tag"))


URL = "tiles/full/{z}/{x}/{y}.osm"


@query(f"WITH {TILES} SELECT tile, 'tiles/full/14/' || x || '/' || y || '.osm' AS url, 'tiles-full-14-' || x || '-' || y || '.osm.tile.zip' AS file_name FROM tl")
def tile_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address of every tile that vertices name, and the name of its cached file."""
    return with_url(_tiles(spark, sf_dir), URL).select("tile", "url", "file_name")


def with_url(t: DataFrame, template: str, zoom: int = tiles.ZOOM) -> DataFrame:
    """``t`` (x, y) with ``url``, the filled template, and ``file_name``, its escaped form with slashes and colons as hyphens."""
    url = F.lit(template.replace("{z}", str(zoom)))
    for k in ("x", "y"):
        url = F.replace(url, F.lit("{" + k + "}"), F.col(k).cast("string"))
    return t.withColumn("url", url).withColumn("file_name", F.concat(F.url_encode(F.translate("url", "/:", "--")), F.lit(".tile.zip")))


@query(f"{ctes('vx')}, c AS (SELECT v, {cell_sql('loc')} AS c FROM vx) SELECT v, {guid_sql(identity.VERTEX_NS, cell_hex_sql('c'))} AS guid FROM c")
def vertex_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of every located vertex."""
    return _at(spark, sf_dir).select("v", identity.vertex_guid(tiles.quantize(F.col("lon"), F.col("lat"))).alias("guid"))


@query(
    f"""{ctes('vx', 'ex', 'eg')}, p AS (SELECT e, i, pts[i] AS p FROM (SELECT e, pts, unnest(range(1, len(pts) + 1)) AS i FROM eg)),
    c AS (SELECT e, i, {cell_sql('p')} AS c FROM p), h AS (SELECT e, string_agg({cell_hex_sql('c')}, '' ORDER BY i) AS h FROM c GROUP BY e)
    SELECT e, {guid_sql(identity.EDGE_NS, 'h')} AS guid FROM h"""
)
def edge_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of every edge with located ends."""
    return edge_lines(spark, sf_dir).select("e", identity.edge_guid(F.transform("pts", lambda p: tiles.quantize(p["lon"], p["lat"]))).alias("guid"))


def classified_sql(table_rules: list[tuple], name: str) -> str:
    return f"""{ctes('wx')}, rule AS (SELECT * FROM (VALUES {rules.rules_sql(table_rules)}) AS r(k, v, out)),
    tag AS (SELECT way_id, i, tags[i].k AS k, tags[i].v AS v FROM (SELECT way_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM wx)),
    hit AS (SELECT way_id, i, coalesce(a.out, b.out) AS out FROM tag LEFT JOIN rule a ON a.k = tag.k AND a.v = tag.v LEFT JOIN rule b ON b.k = tag.k AND b.v = '*'
      WHERE a.out IS NOT NULL OR b.out IS NOT NULL),
    best AS (SELECT way_id, arg_min(out, i) AS {name} FROM hit GROUP BY way_id)"""


@query(f"{classified_sql(rules.BARRIER_RULES, 'resistance')} SELECT way_id, resistance FROM best")
def classify_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that are barriers, with their resistance."""
    return ways(spark, sf_dir).select("way_id", rules.classify(F.col("tags"), rules.BARRIER_RULES).alias("resistance")).where("resistance is not null")


@query(f"{classified_sql(rules.BARRIER_RULES, 'resistance')} SELECT way_id, coalesce(resistance, 0) AS resistance FROM wx LEFT JOIN best USING (way_id)")
def classify_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resistance of every way, 0 where no rule applies."""
    return ways(spark, sf_dir).select("way_id", F.coalesce(rules.classify(F.col("tags"), rules.BARRIER_RULES), F.lit(0)).alias("resistance"))


@query(f"{classified_sql(rules.BARRIER_CLASS_RULES, 'class')} SELECT way_id, class FROM best")
def barrier_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of the ways that have one as barriers."""
    return ways(spark, sf_dir).select("way_id", rules.classify(F.col("tags"), rules.BARRIER_CLASS_RULES).alias("class")).where("class is not null")


@query(f"{classified_sql(rules.LANDUSE_RULES, 'landuse')} SELECT way_id, landuse FROM best")
def classify_landuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land use of the ways that have one."""
    return ways(spark, sf_dir).select("way_id", rules.classify(F.col("tags"), rules.LANDUSE_RULES).alias("landuse")).where("landuse is not null")


#: Tiles counted as loaded: those with faces.
LOADED = "loaded AS (SELECT DISTINCT tile FROM face WHERE tile IS NOT NULL)"


@query(
    f"""{ctes('vx', 'ex', 'eg')}, {LOADED}, p AS (SELECT e, unnest(pts) AS p FROM eg), t AS (SELECT e, {ty('p.lat')} * {N14} + {tx('p.lon')} AS tile FROM p)
    SELECT e, bool_and(loaded.tile IS NOT NULL) AS is_loaded FROM t LEFT JOIN loaded USING (tile) GROUP BY e"""
)
def edge_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all points of an edge lie in loaded tiles (those with faces)."""
    loaded = table(spark, sf_dir, "face").where("tile is not null").select("tile").distinct().withColumn("_l", F.lit(True))
    pts = edge_lines(spark, sf_dir).select("e", F.explode("pts").alias("p"))
    pts = pts.select("e", tiles.tile_of(F.col("p.lon"), F.col("p.lat")).alias("tile")).distinct()
    return pts.join(loaded, "tile", "left").groupBy("e").agg(F.every(F.col("_l").isNotNull()).alias("is_loaded"))
