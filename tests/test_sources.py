import gzip
import json

from planarloom.functions import tiles
from planarloom.plans import sink_queries
from planarloom.sources import artifact, features, osm_xml
from pyspark.sql import functions as F

XML = """<osm><node id="1" lat="51.0" lon="4.5"><tag k="a" v="&lt;x&gt;"/></node><node id="2" lat="51.1" lon="4.6"/>
<way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="track"/></way></osm>"""


def test_xml_is_read_plain_gzipped_and_broken(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    with gzip.open(tmp_path / "b.osm.gz", "wt") as f:
        f.write(XML.replace('id="', 'id="1'))
    (tmp_path / "c.osm").write_text("not xml <node id=")
    n = sorted((r["node_id"], r["lon"], r["lat"]) for r in osm_xml.nodes(spark, f"{tmp_path}/*").collect())
    assert n == [(1, 4.5, 51.0), (2, 4.6, 51.1), (11, 4.5, 51.0), (12, 4.6, 51.1)]
    w = {r["way_id"]: (r["refs"], [tuple(t) for t in r["tags"]]) for r in osm_xml.ways(spark, f"{tmp_path}/*").collect()}
    assert w[9] == ([1, 2], [("highway", "track")]) and set(w) == {9, 19}


def test_xml_is_written_by_tile_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, 4.5, 51.0, [("k", '<"&\'>'), ("n", None)], i % 3) for i in range(12)], "node_id bigint, lon double, lat double, tags array<struct<k: string, v: string>>, tile bigint")
    osm_xml.write_nodes(rows, f"{tmp_path}/n")
    back = osm_xml.nodes(spark, f"{tmp_path}/n/*/*").collect()
    assert sorted(r["node_id"] for r in back) == list(range(12)) and {tuple(map(tuple, r["tags"])) for r in back} == {(("k", '<"&\'>'),)}


def test_binary_tiles_keep_all(spark):
    g = [f"{i:08x}-0000-5000-8000-00000000000{i}" for i in range(6)]
    v = [{"guid": g[0], "tile": 2**31 + 5, "x": 1, "y": -2}, {"guid": g[1], "tile": 7, "x": 16383, "y": 0}]
    e = [{"v1": g[0], "guid": g[2], "v2": g[1], "shape": [{"tile": 7, "x": 3, "y": 4}], "tags": [{"k": "naam", "v": "Hôtel 😀"}, {"k": "x", "v": None}]}]
    f = [{"guid": g[3], "edges": [{"edge": g[2], "forward": True}, {"edge": g[2], "forward": False}], "shares": [{"type": "rural", "share": 0.25}]}]
    raw = artifact.encode(v, e, f)
    assert artifact.decode(raw) == (v, e, f) and raw == artifact.encode(v, e, f)
    assert artifact.decode(artifact.encode([], [], [])) == ([], [], [])
    from io import BytesIO

    for n in (0, 1, -1, 63, 64, -64, 300, 2**31 - 1, -(2**31)):
        assert artifact.read_var_int(BytesIO(artifact.var_int(n))) == n
    assert artifact.read_text(BytesIO(artifact.text("  "))) == ""


def test_artifact_refuses_dangling_references(spark, tmp_path):
    import pytest

    vertex = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 1, 5)], "guid string, x int, y int, tile bigint")
    edge = spark.createDataFrame([("e", "a", "b", [], [], 5)], "guid string, v1 string, v2 string, shape array<struct<x: int, y: int, tile: bigint>>, tags array<struct<k: string, v: string>>, tile bigint")
    face = spark.createDataFrame([], "guid string, shares array<struct<type: string, share: double>>, tile bigint")
    fe = spark.createDataFrame([], "face string, edge string, seq bigint, forward boolean, tile bigint")
    artifact.write({"vertex": vertex, "edge": edge, "face": face, "face_edge": fe}, f"{tmp_path}/a")
    for name in ("face", "face_edge"):
        (tmp_path / "a" / name).mkdir(exist_ok=True)
    spark_read = {n: spark.read.parquet(f"{tmp_path}/a/{n}") for n in ("vertex", "edge")}
    assert spark_read["vertex"].count() == 2
    face.withColumn("tile", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/a/face/tile=1")
    fe.drop("tile").write.mode("overwrite").parquet(f"{tmp_path}/a/face_edge/tile=1")
    back = artifact.read(spark, f"{tmp_path}/a")
    assert back["vertex"].count() == 1
    with pytest.raises(Exception, match="not in the artefact"):
        back["edge"].collect()


def test_missing_tiles_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 4) for i in range(20)], "v bigint, tile bigint")
    sink_queries.write_missing_tiles(rows.where("tile < 2").withColumn("run", F.lit(1)), f"{tmp_path}/t")
    sink_queries.write_missing_tiles(rows.withColumn("run", F.lit(2)), f"{tmp_path}/t")
    got = spark.read.parquet(f"{tmp_path}/t").groupBy("tile").agg(F.count("*").alias("n"), F.min("run").alias("a"), F.max("run").alias("b")).collect()
    assert {(int(r["tile"]), r["n"], r["a"], r["b"]) for r in got} == {(0, 5, 1, 1), (1, 5, 1, 1), (2, 5, 2, 2), (3, 5, 2, 2)}


def test_features_and_layers(spark):
    df = spark.createDataFrame([(1, [(4.5, 51.0), (4.6, 51.0), (4.6, 51.1), (4.5, 51.0)])], "id bigint, r array<struct<lon: double, lat: double>>")
    for kind in ("Polygon", "LineString"):
        text = df.select(features.feature(kind, F.col("r"), F.struct("id")).alias("feature"))
        o = json.loads(text.first()[0])
        assert o["geometry"]["type"] == kind and o["properties"] == {"id": 1}
        back = features.read_features(text).first()
        assert back["kind"] == kind and [tuple(p) for p in back["points"]] == [tuple(p) for p in df.first()["r"]]
    assert features.polygon_commands([(0, 0), (4, 0), (4, 3), (0, 0)]) == [9, 0, 0, 18, 8, 0, 0, 6, 15]
    raw = features.vector_layer("x", [([(0, 0), (4, 0), (4, 3), (0, 0)], {"a": "b", "s": 0.5, "n": None})])
    assert raw[0] == 0x1A and b"\n\x01x" in raw and len(raw) == raw[1] + 2


def test_tile_maths_turn_back(spark):
    df = spark.createDataFrame([(4.75, 51.25), (-179.99, -84.0), (179.99, 84.0)], "lon double, lat double")
    cell = tiles.quantize(F.col("lon"), F.col("lat"))
    again = df.select(cell.alias("c"), tiles.dequantize(cell).alias("p")).select("c", "p.lon", "p.lat")
    for r in again.collect():
        assert abs(r["lon"]) <= 180 and 0 <= r["c"]["x"] < 16384 and 0 <= r["c"]["y"] < 16384
    near = again.select((F.col("lon") + 1e-9).alias("lon"), (F.col("lat") - 1e-9).alias("lat"), "c").select(tiles.quantize(F.col("lon"), F.col("lat")).alias("d"), "c").collect()
    assert all(r["c"] == r["d"] for r in near)
    assert [r[0] for r in spark.createDataFrame([(180.0, 0.0), (0.0, 86.0)], "lon double, lat double").select(tiles.around(F.col("lon"), F.col("lat"), 0)).collect()] == [0, None]


def test_cached_tiles_are_read_by_name(spark, tmp_path):
    for name, text in (("tiles-full-14-1-2.osm.tile.zip", XML), ("b.osm.tile.zip", XML.replace("</osm>", "")), ("c.tile.zip", XML)):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    (tmp_path / "d.tile.zip").write_bytes(b"no gzip")
    (tmp_path / "e.txt").write_text(XML)
    every = osm_xml.cached(spark, str(tmp_path)).collect()
    assert {r["file_name"] for r in every} == {"tiles-full-14-1-2.osm.tile.zip", "c.tile.zip"}
    one = osm_xml.cached(spark, str(tmp_path), spark.createDataFrame([("c.tile.zip",), ("missing",)], "file_name string")).collect()
    assert sorted((r["kind"], r["id"], r["lon"], r["refs"], [tuple(t) for t in r["tags"]]) for r in one) == [("n", 1, 4.5, None, [("a", "<x>")]), ("n", 2, 4.6, None, []), ("w", 9, None, [1, 2], [("highway", "track")])]


def pbf(blocks):
    """A PBF file of primitive blocks."""
    import zlib

    from planarloom.sources.features import _field as field

    out = b""
    for kind, body in [(b"OSMHeader", b""), *((b"OSMData", b) for b in blocks)]:
        blob = field(2, len(body)) + field(3, zlib.compress(body))
        head = field(1, kind) + field(3, len(blob))
        out += len(head).to_bytes(4, "big") + head + blob
    return out


def test_pbf_blocks_are_read_in_parallel(spark, tmp_path):
    from planarloom.sources import osm_pbf
    from planarloom.sources.features import _field as field
    from planarloom.sources.features import _varint, _zigzag

    sint = lambda *xs: b"".join(_varint(_zigzag(x)) for x in xs)
    table = field(1, b"".join(field(1, s) for s in (b"", b"highway", b"track", b"name", "Hôtel".encode())))
    dense = field(2, field(1, sint(10, 1, -5)) + field(8, sint(510000000, 1000, -2000)) + field(9, sint(-45000000, 10, 10)) + field(10, bytes([1, 2, 0, 0, 3, 4, 1, 2, 0])))
    way = field(3, field(1, 99) + field(2, bytes([1, 3])) + field(3, bytes([2, 4])) + field(8, sint(10, 1, -1)))
    node = field(1, field(1, _zigzag(7)) + field(8, _zigzag(1)) + field(9, _zigzag(2)))
    one, two = table + field(2, dense) + field(2, way), table + field(2, node) + field(17, 1000) + field(19, 5000)
    (tmp_path / "a.pbf").write_bytes(pbf([one, two]) + b"\x00\x00")
    got = sorted(((r["kind"], r["id"], r["lon"] and round(r["lon"], 9), r["lat"] and round(r["lat"], 9), r["refs"], [tuple(t) for t in r["tags"]]) for r in osm_pbf.elements(spark, [str(tmp_path / "a.pbf")], tasks=3).collect()), key=str)
    assert got == [
        ("n", 10, -4.5, 51.0, None, [("highway", "track")]),
        ("n", 11, -4.499999, 51.0001, None, []),
        ("n", 6, -4.499998, 50.9999, None, [("name", "Hôtel"), ("highway", "track")]),
        ("n", 7, 2e-06, 6e-06, None, []),
        ("w", 99, None, None, [10, 11, 10], [("highway", "track"), ("name", "Hôtel")]),
    ]


def test_many_tiles_of_an_artifact_make_few_files_and_replace_themselves_only(spark, tmp_path):
    from pathlib import Path

    row = lambda k: (f"v{k}", 1, 1, k)
    kind = "guid string, x int, y int, tile bigint"
    tile = [y * 2**14 + x for y in range(20) for x in range(20)]
    artifact.write({"vertex": spark.createDataFrame([row(k) for k in tile], kind).repartition(8)}, f"{tmp_path}/a")
    files = lambda: list(Path(tmp_path, "a", "vertex").rglob("*.parquet"))
    assert len(files()) <= 2 * artifact.SIDE**2 < len(tile)
    artifact.write({"vertex": spark.createDataFrame([("new", 2, 2, tile[0]), ("far", 3, 3, 10**8)], kind)}, f"{tmp_path}/a")
    assert len(files()) <= 2 * artifact.SIDE**2
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/a/vertex").select("guid", "x", "y", "tile").collect()}
    assert got == {row(k) for k in tile[1:]} | {("new", 2, 2, tile[0]), ("far", 3, 3, 10**8)}
    rest = {"edge": "guid string, v1 string, v2 string, tile bigint", "face": "guid string, tile bigint", "face_edge": "face string, edge string, tile bigint"}
    some = {"edge": [(f"e{k}", f"v{k}", f"v{k}", k) for k in tile[1:]], "face": [(f"f{k}", k) for k in tile[1:]], "face_edge": [(f"f{k}", f"e{k}", k) for k in tile[1:]]}
    artifact.write({n: spark.createDataFrame(some[n], rest[n]) for n in rest}, f"{tmp_path}/a")
    back = artifact.read(spark, f"{tmp_path}/a", tile[1:3])
    assert all({r["tile"] for r in df.collect()} == set(tile[1:3]) for df in back.values())


def test_edges_of_the_artifact_are_named_as_by_columns(spark):
    from planarloom.functions import identity

    lines = [(1, [(4.0, 51.0), (4.001, 51.2), (4.1, 51.3)]), (2, [(4.1, 51.3), (4.0, 51.0)]), (3, [(4.0, 51.0), (4.2, 95.0), (4.3, 51.0)])]
    edges = spark.createDataFrame([(e, p, [("k", "v")] if e == 1 else None) for e, p in lines], "e bigint, pts array<struct<lon: double, lat: double>>, tags array<struct<k: string, v: string>>")
    none = spark.createDataFrame([], "h bigint, e bigint, face bigint")
    faces = spark.createDataFrame([], "face bigint, face_guid string, ring array<struct<lon: double, lat: double>>")
    got = artifact.tables(edges, none, faces)
    c = F.transform("pts", lambda p: tiles.quantize(p["lon"], p["lat"]))
    a, b = F.get(c, F.lit(0)), F.get(c, F.size("pts") - 1)
    want = edges.select(identity.edge_guid(c).alias("guid"), identity.vertex_guid(a).alias("v1"), identity.vertex_guid(b).alias("v2"), F.slice(c, 2, F.size("pts") - 2).alias("shape"), "tags", a["tile"].alias("tile"))
    assert sorted(map(str, got["edge"].collect())) == sorted(map(str, want.collect()))
    assert got["vertex"].count() == 3


def test_polygons_are_drawn_as_point_by_point(spark, monkeypatch):
    import math
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(40):
        x, y, s = rnd.uniform(4, 4.1), rnd.uniform(51, 51.1), rnd.choice([0.001, 0.05, 3.0])
        ring = [(x + rnd.uniform(0, s), y + rnd.uniform(0, s)) for _ in range(rnd.randint(3, 6))]
        rows.append((f"g{k % 38:02}", rnd.choice(["a", None]), rnd.choice([0.5, None]), [*ring, ring[0]]))
    df = spark.createDataFrame(rows, "face_guid string, type string, share double, ring array<struct<lon: double, lat: double>>")
    known = spark.createDataFrame([(rnd.uniform(4, 4.2), rnd.uniform(51, 51.2)) for _ in range(60)], "lon double, lat double").select(tiles.tile_of(F.col("lon"), F.col("lat")).alias("tile")).distinct()
    corners = {r["tile"]: r["b"] for r in known.select("tile", tiles.box(F.col("tile")).alias("b")).collect()}
    away = lambda v: int(math.copysign(math.floor(abs(v)) + (abs(v) % 1 >= 0.5), v))
    want = {}
    for g, t, s, ring in rows:
        lon, lat = zip(*ring, strict=True)
        for tile, b in corners.items():
            if min(lon) < b["right"] and max(lon) >= b["left"] and min(lat) <= b["top"] and max(lat) > b["bottom"]:
                at = [(away((x - b["left"]) / (b["right"] - b["left"]) * 4096), away((b["top"] - y) / (b["top"] - b["bottom"]) * 4096)) for x, y in ring]
                commands = b"".join(map(features._varint, features.polygon_commands(at)))
                want.setdefault(tile, []).append((g, commands, at, {"face_guid": g, "type": t, "share": s}))
    want = {t: features.vector_layer("urban-polygons", [(at, p) for *_, at, p in sorted(of, key=lambda x: x[:2])]) for t, of in want.items()}
    assert len(want) > 10
    for held in (sink_queries.faces.HELD, 5):
        monkeypatch.setattr(sink_queries.faces, "HELD", held)
        got = sink_queries.layers(sink_queries.drawn(df, known)).collect()
        assert {r["tile"]: bytes(r["mvt"]) for r in got} == want
        assert all(r["n_bytes"] == len(r["mvt"]) for r in got)


def test_binary_tiles_of_many_rows_are_those_of_single_ones(spark):
    import random
    import uuid

    rnd = random.Random(5)
    guid = lambda: str(uuid.UUID(int=rnd.getrandbits(128)))
    cell = lambda: {"x": rnd.randint(0, 16383), "y": rnd.randint(-5, 16383), "tile": rnd.randint(0, 2**28)}
    vs = [{"guid": guid(), **cell()} for _ in range(12)]
    tag = lambda: rnd.choice([None, [], [{"k": "highway", "v": "é" * 70}, {"k": " ", "v": None}]])
    es = [{"guid": guid(), "v1": rnd.choice(vs)["guid"], "v2": rnd.choice(vs)["guid"], "shape": [cell() for _ in range(rnd.randint(0, 3))], "tags": tag(), "tile": rnd.randint(1, 3)} for _ in range(40)]
    fs = [{"guid": guid(), "shares": [{"type": "a", "share": 0.25}] * rnd.randint(0, 2), "tile": 2} for _ in range(6)]
    fe = [{"face": f["guid"], "edge": rnd.choice(es)["guid"], "seq": rnd.randint(0, 99), "forward": rnd.random() < 0.5, "tile": 2} for f in fs for _ in range(3)]
    c = "struct<x: int, y: int, tile: bigint>"
    parts = {
        "vertex": spark.createDataFrame(vs, "guid string, x int, y int, tile bigint"),
        "edge": spark.createDataFrame(es, f"guid string, v1 string, v2 string, shape array<{c}>, tags array<struct<k: string, v: string>>, tile bigint"),
        "face": spark.createDataFrame(fs, "guid string, shares array<struct<type: string, share: double>>, tile bigint"),
        "face_edge": spark.createDataFrame(fe, "face string, edge string, seq bigint, forward boolean, tile bigint"),
    }
    files = artifact.binary_tiles(parts)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
    want = {}
    for t in {e["tile"] for e in es}:
        own = sorted((e for e in es if e["tile"] == t), key=lambda e: (e["v1"], e["guid"]))
        far = {v for e in own for v in (e["v1"], e["v2"])}
        faces = [f | {"edges": sorted((x for x in fe if x["face"] == f["guid"]), key=lambda x: (x["seq"], x["edge"], x["forward"]))} for f in sorted(fs, key=lambda f: f["guid"]) if f["tile"] == t]
        want[t] = artifact.encode(sorted((v for v in vs if v["guid"] in far), key=lambda v: v["guid"]), own, faces)
    got = {r["tile"]: bytes(r["file"]) for r in files.collect()}
    assert {t: gzip.decompress(b) for t, b in got.items()} == {t: gzip.decompress(b) for t, b in want.items()} and len(want) == 3
    for r in artifact.read_binary(files).collect():
        v, e, f = artifact.decode(want[r["tile"]])
        assert (r["n_vertices"], r["n_edges"], r["n_faces"]) == (len(v), len(e), len(f))
        assert r["guids"] == ",".join(sorted(x["guid"] for x in (*v, *e, *f)))
