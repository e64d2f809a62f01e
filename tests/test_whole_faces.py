"""Faces of very many edges, and tiles of faces only, come whole through the queries."""

import gzip
import math

import numpy as np
import pytest

from planarloom.functions import identity
from planarloom.plans import face_queries, sink_queries
from planarloom.sources import artifact

N = 66_000


@pytest.fixture(scope="module")
def wheel(spark, tmp_path_factory):
    """A ring of ``N`` edges whose tags differ from one to the next, so that it stays a ring of ``N`` edges."""
    at = str(tmp_path_factory.mktemp("wheel"))
    p = [(4.5 + 0.3 * math.cos(2 * math.pi * i / N), 51.0 + 0.3 * math.sin(2 * math.pi * i / N)) for i in range(N)]
    tile = lambda lon, lat: int(np.floor(identity.cells_of(np.array([[lon, lat]]))[0][0, 0]))
    spark.createDataFrame([(i, i, *p[i], tile(*p[i])) for i in range(N)], "v bigint, node_id bigint, lon double, lat double, tile bigint").write.parquet(f"{at}/vertex.parquet")
    rows = [(i, i, (i + 1) % N, None, [("highway", "ab"[i % 2])]) for i in range(N)]
    spark.createDataFrame(rows, "e bigint, v1 bigint, v2 bigint, shape array<struct<lon: double, lat: double>>, tags array<struct<k: string, v: string>>").write.parquet(f"{at}/edge.parquet")
    return at, p


def test_face_ring_of_many_edges(spark, wheel):
    got = [(r["n_edges"], r["n_points"]) for r in face_queries.face_ring(spark, wheel[0]).select("n_edges", "n_points").collect()]
    assert got == [(N, N + 1)] * 2


def test_face_guid_of_many_edges(spark, wheel):
    at, p = wheel
    ring = np.array([*p, p[0]])
    want = identity.face_guids(np.concatenate([ring, ring[::-1]]), np.array([0, N + 1, 2 * N + 2]))
    assert sorted(r["face_guid"] for r in face_queries.face_guid(spark, at).collect()) == sorted(want)


def test_face_polygons_of_many_edges(spark, wheel):
    got = face_queries.face_polygons(spark, wheel[0]).select("n_edges", "signed_area", "is_outer").collect()
    assert sorted((r["n_edges"], r["is_outer"]) for r in got) == [(N, False), (N, True)]
    assert all(abs(r["signed_area"]) == pytest.approx(math.pi * 0.09, rel=1e-6) for r in got)


def test_faces_in_tile_of_many_edges(spark, wheel):
    at = wheel[0]
    known = spark.read.parquet(f"{at}/vertex.parquet").select("tile").distinct().count()
    assert face_queries.faces_in_tile(spark, at).count() == 2 * known


def test_outer_box_of_many_edges(spark, wheel):
    r = face_queries.outer_box(spark, wheel[0]).first()
    assert [r[k] for k in ("left", "top", "right", "bottom")] == pytest.approx([4.2, 51.3, 4.8, 50.7], abs=1e-6)


def test_artifact_binary_of_many_edges(spark, wheel):
    assert sum(r["n_faces"] for r in sink_queries.artifact_binary(spark, wheel[0]).collect()) == 2


def test_binary_tiles_of_faces_only(spark):
    c = "struct<x: int, y: int, tile: bigint>"
    a, b, e, f = (f"{k}" * 8 + "-0000-5000-8000-000000000000" for k in "1234")
    parts = {
        "vertex": spark.createDataFrame([(a, 1, 2, 5), (b, 3, 4, 5)], "guid string, x int, y int, tile bigint"),
        "edge": spark.createDataFrame([(e, a, b, [], None, 5)], f"guid string, v1 string, v2 string, shape array<{c}>, tags array<struct<k: string, v: string>>, tile bigint"),
        "face": spark.createDataFrame([(f, [], 6)], "guid string, shares array<struct<type: string, share: double>>, tile bigint"),
        "face_edge": spark.createDataFrame([(f, e, 0, True, 6)], "face string, edge string, seq bigint, forward boolean, tile bigint"),
    }
    got = {r["tile"]: bytes(r["file"]) for r in artifact.binary_tiles(parts).collect()}
    assert got.keys() == {5, 6} and gzip.decompress(got[6])
    assert artifact.decode(got[6]) == ([], [], [{"guid": f, "edges": [{"edge": e, "forward": True}], "shares": []}])
