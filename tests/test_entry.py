import __spark_entry__ as entry
import duckdb
import pytest

from planarloom.plans import face_queries
from planarloom.runtime import Workspace

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p5_found" in entry.queries()


def test_a_label_used_again_keeps_the_table_before(spark):
    work = Workspace(spark, "t")
    one = work.cut(spark.range(3), "x")
    two = work.cut(one.where("id > 0"), "x")
    assert one.count() == 3 and two.count() == 2


def test_the_flow_runs_from_its_start(spark):
    face_queries.forget(spark)
    got = entry.entry(spark).collect()
    assert got and len({r["face"] for r in got}) == len(got) and all(r["signed_area"] < 0 for r in got)
    assert all(r["share"] is None or 0 < r["share"] for r in got)


@pytest.mark.parametrize("name", ["tile_xy", "vertex_nodes", "way_to_edges", "segment_intersections", "next_right", "way_tiles", "geojson_features"])
def test_queries_against_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("vertex", "edge", "way", "landuse", "face"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))
