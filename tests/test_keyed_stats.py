from planarloom.operators import keyed_stats as K

V = "v bigint, lon double, lat double, tile bigint, e bigint"


def test_hot_keys_count_each_id_once(spark):
    data = [(i, 0.0, 0.0, 1 if i < 60 else i, None) for i in range(100)] * 2 + [(None, 1.0, 1.0, 1, 0), (500, 1.0, 1.0, None, 0)]
    df = spark.createDataFrame(data, V)
    assert [tuple(r) for r in K.hot_keys(df, "tile", "v", 0.02).collect()] == [(1, 60)]
    # 101 distinct ids: the share is strict
    assert K.hot_keys(df, "tile", "v", 60 / 101).count() == 0
    assert K.hot_keys(spark.createDataFrame([], V), "tile", "v", 0.02).count() == 0


def test_tile_summary(spark):
    v = spark.createDataFrame([(1, 1.0, 2.0, 7, 0), (1, 1.0, 2.0, 7, 1), (2, None, 3.0, 7, 0), (3, 5.0, 5.0, 8, 0), (4, 5.0, 5.0, None, 0)], V)
    e = spark.createDataFrame([(1, 1, 2, 7), (1, 1, 2, 7), (2, 1, 1, 7), (3, 1, 99, 7), (4, None, 2, 7)], "e bigint, v1 bigint, v2 bigint, tile bigint")
    got = {r["tile"]: r.asDict() for r in K.tile_summary(v, e).collect()}
    assert got[7] == {"tile": 7, "n_rows": 3, "n_vertices": 2, "n_located": 1, "box_left": 1.0, "box_top": 2.0, "box_right": 1.0, "box_bottom": 2.0, "degree_sum": 5, "degree_max": 3}
    assert got[8]["degree_sum"] == 0 and set(got) == {7, 8}
    half = K.tile_summary(spark.createDataFrame([(1, None, 3.0, 7, 0)], V), e).collect()[0]
    assert half["n_located"] == 0 and half["box_top"] is None and half["box_bottom"] is None
    assert K.tile_summary(spark.createDataFrame([], V), e).count() == 0
