import __spark_entry__ as entry
import pytest

from planarloom.llm import term_stats as T
from planarloom.runtime import Workspace

WAY = "way_id bigint, tags array<struct<k string, v string>>, loaded_at int"
USE = "way_id bigint, type string, loaded_at int"


def test_p1_found_marks_rare_and_common_terms(spark, tmp_path):
    way = [(i, [("highway", " Residential ")], 1) for i in range(40)] + [(i, [("highway", "track"), ("highway", "track")], 1) for i in range(40, 43)]
    way += [(43, [("name", "A"), ("name", " "), ("name", None), (None, "x")], 1), (43, [("name", "A")], 2), (44, None, 1), (None, [("name", "B")], 1)]
    use = [(i, "Forest ", 1) for i in range(20)] + [(20, "meadow", 1), (20, "meadow", 2), (21, None, 1), (22, " ", 1)]
    spark.createDataFrame(way, WAY).write.parquet(f"{tmp_path}/way.parquet")
    spark.createDataFrame(use, USE).write.parquet(f"{tmp_path}/landuse.parquet")
    got = sorted(tuple(r) for r in entry.queries()["p1_found"](spark, str(tmp_path)).collect())
    # track: 3 of 45 ways is neither
    assert got == [("tags", "highway=residential", "common"), ("tags", "name=a", "rare"), ("type", "forest", "common"), ("type", "meadow", "rare")]


def test_deltas_update_the_counts(spark):
    stats = T.TermStats(Workspace(spark, "t"), buckets=3)
    schema = "field string, rec_id bigint, version int, terms array<string>"
    stats.apply(spark.createDataFrame([("f", 1, 1, ["a", "a", "b"]), ("f", 2, 1, ["a"]), ("f", 3, 1, [])], schema))
    stats.apply(spark.createDataFrame([("f", 1, 2, ["b"]), ("f", 2, 2, None), ("f", 4, 2, ["a"]), ("f", 9, 2, None)], schema))
    assert sorted(tuple(r) for r in stats.terms().collect()) == [("f", "a", 1, 1), ("f", "b", 1, 1)]
    assert [tuple(r) for r in stats.totals().collect()] == [("f", 3)]


def test_a_later_session_goes_on_from_the_store(spark, tmp_path):
    schema = "field string, rec_id bigint, version int, terms array<string>"
    work = Workspace(spark, "t")
    T.TermStats(work, buckets=3, path=str(tmp_path / "store")).apply(spark.createDataFrame([("f", 1, 1, ["a", "b"]), ("f", 2, 1, ["a"])], schema))
    work._remove(work.path)  # as at the session's end
    again = T.TermStats(Workspace(spark, "t"), buckets=3, path=str(tmp_path / "store"))
    again.apply(spark.createDataFrame([("f", 1, 2, ["b", "b"]), ("f", 3, 2, ["a"])], schema))
    assert sorted(tuple(r) for r in again.terms().collect()) == [("f", "a", 2, 2), ("f", "b", 2, 1)]
    assert [tuple(r) for r in again.totals().collect()] == [("f", 3)]
    with pytest.raises(ValueError):
        T.TermStats(Workspace(spark, "t"), buckets=4, path=str(tmp_path / "store"))


def test_batches_may_come_in_any_order_and_again(spark):
    schema = "field string, rec_id bigint, version int, terms array<string>"
    a = spark.createDataFrame([("f", 1, 5, ["new"]), ("f", 2, 1, ["x", "x"]), ("f", 3, None, ["n"])], schema)
    b = spark.createDataFrame([("f", 1, 1, ["old"]), ("f", 2, 3, None), ("f", 4, 3, [None, "y"])], schema)
    for order in ([a, b, b, a], [b, a, a]):
        stats = T.TermStats(Workspace(spark, "t"), buckets=2)
        for batch in order:
            stats.apply(batch)
        assert sorted(tuple(r) for r in stats.terms().collect()) == [("f", "n", 1, 1), ("f", "new", 1, 1), ("f", "y", 1, 1)]
        assert [tuple(r) for r in stats.totals().collect()] == [("f", 3)]


def test_a_batch_that_fails_counts_nothing(spark, monkeypatch):
    schema = "field string, rec_id bigint, version int, terms array<string>"
    stats = T.TermStats(Workspace(spark, "t"), buckets=2)
    stats.apply(spark.createDataFrame([("f", 1, 1, ["a"])], schema))
    publish = stats.store._publish
    monkeypatch.setattr(stats.store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stats.apply(spark.createDataFrame([("f", 2, 1, ["a"])], schema))
    monkeypatch.setattr(stats.store, "_publish", publish)
    assert [tuple(r) for r in stats.terms().collect()] == [("f", "a", 1, 1)]
    stats.apply(spark.createDataFrame([("f", 2, 1, ["a"])], schema))
    assert [tuple(r) for r in stats.terms().collect()] == [("f", "a", 2, 2)]
