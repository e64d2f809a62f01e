import pytest
from pyspark.sql import functions as F

from planarloom.operators import compaction as C
from planarloom.runtime import Workspace

FILES = "file_id int, cache_folder string, content string, body string"


def rows(df):
    return sorted(tuple(r) for r in df.select("cache_folder", "kind", "elem_id", "rev").collect())


def test_reads_whole_lines_only(spark):
    good = '{"kind":"n","id":1,"rev":2,"lon":1.5}\r\n {"rev": 3, "kind": "w", "id": "7", "refs": []} \n'
    bad = '{"kind":"n","id":9,"rev":1\n{"kind":"n","id":9,"rev":1} x\n[1]\n"s"\n{"kind":"x","id":9,"rev":1}\n{"kind":"n","id":1.5,"rev":1}\n{"kind":"n","id":true,"rev":1}\n{"id":9,"rev":1}\nnull\n{}'
    df = spark.createDataFrame([(1, "a", good, "x"), (2, "a", bad, None), (3, "a", None, ""), (4, "a", "", ""), (5, None, good, ""), (6, "", good, "")], FILES)
    got = rows(C.compact_folders(df, Workspace(spark, "t"), max_small=1))
    assert got == sorted([("a", "n", 1, 2), ("a", "w", 7, 3), ("", "n", 1, 2), ("", "w", 7, 3)])


@pytest.mark.parametrize("max_small", [0, 2, 100])
def test_each_record_once(spark, max_small):
    line = '{{"kind":"n","id":{},"rev":1}}\n'
    data = [(i, f"f{i % 3}" if i % 2 else "D:\\hot", line.format(i // 2) + line.format(i // 2 + 1), "") for i in range(60)]
    df = spark.createDataFrame(data, FILES)
    want = sorted({(f, "n", k, 1) for _, f, text, _ in data for k in [int(x.split('"id":')[1].split(",")[0]) for x in text.splitlines()]})
    assert rows(C.compact_folders(df, Workspace(spark, "t"), max_small=max_small)) == want


def test_empty_table(spark):
    assert rows(C.compact_folders(spark.createDataFrame([], FILES), Workspace(spark, "t"))) == []


def test_store_compacts_only_crowded_partitions(spark):
    store = C.SnapshotStore(spark, Workspace(spark, "s").path, "part")
    assert store.version() == 0 and store.read() is None
    for i in range(4):
        store.write(spark.createDataFrame([("a", i)] + ([("b", i)] if i == 0 else []), "part string, x int").coalesce(1), store.version(), None, "add")
    before = {r["part"]: r for r in store.file_stats(1 << 20).collect()}
    assert before["a"]["n_small"] == 4 and before["b"]["n_small"] == 1
    old = store.version()
    new = store.compact(max_small=2, small_bytes=1 << 20, target_bytes=1 << 30)
    assert new == old + 1
    after = {r["part"]: r for r in store.file_stats(1 << 20).collect()}
    assert after["a"]["n_files"] == 1 and after["b"]["n_files"] == 1
    want = sorted([("a", i) for i in range(4)] + [("b", 0)])
    for v in (old, new):  # the older snapshot can still be read
        assert sorted((r["part"], r["x"]) for r in store.read(v).collect()) == want
    assert store.compact(2, 1 << 20, 1 << 30) == new


def test_store_refuses_conflicts_and_rebases(spark):
    store = C.SnapshotStore(spark, Workspace(spark, "s").path, "part")
    make = lambda p, x: spark.createDataFrame([(p, x)], "part string, x int")
    one = lambda p: spark.createDataFrame([(p,)], "part string")
    base = store.write(make("a", 1), 0, None, "add")
    store.write(make("a", 2), base, None, "add")
    with pytest.raises(C.ConflictError):
        store.write(make("a", 9), base, one("a"), "compact")
    base = store.version()
    store.write(make("b", 1), base, None, "add")
    store.write(make("a", 5), base, one("a"), "compact")  # b changed, a did not
    assert sorted((r["part"], r["x"]) for r in store.read().collect()) == [("a", 5), ("b", 1)]


def test_large_partition_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else these few rows are put together again
    try:
        df = spark.range(1000).select(F.lit("p").alias("part"), "id")
        assert C.spread(df, "part", F.lit(4)).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_strict_json_and_long_digits(spark):
    lines = ['{"kind":"n","id":1,"rev":1,"lon":NaN}', '{"kind":"n","id":2,"rev":1,}', '{"kind":"n","id":"' + "9" * 5000 + '","rev":1}', '{"kind":"n","id":4,"rev":1,"lon":' + "9" * 5000 + "}"]
    lines += ['{"kind":"n","id":"١","rev":1}', '{"kind":"n","id":6,"rev":' + "9" * 5000 + "}", '{"kind":"n","id":"-7","rev":"1"}']
    df = spark.createDataFrame([(1, "a b%c", "\n".join(lines), "x")], FILES)
    assert rows(C.compact_folders(df, Workspace(spark, "t"))) == [("a b%c", "n", -7, 1), ("a b%c", "n", 4, 1)]


def test_a_loser_leaves_the_winners_commit_alone(spark):
    store = C.SnapshotStore(spark, Workspace(spark, "s").path, "part")
    make = lambda p, x: spark.createDataFrame([(p, x)], "part string, x int")
    base = store.write(make("a", 1), 0, None, "add")
    other = C.SnapshotStore(spark, store.path, "part")
    publish = store._publish_file
    won = []

    def late(name, text):  # another writer commits between this one's manifest and its commit file
        if not won:
            won.append(other.write(make("a", 2), base, {"a"}, "winner"))
        return publish(name, text)

    store._publish_file = late
    with pytest.raises(C.ConflictError):
        store.write(make("a", 3), base, {"a"}, "loser")
    store._publish_file = publish
    with pytest.raises(C.ConflictError):
        other.write(make("a", 4), base, {"a"}, "third")
    assert [(r["part"], r["x"]) for r in store.read().collect()] == [("a", 2)]


def test_expire_deletes_what_no_kept_version_needs(spark):
    store = C.SnapshotStore(spark, Workspace(spark, "s").path, "part")
    for i in range(4):
        store.write(spark.createDataFrame([("a", i), ("b c%d", i)], "part string, x int").coalesce(1), store.version(), None, "add")
    files = lambda: len(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{store.path}/data").select("path").collect())
    assert files() == 8
    store.compact(1, 1 << 20, 1 << 30)
    assert files() == 10
    assert store.expire(1) == 8 and files() == 2
    assert sorted((r["part"], r["x"]) for r in store.read().collect()) == sorted([(p, i) for i in range(4) for p in ("a", "b c%d")])
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("snap=") <= 2 or "snap=5" in plan


def test_folders_are_kept_at_a_given_path(spark, tmp_path):
    line = '{{"kind":"n","id":{},"rev":1}}\n'
    df = spark.createDataFrame([(i, "a", line.format(i % 5), "") for i in range(20)], FILES).repartition(4)
    C.compact_folders(df, Workspace(spark, "t"), path=str(tmp_path / "kept"))
    store = C.SnapshotStore(spark, str(tmp_path / "kept"), "slot")
    assert sorted(r["elem_id"] for r in store.read().collect()) == [0, 1, 2, 3, 4]
    assert store.file_stats(1 << 20).collect()[0]["n_files"] == 1
