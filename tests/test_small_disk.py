"""Tables and shuffle files that nothing reads any more are deleted, and what replaces large shuffles gives the same rows."""

import os
import random
import time

from pyspark.sql import functions as F

from planarloom.operators import faces, graph
from planarloom.plans import face_queries
from planarloom.runtime import Workspace

P = "struct<lon: double, lat: double>"
EDGE = f"e bigint, v1 bigint, v2 bigint, pts array<{P}>, tags array<struct<k: string, v: string>>"


def street_net(spark, at, n=14, seed=3):
    """Tables of a lattice of streets with gaps, over several blocks of tiles, crossed by some long ones."""
    rnd = random.Random(seed)
    place = lambda i, j: (4.0 + 0.02 * i + rnd.uniform(-0.003, 0.003), 51.0 + 0.015 * j + rnd.uniform(-0.002, 0.002))
    v = [(i * n + j, i * n + j, *place(i, j), i * n + j) for i in range(n) for j in range(n)]
    pairs = [(i * n + j, k) for i in range(n) for j in range(n) for k in ([i * n + j + 1] if j + 1 < n else []) + ([i * n + j + n] if i + 1 < n else []) if rnd.random() < 0.8]
    pairs += [(rnd.randrange(n * n), rnd.randrange(n * n)) for _ in range(6)]
    e = [(k, a, b, None, [("highway", rnd.choice("ab"))]) for k, (a, b) in enumerate(p for p in pairs if p[0] != p[1])]
    spark.createDataFrame(v, "v bigint, node_id bigint, lon double, lat double, tile bigint").write.parquet(f"{at}/vertex.parquet")
    spark.createDataFrame(e, f"e bigint, v1 bigint, v2 bigint, shape array<{P}>, tags array<struct<k: string, v: string>>").write.parquet(f"{at}/edge.parquet")
    return at


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return set(x for x in found.replace(")", "").split("/") if x.startswith("shuffle_") and ".data" in x)


def test_writing_a_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = Workspace(spark, "t").cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "x")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and out.count() == 100


def test_the_flow_keeps_only_the_tables_it_returns(spark, tmp_path, monkeypatch):
    made = []

    class Kept(Workspace):
        def __init__(self, spark, name):
            super().__init__(spark, name)
            made.append(self.path)

    monkeypatch.setattr(face_queries, "Workspace", Kept)
    t = face_queries.built(spark, street_net(spark, str(tmp_path)), "polygons")
    assert set(os.listdir(made[0])) == {"chained", "rest-chains", "traced", "rest-faces", "rest-rings", "polygons"} and t["polygons"].count() > 50


def test_dead_ends_of_blocks_are_those_of_rounds(spark, tmp_path):
    from planarloom.sources.tables import line_edges

    net = Workspace(spark, "t").cut(graph.numbered(graph.split(line_edges(spark, street_net(spark, str(tmp_path))))), "net")
    blocks = net.select(F.explode(F.array(graph.block(F.col("v1")), graph.block(F.col("v2"))))).distinct().count()
    got = [sorted(r["e"] for r in f(net, Workspace(spark, "t")).collect()) for f in (graph.prune_blocks, graph.prune_dead_ends)]
    assert blocks > 5 and got[0] == got[1] and 0 < len(got[0]) < net.count()


def test_loops_followed_in_blocks_are_those_of_joins(spark, tmp_path):
    edges = face_queries.built(spark, street_net(spark, str(tmp_path), seed=4), "graph")["graph"]
    assigned, ringed = faces.trace(edges, Workspace(spark, "t"))
    plain = faces.assign_faces(edges, Workspace(spark, "t"))
    key = lambda df, *c: sorted(tuple(r[k] for k in c) for r in df.collect())
    want = key(plain, "h", "e", "face")
    assert key(assigned, "h", "e", "face") == want and len(want) > 200
    assert key(ringed, "face", "n_edges", "ring") == key(faces.rings(plain, edges), "face", "n_edges", "ring")


def test_cycles_keep_every_id_once(spark):
    n, work = 40, Workspace(spark, "t")
    steps = spark.range(n).select("id", F.when(F.col("id") == 7, 0).when(F.col("id") == n - 1, 8).otherwise(F.col("id") + 1).cast("bigint").alias("nx"))
    assert graph.cycles(steps, work, "c").count() == n
    assert sum(spark.read.parquet(f"{work.path}/{t}").count() for t in os.listdir(work.path)) == n


def test_chains_of_blocks_are_those_of_joins(spark, tmp_path):
    from planarloom.sources.tables import line_edges

    net = graph.numbered(graph.split(line_edges(spark, street_net(spark, str(tmp_path), seed=5))))
    # A ring of its own, and one on two vertices.
    cell = lambda x, y: ((51 << 14) + x << 28) + y
    ring = [cell(8000, 1), cell(8000, 2), cell(8001, 3), cell(8001, 4)]
    p = [(4.0 + k, 50.0) for k in range(4)]
    rows = [(10 - k, ring[k], ring[(k + 1) % 4], [p[k], p[(k + 1) % 4]], None if k % 2 else []) for k in range(4)]
    a, b = cell(9000, 1), cell(9000, 2)
    rows += [(20, a, b, [p[0], p[2], p[1]], [("x", "y"), ("a", "b")]), (21, a, b, [p[0], p[3], p[1]], [("a", "b"), ("x", "y")])]
    net = Workspace(spark, "t").cut(graph.prune_dead_ends(net.unionByName(spark.createDataFrame(rows, EDGE)), Workspace(spark, "t")), "net")
    got = [sorted(map(str, f(net, Workspace(spark, "t")).select("e", "v1", "v2", "pts", "tags", "n_edges").collect())) for f in (graph.contract_blocks, graph.contract_chains)]
    assert got[0] == got[1] and 50 < len(got[0]) < net.count()


def test_pieces_on_the_same_points_are_kept_once(spark):
    a, b, c = (4.0, 51.0), (4.01, 51.0), (4.0, 51.01)
    rows = [(1, 0, 1, 2, [a, b], None), (2, 0, 2, 1, [b, a], None), (3, 0, 1, 3, [a, c], None), (4, 0, 1, 1, [a, a], None), (5, 1, 1, 3, [a, c], None)]
    s = spark.createDataFrame(rows, f"e bigint, piece bigint, v1 bigint, v2 bigint, pts array<{P}>, tags array<struct<k: string, v: string>>")
    got = [sorted(r["e"] for r in x.collect()) for x in (graph.numbered(s), graph.numbered(s, Workspace(spark, "t")))]
    assert got[0] == got[1] == [1 << 22, 3 << 22]
