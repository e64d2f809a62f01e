import random

import __spark_entry__ as entry
from planarloom.llm import components as C
from planarloom.runtime import Workspace

MATCH = "face_a bigint, face_b bigint, is_match boolean"


def groups(spark, tmp_path, matches, faces):
    spark.createDataFrame(matches, MATCH).write.parquet(f"{tmp_path}/face_match.parquet")
    spark.createDataFrame([(f,) for f in faces], "face bigint").write.parquet(f"{tmp_path}/face.parquet")
    return sorted(tuple(r) for r in entry.queries()["p4_found"](spark, str(tmp_path)).collect())


def test_p4_found_on_chains_and_stars(spark, tmp_path):
    chain = list(range(100, 160))
    random.Random(1).shuffle(chain)
    pairs = [(a, b) if i % 2 else (b, a) for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
    pairs += [(500, i) for i in range(501, 540)]
    random.Random(2).shuffle(pairs)
    got = groups(spark, tmp_path, [(a, b, True) for a, b in [*pairs, *pairs[:9]]], [*range(100, 600), 100])
    assert got == [(i, 100) for i in range(100, 160)] + [(i, 500) for i in range(500, 540)]


def test_p4_found_links_only_true_pairs_of_known_faces(spark, tmp_path):
    rows = [(1, 2, True), (2, 3, None), (3, 4, False), (4, 99, True), (99, 5, True), (5, 5, True), (6, None, True), (None, 7, True), (9, 8, True)]
    assert groups(spark, tmp_path, rows, [*range(1, 10), None]) == [(1, 1), (2, 1), (8, 8), (9, 8)]


def test_no_links_give_no_rows(spark):
    none = spark.createDataFrame([], MATCH)
    assert C.linked_groups(none, spark.createDataFrame([], "face bigint"), Workspace(spark, "t")).count() == 0
