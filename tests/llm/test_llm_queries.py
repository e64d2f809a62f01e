import random

import __spark_entry__ as entry
import pytest

from planarloom.llm import leakage as L
from planarloom.llm import packing as P
from planarloom.llm import splitting as S
from planarloom.llm.canon import Matcher
from planarloom.llm.tokens import count_tokens
from planarloom.runtime import Workspace

CANON = [(1, "landuse", "forest", ["bosgebied"]), (2, "landuse", "village_green", ["brink"]), (3, "highway", "residential", None), (4, "landuse", "residential", [])]
DOC = "doc_id bigint, text string"


@pytest.mark.parametrize(
    ("k", "v", "want"),
    [("landuse", " FORЕST ", 1), ("landuse", '"bosgbeied" area', 1), ("landuse", "Village g.", 2), ("landuse", "villagegreen", 2), ("landuse", "fôrests", 1), ("landuse", "brimk (old)", 2)]
    + [("highway", "residental", 3), ("landuse", "residental", 4), ("highway", "forest", 0), ("landuse", "???", 0), ("landuse", "moon base", 0), ("landuse", "divers 21", 0)],
)
def test_values_mean_the_entry_of_their_key(k, v, want):
    assert Matcher(CANON)._find(k, v) == want


def test_p6_found_lists_every_case_once(spark, tmp_path):
    tags = "way_id bigint, tags array<struct<k string, v string>>"
    way = [(1, [("landuse", "forest"), ("landuse", "Forest"), ("landuse", "FOREST"), ("name", "Forest"), ("highway", " "), ("highway", None)]), (2, [("highway", "yes")]), (2, [("highway", "yes")]), (3, None)]
    spark.createDataFrame(way, tags).write.parquet(f"{tmp_path}/way.parquet")
    spark.createDataFrame([(9, "bosgebied"), (9, "bosgebied"), (10, None), (11, "forest")], "way_id bigint, landuse_type string").write.parquet(f"{tmp_path}/landuse.parquet")
    spark.createDataFrame(CANON, "canon_id bigint, k string, value string, aliases array<string>").write.parquet(f"{tmp_path}/canon_value.parquet")
    got = sorted(tuple(r) for r in entry.queries()["p6_found"](spark, str(tmp_path)).collect())
    assert got == [("landuse", 9, "landuse", 1), ("way", 1, "landuse", 1), ("way", 2, "highway", 0)]


def test_p7_containers_hold_every_text_once(spark, tmp_path):
    rnd = random.Random(4)
    texts = {i: "é " + "a+ " * rnd.randint(0, 400) for i in range(300)} | {500: "b (c) " * 3000, 501: "", 502: " \n", 503: "x " * 2048}
    spark.createDataFrame([*texts.items(), (600, None)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (entry.queries()["p7_containers"](spark, str(tmp_path)).collect(), P.pack(spark.createDataFrame([*texts.items()], DOC), Workspace(spark, "t"), bucket=7).collect()):
        whole, load = {}, {}
        for r in sorted(rows, key=lambda r: r["piece"]):
            assert count_tokens(r["text"]) == r["n_tokens"]
            whole[r["doc_id"]] = whole.get(r["doc_id"], "") + r["text"]
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert whole == texts and max(load.values()) <= 2048
        assert {r["doc_id"] for r in rows if r["piece"] > 1} == {500}
        total = sum(map(count_tokens, texts.values()))
        assert sorted(load) == list(range(1, len(load) + 1)) and len(load) <= total // 2048 + 2


def test_best_fit_fills_exactly():
    runs = P.best_fit({6: 3, 4: 3, 3: 4, 1: 5}, 10)
    load = {}
    for s, _, n, start in runs:
        for c in range(start, start + n):
            load[c] = load.get(c, 0) + s
    assert max(load.values()) == 10 and len(load) == 5 and sum(load.values()) == 47


ITEM = [f"w{i}" for i in range(100)]


def edited(n, edits, how, start=20):
    """``n`` words of the item with ``edits`` edits as evenly spread as possible."""
    out = ITEM[start : start + n]
    for k in range(edits, 0, -1):
        at = k * n // (edits + 1)
        out[at : at + (how != "add")] = [] if how == "drop" else [f"new{k}"]
    return "before it; " + "\n+ ".join(x.upper() for x in out) + " after"


def test_p8_found_allows_one_edit_in_ten(spark, tmp_path):
    docs, want = [], set()
    for i, (n, e, how, leak) in enumerate(
        [(30, 0, "", True), (26, 0, "", False), (30, 3, "replace", True), (30, 3, "drop", True), (30, 3, "add", True), (30, 4, "replace", False), (30, 4, "add", False), (59, 5, "replace", True), (80, 8, "replace", True), (80, 8, "drop", True), (60, 12, "replace", False)]
    ):
        docs.append((i, edited(n, e, how)))
        want |= {(i, 7)} if leak else set()
    docs += [(90, docs[0][1]), (91, " ".join(reversed(ITEM))), (92, ""), (93, None)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ". ".join(ITEM)), (8, "short item"), (9, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    rows = [tuple(r) for r in entry.queries()["p8_found"](spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want | {(90, 7)}


def pieces_hold(text, parts):
    tokens = [m.group() for m in S.TOKEN.finditer(text)]
    assert "".join(text[f:e] for f, _, e, _ in parts) == text
    done = []
    for i, (f, s, e, n) in enumerate(parts):
        own = [m.group() for m in S.TOKEN.finditer(text[s:e])]
        assert len(own) == n <= 1024
        if i:
            assert own[:64] == done[-64:] and text[s:f] == text[s:][: f - s]
        done = own
    assert sum(p[3] for p in parts) - 64 * (len(parts) - 1) == len(tokens)


def test_pieces_are_balanced_and_cut_at_boundaries():
    assert S.split_text("a " * 1024) == []
    flat = "a " * 3000
    parts = S.split_text(flat)
    pieces_hold(flat, parts)
    assert len(parts) == 4 and max(p[3] for p in parts) - min(p[3] for p in parts) <= 2
    rnd = random.Random(8)
    for _ in range(20):
        lines = [" " * rnd.randint(0, 3) + "word+ " * rnd.randint(0, 40) + rnd.choice(["", "end.", "@@ no"]) for _ in range(rnd.randint(60, 300))]
        for at in range(40, len(lines), 45):
            lines[at] = "@@ -1,2 +3,4 @@ x"
        text = "\n".join(lines)
        parts = S.split_text(text)
        pieces_hold(text, parts)
        assert all(text[f - 1] == "\n" or text[:f].rstrip(" ")[-1] == "\n" for f, _, _, _ in parts[1:])


def test_p9_queries(spark, tmp_path):
    docs = [(1, "a " * 1024), (2, "a " * 1025), (3, "a\n" * 1500 + "b. " * 600 + "\nc"), (4, "ab" * 5000), (5, None), (6, "a b\n" * 600)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    assert sorted(tuple(r) for r in q["p9_found"](spark, str(tmp_path)).collect()) == [(2, 0), (2, 1), (3, 0), (3, 1501), (6, 0)]
    rows = q["p9_pieces"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {2, 3, 6}
    for d, text in docs:
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        if own:
            assert "".join(text[r["first"] : r["end"]] for r in own) == text and all(count_tokens(r["text"]) == r["n_tokens"] <= 1024 for r in own)


@pytest.mark.parametrize(("k", "v", "want"), [("landuse", "forset", 1), ("landuse", "boos gebied zone", 1), ("highway", "resdntial.", 3), ("landuse", "ок", 0), ("landuse", "x" * 100_000, 0), ("nokey", "forest", 0)])
def test_cosine_candidates_and_their_check(k, v, want):
    assert Matcher(CANON)._find(k, v) == want


def test_p6_joins_frequent_values_back(spark, monkeypatch):
    import planarloom.runtime as R
    from planarloom.llm.canon import map_values

    monkeypatch.setattr(R, "HOT_FLOOR", 5)
    values = spark.createDataFrame([("way", i, "landuse", "Forest" if i % 2 else f"forest {i}") for i in range(60)] + [("way", 99, "landuse", None), (None, None, None, None)], "origin string, way_id bigint, k string, v string")
    canon = spark.createDataFrame(CANON, "canon_id bigint, k string, value string, aliases array<string>")
    got = map_values(values, canon, Workspace(spark, "t")).collect()
    assert len(got) == 60 and {r["canon_id"] for r in got} == {1} and {r["way_id"] for r in got} == set(range(60))
    assert map_values(values.limit(0), canon, Workspace(spark, "t")).count() == 0
    assert map_values(values, canon.limit(0), Workspace(spark, "t")).count() == 0


def test_packing_merges_what_partitions_leave(spark):
    rows = [(i, "a " * (700 if i % 3 else 1200)) for i in range(400)]
    out = P.pack(spark.createDataFrame(rows, DOC).repartition(8), Workspace(spark, "t"), bucket=11).collect()
    load = {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
    assert len(out) == 400 and max(load.values()) <= 2048
    # 134 of 1,200 take one of 700 each, the other 132 of 700 go in pairs
    assert len(load) <= 134 + 66 + 8
    assert P.pack(spark.createDataFrame([], DOC), Workspace(spark, "t")).count() == 0


def test_p8_blocks_of_items_give_the_same(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 6}x{j}" for j in range(5, 40))) for i in range(12)], DOC)
    for block in (1, 120, 10_000):
        assert sorted(tuple(r) for r in L.leaked(docs, items, block).collect()) == [(i, i % 6) for i in range(12)]
    assert L.leaked(docs, items.limit(0)).count() == 0 and L.leaked(docs.limit(0), items).count() == 0


def test_pieces_are_added_when_a_limit_fails():
    # 2,944 tokens fit 3 pieces only if the cuts lie exactly; the lines do not allow that
    text = "\n".join("a " * 90 for _ in range(33))[: 2944 * 2 + 32]
    parts = S.split_text(text)
    pieces_hold(text, parts)
    assert len(parts) >= 3
