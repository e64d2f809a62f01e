"""From ways to a planar graph: way filtering, edges between vertices, splitting at crossings, pruning and contraction.

Edges are rows ``e``, ``v1``, ``v2``, ``pts`` (the whole line of points, both ends included) and ``tags``. Iterations cut
their lineage with written tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarloom.functions import geo, identity, rules, tiles
from planarloom.functions.trig import flat
from planarloom.operators import boxes, crossing
from planarloom.runtime import Workspace, broadcast_if_small, skew_join

#: Side in degrees below which squares are not cut up when segments are looked for that cross.
CROSS_CELL = 1e-5
MAX_DOUBLINGS = 64
#: Rows of identifiers that every task may hold.
HELD = 2_000_000
#: Vertices named by their cell are taken together in blocks of 2^BLOCK x 2^BLOCK tiles.
BLOCK = 2


# Ways ----------------------------------------------------------------------------------------------------------------


def barrier_ways(ways: DataFrame, table: list[tuple] = rules.BARRIER_RULES) -> DataFrame:
    """The ways (way_id, refs, tags) that have refs and tags and are barriers by the rule table."""
    return ways.where("way_id is not null and size(refs) > 0 and tags is not null").where(rules.classify(F.col("tags"), table).isNotNull())


def way_nodes(ways: DataFrame) -> DataFrame:
    """``way_id``, ``pos`` (from 0), ``node_id``, ``is_end`` of every ref; null refs are left out."""
    rows = ways.select("way_id", F.size("refs").alias("_n"), F.posexplode("refs").alias("pos", "node_id"))
    return rows.where("node_id is not null").select("way_id", "pos", "node_id", ((F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)).alias("is_end"))


def vertex_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id``, ``n_uses``, ``is_end`` of the nodes at which the ways meet or end: the first or last of a way, or used
    twice, be it within one way. Nodes without a location are no vertices."""
    used = way_nodes(ways).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_uses"), F.bool_or("is_end").alias("is_end"))
    return used.where("n_uses > 1 or is_end").join(nodes.select("node_id"), "node_id", "left_semi")


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id``, ``seq`` (from 1), ``node1``, ``node2``, ``pts``: the stretches of each way between consecutive vertices.
    Refs without a location are passed over, and what lies before a way's first or behind its last vertex is left out."""
    marks = vertex_nodes(ways, nodes).select("node_id", F.lit(True).alias("_v"))
    located = way_nodes(ways).join(nodes, "node_id").join(marks, "node_id", "left")
    line = Window.partitionBy("way_id").orderBy("pos")
    runs = located.withColumn("seq", F.sum(F.coalesce(F.col("_v"), F.lit(False)).cast("int")).over(line)).where("seq > 0")
    # A run is one stretch of one way, so its list is as short as the way.
    grouped = runs.groupBy("way_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "loc"))).alias("r"))
    following = F.lead("r").over(Window.partitionBy("way_id").orderBy("seq"))
    whole = grouped.withColumn("_n", F.get(following, F.lit(0))).where("_n is not null")
    return whole.select("way_id", "seq", F.get("r", F.lit(0))["node_id"].alias("node1"), F.col("_n.node_id").alias("node2"), F.concat(F.transform("r", lambda x: x["loc"]), F.array("_n.loc")).alias("pts"))


# Vertices ------------------------------------------------------------------------------------------------------------


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """``e``, ``v``, ``other``, ``forward`` of both ends of every edge (of a loop: one) and the columns ``keep``."""
    both = F.array(F.struct(F.col("v1").alias("v"), F.col("v2").alias("other"), F.lit(True).alias("forward")), F.struct(F.col("v2").alias("v"), F.col("v1").alias("other"), F.lit(False).alias("forward")))
    return edges.select("e", *keep, F.explode(F.when(F.col("v1") == F.col("v2"), F.slice(both, 1, 1)).otherwise(both)).alias("_x")).select("e", *keep, "_x.v", "_x.other", "_x.forward")


def degrees(edges: DataFrame) -> DataFrame:
    """``v``, ``degree``; a loop counts once."""
    return ends(edges).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def vertex_boxes(edges: DataFrame) -> DataFrame:
    """``v`` and the box of all its edges' lines."""
    b = ends(edges.withColumn("_b", geo.to_box(F.col("pts"))), "_b")
    return b.groupBy("v").agg(F.min("_b.left").alias("left"), F.max("_b.top").alias("top"), F.max("_b.right").alias("right"), F.min("_b.bottom").alias("bottom"))


def standardize(edges: DataFrame) -> DataFrame:
    """Edges turned so that they run from west to east (between equal longitudes from north to south), with ``reversed``."""
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    back = (b["lon"] < a["lon"]) | ((b["lon"] == a["lon"]) & (b["lat"] > a["lat"]))
    turned = edges.withColumn("reversed", back)
    pick = lambda x, y: F.when(F.col("reversed"), y).otherwise(x)
    return turned.select("e", pick(F.col("v1"), F.col("v2")).alias("v1"), pick(F.col("v2"), F.col("v1")).alias("v2"), pick(F.col("pts"), F.reverse("pts")).alias("pts"), "reversed", *[c for c in edges.columns if c not in ("e", "v1", "v2", "pts")])


# Crossings -----------------------------------------------------------------------------------------------------------


def crossings(edges: DataFrame, size: float = CROSS_CELL, work: Workspace | None = None) -> DataFrame:
    """``e1`` < ``e2``, ``s1``, ``s2``, ``t1``, ``t2``, ``lon``, ``lat``: every proper crossing of two edges' segments, that is,
    in the inside of both. Meeting at an end, or lying on one another, is none. ``t`` is the place on the segment from 0
    to 1. Segments meet in squares that hold few of them; ``size`` is the side below which none is cut up further."""
    seg = boxes.segments(edges, "pts", "e").where((F.col("a.lon") != F.col("b.lon")) | (F.col("a.lat") != F.col("b.lat")))
    seg = seg.select("e", "seg", F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lon").alias("bx"), F.col("b.lat").alias("by"))
    finite = [F.abs(c) < float("inf") for c in ("ax", "ay", "bx", "by")]
    work = work or Workspace(edges.sparkSession, "crossings")
    seg = work.cut(seg.where(finite[0] & finite[1] & finite[2] & finite[3]), "segments")
    return crossing.crossings(seg, size)


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of edges (e, tags, lines, cuts): an edge's points and cuts in the order of segment and place, split at the cuts."""
    for batch in batches:
        e, tags, lines, cuts = batch.columns
        inner, at = lines.flatten(), cuts.flatten()
        points, first = flat(inner)
        line_row = np.repeat(np.arange(len(e)), lines.value_lengths().to_numpy())
        line = np.repeat(np.arange(len(inner)), np.diff(first))
        cut_row = np.repeat(np.arange(len(e)), cuts.value_lengths().fill_null(0).to_numpy())
        row = np.concatenate([line_row[line], cut_row])
        seg = np.concatenate([np.arange(len(points)) - first[:-1][line], at.field("seg").to_numpy()])
        t = np.concatenate([np.zeros(len(points)), at.field("t").to_numpy()])
        places = np.concatenate([points, np.stack([at.field("lon").to_numpy(), at.field("lat").to_numpy()], 1)])
        order = np.lexsort((places[:, 1], places[:, 0], t, seg, row))
        # A cut ends one piece and begins the next, so it stands in both.
        is_cut = order >= len(points)
        twice = 1 + is_cut
        end = np.cumsum(twice)
        row = row[order]
        begins = np.zeros(len(order) + int(is_cut.sum()), bool)
        begins[(end - twice)[np.diff(row, prepend=-1) > 0]] = True
        begins[end[is_cut] - 1] = True
        starts = np.append(np.flatnonzero(begins), len(begins))
        own = np.repeat(row, twice)[starts[:-1]]
        piece = np.arange(len(own)) - np.flatnonzero(np.diff(own, prepend=-1))[np.cumsum(np.diff(own, prepend=-1) > 0) - 1] if len(own) else own
        places = np.repeat(places[order], twice, 0)
        keys = [identity.cell_keys(places[k]) for k in (starts[:-1], starts[1:] - 1)]
        pts = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(places[:, k]) for k in (0, 1)], names=["lon", "lat"]))
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([e.take(take), pa.array(piece, pa.int64()), *[pa.array(k, pa.int64(), mask=k < 0) for k in keys], pts, tags.take(take)], names=["e", "piece", "v1", "v2", "pts", "tags"])


def _pieces(edges: DataFrame, size: float, work: Workspace | None) -> DataFrame:
    """``e``, ``piece``, ``v1``, ``v2``, ``pts``, ``tags`` (a list, of every row of the edge). The crossings are written first, and only
    they and the edges are shuffled, by edge, so the pieces themselves are not."""
    work = work or Workspace(edges.sparkSession, "pieces")
    x = work.cut(crossings(edges, size, work), "crossings")
    work.drop("segments")
    side = lambda k: F.struct(F.col(f"e{k}").alias("e"), F.col(f"s{k}").alias("seg"), F.col(f"t{k}").alias("t"), "lon", "lat")
    cut = x.select(F.explode(F.array(side(1), side(2))).alias("x")).select("x.*")
    cuts = cut.groupBy("e").agg(F.collect_list(F.struct("seg", "t", "lon", "lat")).alias("cuts"))
    tags = F.struct("tags") if "tags" in edges.columns else F.struct(F.lit(None).cast("string").alias("tags"))
    own = edges.groupBy("e").agg(F.collect_list(tags).alias("tags"), F.collect_list("pts").alias("lines"))
    rows = own.join(cuts, "e", "left").select("e", "tags", "lines", "cuts")
    kinds = dict(rows.dtypes)
    point = dict(edges.dtypes)["pts"]
    return rows.mapInArrow(_cut_up, f"e {kinds['e']}, piece bigint, v1 bigint, v2 bigint, pts {point}, tags {kinds['tags']}")


def pieces(edges: DataFrame, size: float = CROSS_CELL) -> DataFrame:
    """``e``, ``piece`` (from 0), ``pts``: the edges cut at every proper crossing with another edge. Uncut edges are piece 0."""
    return _pieces(edges, size, None).select("e", "piece", "pts")


def split(edges: DataFrame, size: float = CROSS_CELL, work: Workspace | None = None) -> DataFrame:
    """``e``, ``piece``, ``v1``, ``v2``, ``pts``, ``tags``: the ``pieces`` of the edges. Vertices are named by their quantised location:
    tile, x and y as one number, so both edges that cross get the same vertex there."""
    return _pieces(edges, size, work).withColumn("tags", F.explode("tags")).select("e", "piece", "v1", "v2", "pts", "tags.tags")


def _as_edges(split_: DataFrame) -> DataFrame:
    return split_.where("v1 <> v2").withColumn("e", F.shiftleft("e", 22) + F.col("piece")).select("e", "v1", "v2", "pts", "tags")


def _same(edges: DataFrame) -> DataFrame:
    """Edges with what those on the same points have in common."""
    key = F.when(F.col("v1") <= F.col("v2"), F.col("pts")).otherwise(F.reverse("pts"))
    return edges.withColumns({"_a": F.least("v1", "v2"), "_b": F.greatest("v1", "v2"), "_k": F.xxhash64(key)})


def _once(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_a", "_b", "_k").agg(F.min(F.struct("e", "v1", "v2", "pts", "tags")).alias("x")).select("x.*")


def numbered(split_: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Pieces as edges: ``e`` becomes one number of the old ``e`` and ``piece`` (below 2^22 pieces an edge); pieces whose ends
    fall together are left out, and of pieces on the same points one is kept. With ``work`` the edges are written first, as
    ``raw``, and only those that are not alone on their points are shuffled with them."""
    if work is None:
        return _once(_same(_as_edges(split_)))
    raw = _same(work.cut(_as_edges(split_), "raw"))
    many = work.cut(raw.groupBy("_a", "_b", "_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "many")
    many = broadcast_if_small(many, HELD)
    keys = ["_a", "_b", "_k"]
    return raw.join(many, keys, "left_anti").select("e", "v1", "v2", "pts", "tags").unionByName(_once(raw.join(many, keys, "left_semi")))


# Fix-points ----------------------------------------------------------------------------------------------------------


def prune_dead_ends(edges: DataFrame, work: Workspace) -> DataFrame:
    """The edges left when edges at a vertex of degree 1 are removed again and again. Loops stay, and so do edges whose
    column ``keep``, if there is one, is true. One round per edge of the longest dead end."""
    cols = [c for c in edges.columns if c in ("e", "v1", "v2", "keep")]
    left, seen = work.cut_counting(edges.select(*cols), "prune0", n=F.lit(True))
    n, k = seen["n"], 0
    kept = F.coalesce(F.col("keep"), F.lit(False)) if "keep" in cols else F.lit(False)
    stays = (F.col("v1") == F.col("v2")) | kept
    while n:
        k += 1
        deg = degrees(left).where("degree = 1").select("v")
        # Vertices of degree 1 have one edge each, so neither join has a hot key.
        free = left.where(~stays).join(deg.withColumnRenamed("v", "v1"), "v1", "left_anti").join(deg.withColumnRenamed("v", "v2"), "v2", "left_anti")
        left, seen = work.cut_counting(free.select(*cols).unionByName(left.where(stays)), f"prune{k}", n=F.lit(True))
        work.drop(f"prune{k - 1}")
        m = seen["n"]
        if m == n:
            break
        n = m
    return edges.join(left.select("e"), "e", "left_semi")


def block(v: Column) -> Column:
    """The block of a vertex that is named by its cell."""
    tile = F.shiftright(v, 28)
    return F.shiftleft(F.shiftright(F.shiftright(tile, tiles.ZOOM), BLOCK), tiles.ZOOM) + F.shiftright(tile.bitwiseAND(F.lit((1 << tiles.ZOOM) - 1)), BLOCK)


def blocks_of(v: np.ndarray) -> np.ndarray:
    """``block`` of many vertices."""
    tile = v >> 28
    return (tile >> tiles.ZOOM >> BLOCK << tiles.ZOOM) + ((tile & ((1 << tiles.ZOOM) - 1)) >> BLOCK)


def in_blocks(edges: DataFrame) -> DataFrame:
    """Edges with ``block``, once for each block one of their ends lies in. So a block has all edges of its vertices."""
    return edges.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("v1")), block(F.col("v2"))))))


def _peeled(key: tuple, table: pa.Table) -> pa.Table:
    """Of a block's edges those that are dead ends, as far as the block shows: ``e`` and the blocks of both ends."""
    own = key[0].as_py()
    e, v1, v2 = (table[c].to_numpy() for c in ("e", "v1", "v2"))
    ends = np.stack([v1, v2], 1)
    here = np.stack([blocks_of(v1), blocks_of(v2)], 1)
    at = np.unique(ends, return_inverse=True)[1].reshape(-1, 2)
    n = np.bincount(at[:, 0], minlength=1) if len(e) == 0 else np.bincount(at.ravel(), minlength=int(at.max()) + 1)
    left = np.arange(len(e))
    gone = np.zeros(len(e), bool)
    while len(left):
        dead = ((n[at[left]] == 1) & (here[left] == own)).any(1)
        if not dead.any():
            break
        gone[left[dead]] = True
        n -= np.bincount(at[left[dead]].ravel(), minlength=len(n))
        left = left[~dead]
    return pa.table({"e": e[gone], "b1": here[gone, 0], "b2": here[gone, 1]})


def prune_blocks(edges: DataFrame, work: Workspace) -> DataFrame:
    """``prune_dead_ends`` of edges without loops between vertices named by their cells. A round takes away all dead ends of a
    block, whatever their length; the next one looks only at blocks into which an edge led that was taken away."""
    left = work.cut(edges.select("e", "v1", "v2"), "prune-ends")
    gone, todo, k = None, None, 0
    while True:
        k += 1
        rows = in_blocks(left)
        if todo is not None:
            rows = rows.join(F.broadcast(todo), "block", "left_semi")
        found = rows.groupBy("block").applyInArrow(_peeled, "e bigint, b1 bigint, b2 bigint")
        found, seen = work.cut_counting(found, f"peeled{k}", n=F.lit(True))
        if not seen["n"]:
            break
        gone = found.select("e") if gone is None else gone.unionByName(found.select("e"))
        todo = found.where("b1 <> b2").select(F.explode(F.array("b1", "b2")).alias("block")).distinct()
        left = left.join(broadcast_if_small(found.select("e"), HELD), "e", "left_anti")
    out = edges if gone is None else edges.join(broadcast_if_small(work.cut(gone.distinct(), "pruned"), HELD), "e", "left_anti")
    work.drop("prune-ends")
    return out


def follow(steps: DataFrame, work: Workspace, label: str) -> DataFrame:
    """``id``, ``least``, ``last``, ``dist``: where each id leads by following ``nx`` (null at an end) as far as it goes.

    ``steps``: ``id``, ``nx``, each id the ``nx`` of one at most. ``least`` is the smallest id on the way; ``last`` is the end
    and ``dist`` the steps to it, both null on a cycle. Pointer doubling: one round per doubling of the longest way. No two
    ids point to one place, so no join has a hot key, and rows that have arrived are not joined.
    """
    state = steps.select("id", "nx", F.least("id", F.coalesce("nx", "id")).alias("least"), F.when(F.col("nx").isNull(), F.col("id")).alias("last"), F.col("nx").isNotNull().cast("bigint").alias("dist"))
    state = work.cut(state, f"{label}0")
    for k in range(1, MAX_DOUBLINGS):
        ahead = state.select(F.col("id").alias("nx"), F.col("nx").alias("_nx"), F.col("least").alias("_least"), F.col("last").alias("_last"), F.col("dist").alias("_dist"))
        moved = state.where("nx is not null").join(ahead, "nx", "left")
        moved = moved.select("id", F.col("_nx").alias("nx"), F.least("least", "_least").alias("least"), F.col("_last").alias("last"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("_nx").isNull() | (F.col("_least") < F.col("least"))).alias("moved"))
        state, seen = work.cut_counting(moved.unionByName(state.where("nx is null").withColumn("moved", F.lit(False))), f"{label}{k}", moved=F.col("moved"))
        work.drop(f"{label}{k - 1}")
        if not seen["moved"]:
            break
    else:
        raise RuntimeError("the ways do not end")
    return state.select("id", "least", "last", F.when(F.col("last").isNotNull(), F.col("dist")).alias("dist"))


def cycles(steps: DataFrame, work: Workspace, label: str) -> DataFrame:
    """``id``, ``nx``, ``least``, ``ahead``: the smallest id of the cycle each id lies on, and how many steps ahead it is.

    ``steps``: ``id``, ``nx``, a permutation. Pointer doubling: an id knows the least of the ids a number of steps ahead, the
    same for all and doubled by each round. When the id it points to knows the same least, the two stretches have an id in
    common, so they cover the cycle; a round later all its ids have seen that, and none is joined any more. So a round costs
    as much as the cycles that are longer than its stretch.
    """
    state = steps.select("id", "nx", F.col("nx").alias("to"), F.col("id").alias("least"), F.lit(0).cast("bigint").alias("ahead"), F.lit(False).alias("done"))
    state = work.cut(state, f"{label}0")
    known = []
    for k in range(MAX_DOUBLINGS):
        there = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("ahead").alias("_ahead"))
        own = F.col("least") <= F.col("_least")
        far = F.when(own, F.col("ahead")).otherwise(F.col("_ahead") + F.lit(1 << k).cast("bigint"))
        moved = state.where("not done").join(there, "to").select("id", "nx", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), far.alias("ahead"), (F.col("least") == F.col("_least")).alias("done"))
        before, (state, seen) = state, work.cut_counting(moved, f"{label}{k + 1}", open=~F.col("done"))
        # Of a round only the ids that have arrived are kept.
        if k:
            known.append(work.cut(before.where("done").select("id", "nx", "least", "ahead"), f"{label}done{k}"))
        work.drop(f"{label}{k}")
        if not seen["open"]:
            break
    else:
        raise RuntimeError("the cycles do not end")
    whole = state.select("id", "nx", "least", "ahead")
    for part in known:
        whole = whole.unionByName(part)
    return whole


def same_tags(a: Column, b: Column) -> Column:
    """Whether two tag lists hold the same tags, whatever their order; null is as empty."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.array_sort(F.coalesce(a, none)) == F.array_sort(F.coalesce(b, none))


def contract_chains(edges: DataFrame, work: Workspace, at_most: DataFrame | None = None) -> DataFrame:
    """``e``, ``v1``, ``v2``, ``pts``, ``tags``, ``n_edges``: chains of edges through vertices with two edges of the same tags
    become one edge with the smallest ``e``. A ring of such vertices becomes a loop at the vertex where its smallest edge
    begins. Loops stay as they are. Chains go on through vertices (``v``) of ``at_most`` only, if it is given."""
    loops = edges.where("v1 = v2").select("e", "v1", "v2", "pts", "tags", F.lit(1).cast("bigint").alias("n_edges"))
    plain = work.cut(edges.where("v1 <> v2").select("e", "v1", "v2", "pts", "tags"), "chain-edges")
    tagged = plain.unionByName(loops.drop("n_edges"))
    # Vertices of two edges: aggregates of fixed size, so a hub costs no more than any vertex.
    out = F.struct("e", "forward", "tags")
    at = ends(tagged, "tags").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(out).alias("a"), F.max(out).alias("b")).where("n = 2")
    loop_at = loops.select(F.col("v1").alias("v"))
    at = at.join(loop_at, "v", "left_anti").where(same_tags(F.col("a.tags"), F.col("b.tags")))
    if at_most is not None:
        at = at.join(at_most, "v", "left_semi")
    # Half-edge 2e runs forward, 2e+1 back. Arriving at the vertex by one edge, one leaves by the other.
    leaves = lambda x: F.col(f"{x}.e") * 2 + F.when(F.col(f"{x}.forward"), 0).otherwise(1)
    arrives = lambda x: F.col(f"{x}.e") * 2 + F.when(F.col(f"{x}.forward"), 1).otherwise(0)
    nexts = at.select(F.explode(F.array(F.struct(arrives("a").alias("id"), leaves("b").alias("nx")), F.struct(arrives("b").alias("id"), leaves("a").alias("nx")))).alias("x")).select("x.*")
    halves = plain.select(F.explode(F.array(F.col("e") * 2, F.col("e") * 2 + 1)).alias("id"))
    steps = work.cut(halves.join(nexts, "id", "left"), "chain-steps")
    ways = work.cut(follow(steps, work, "chain"), "chain-ways")
    # Rings are opened before their smallest half-edge and followed once more; those that begin with a half-edge 2e+1 are
    # the same rings backwards.
    ring = ways.where("last is null").select("id", "least").where(F.col("least") % 2 == 0)
    opened = ring.join(steps, "id").select("id", F.when(F.col("nx") != F.col("least"), F.col("nx")).alias("nx"))
    again = follow(opened, work, "ring").join(ring.select("id", F.col("least").alias("start")), "id")
    rings = again.select("id", F.col("start").alias("chain"), "dist")
    # A path is taken in the direction whose last edge is the greater one; of a single edge forward.
    ends_of = ways.where("last is not null").select("id", "last", "dist")
    back = ends_of.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("last").alias("first"))
    last_e, first_e = F.shiftright("last", 1), F.shiftright("first", 1)
    paths = ends_of.join(back, "id").where((last_e > first_e) | ((last_e == first_e) & (F.col("id") % 2 == 0)))
    parts = rings.unionByName(paths.select("id", F.col("last").alias("chain"), "dist"))
    e = parts.withColumn("e", F.shiftright("id", 1)).join(plain, "e")
    fwd = F.col("id") % 2 == 0
    pick = lambda a, b: F.when(fwd, a).otherwise(b)
    e = e.select("chain", "dist", "e", "tags", pick(F.col("v1"), F.col("v2")).alias("v1"), pick(F.col("v2"), F.col("v1")).alias("v2"), pick(F.col("pts"), F.reverse("pts")).alias("pts"))
    # A chain's line is a value of the result, so its points meet in one row.
    joined = e.groupBy("chain").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("n_edges"), F.max(F.struct("dist", "v1")).alias("_f"), F.min(F.struct("dist", "v2")).alias("_l"), F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "pts"))).alias("r"), F.min(F.struct("e", "tags")).alias("_t"))
    line = F.concat(F.get("r", F.lit(0))["pts"], F.flatten(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda q: F.slice(q["pts"], 2, F.size(q["pts"]) - 1))))
    made = joined.select("e", F.col("_f.v1").alias("v1"), F.col("_l.v2").alias("v2"), line.alias("pts"), F.col("_t.tags").alias("tags"), "n_edges")
    return made.unionByName(loops)


def joined_lines(table: pa.Table, places: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    """The lines of half-edges (place 2k of ``table``'s row k forward, 2k+1 back) one behind the other, a new one from each that
    ``begins``; what follows gives its points but the first."""
    points, starts = flat(table["pts"].chunk(0)) if len(table) else (np.zeros((0, 2)), np.zeros(1, int))
    skip = (~begins).astype(int)
    n = np.diff(starts)[places >> 1] - skip
    line = np.repeat(np.arange(len(places)), n)
    k = np.arange(len(line)) - (np.cumsum(n) - n)[line] + skip[line]
    low, high = starts[:-1][places >> 1][line], starts[1:][places >> 1][line]
    points = points[np.where((places & 1)[line] == 1, high - 1 - k, low + k)]
    upto = np.concatenate([[0], np.cumsum(n)])[np.append(np.flatnonzero(begins), len(places))]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, c]) for c in (0, 1)], names=["lon", "lat"]))


def _contracted(key: tuple, table: pa.Table) -> pa.Table:
    """The chains of a block whose vertices all lie in it, with ``n_edges``; its other edges, each in the block of its ``v1``; and the
    vertices (as ``v1``, without ``e``) at which those go on."""
    own, table = key[0].as_py(), table.combine_chunks()
    e, v1, v2, k1, k2 = (table[c].to_numpy() for c in ("e", "v1", "v2", "k1", "k2"))
    n = len(e)
    start = np.stack([v1, v2], 1).ravel()
    here = blocks_of(start) == own
    order = np.argsort(start, kind="stable")
    first = np.flatnonzero(np.diff(start[order], prepend=-1))
    two = first[(np.diff(np.append(first, 2 * n)) == 2) & here[order[first]]]
    p, q = order[two], order[two + 1]
    same = (k1[p >> 1] == k1[q >> 1]) & (k2[p >> 1] == k2[q >> 1])
    p, q = p[same], q[same]
    # Arriving at such a vertex by one edge, one leaves by the other.
    nx = np.full(2 * n, -1)
    nx[p ^ 1], nx[q ^ 1] = q, p
    to, dist, step = np.where(nx < 0, np.arange(2 * n), nx), (nx >= 0).astype(int), 1
    while step <= 2 * n and (nx[to] >= 0).any():
        dist, to, step = dist + dist[to], to[to], 2 * step
    ring = nx[to] >= 0
    whole = ring | (here[to ^ 1] & here[to[np.arange(2 * n) ^ 1] ^ 1])
    # A path is taken in the direction whose last edge is the greater one; of a single edge forward.
    begin = np.flatnonzero(~ring & (nx[np.arange(2 * n) ^ 1] < 0))
    last_e, first_e = e[to[begin] >> 1], e[begin >> 1]
    chosen = np.zeros(2 * n, bool)
    chosen[to[begin[(last_e > first_e) | ((last_e == first_e) & (begin % 2 == 0))]]] = True
    at = np.flatnonzero(chosen[to] & whole & ~ring)
    at = at[np.lexsort((-dist[at], to[at]))]
    begins = np.diff(to[at], prepend=-1) != 0
    # A ring begins with its smallest edge.
    some, more, seen = np.flatnonzero(ring), [], set()
    for x in some[np.argsort(2 * e[some >> 1] + some % 2)].tolist():
        if x >> 1 not in seen:
            way = [x]
            while nx[way[-1]] != x:
                way.append(int(nx[way[-1]]))
            seen.update(y >> 1 for y in way)
            more.append(way)
    at = np.concatenate([at, *more]).astype(int)
    begins = np.concatenate([begins, *[np.arange(len(w)) == 0 for w in more]]).astype(bool)
    lead = np.flatnonzero(begins)
    count = np.diff(np.append(lead, len(at)))
    chain = np.repeat(np.arange(len(lead)), count)
    least = (at >> 1)[np.lexsort((e[at >> 1], chain))][lead] if len(at) else at
    tail = lead + count - 1
    rest = np.flatnonzero(~whole[::2] & here[::2])
    on = np.unique(start[np.concatenate([p[~whole[p]], q[~whole[q]]])])
    m = pa.nulls(len(on), pa.int64())
    take = lambda c, k: table[c].chunk(0).take(pa.array(k)) if n else table[c].combine_chunks()
    pts = joined_lines(table, at, begins)
    columns = {
        "e": [pa.array(e[least]), pa.array(e[rest]), m],
        "v1": [pa.array(start[at[lead]]), pa.array(v1[rest]), pa.array(on)],
        "v2": [pa.array(start[at[tail] ^ 1]), pa.array(v2[rest]), m],
        "pts": [pts, take("pts", rest).cast(pts.type), pa.nulls(len(on), pts.type)],
        "tags": [take("tags", least), take("tags", rest), pa.nulls(len(on), table["tags"].type)],
        "n_edges": [pa.array(count.astype(np.int64)), pa.nulls(len(rest), pa.int64()), m],
    }
    return pa.table({k: pa.chunked_array(v) for k, v in columns.items()})


def contract_blocks(edges: DataFrame, work: Workspace) -> DataFrame:
    """``contract_chains`` of edges without loops between vertices named by their cells. Chains within a block of tiles are put
    together there; only the others are followed by joins."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    tags = F.array_sort(F.coalesce("tags", none))
    rows = in_blocks(edges.select("e", "v1", "v2", "pts", "tags", F.xxhash64(tags).alias("k1"), F.hash(tags).alias("k2")))
    kinds = dict(edges.dtypes)
    found = rows.groupBy("block").applyInArrow(_contracted, f"e bigint, v1 bigint, v2 bigint, pts {kinds['pts']}, tags {kinds['tags']}, n_edges bigint")
    found = work.cut(found, "chained")
    rest = found.where("e is not null and n_edges is null").drop("n_edges")
    on = found.where("e is null").select(F.col("v1").alias("v"))
    return found.where("n_edges is not null").unionByName(work.cut(contract_chains(rest, work, on), "rest-chains"))


def reachable_tiles(edge_tiles: DataFrame, start: DataFrame, work: Workspace) -> DataFrame:
    """``tile``: all tiles that loading ``start`` brings in, again and again: every edge with a point in a loaded tile needs all
    the tiles of its points. ``edge_tiles``: distinct (e, tile)."""
    pairs = work.cut(edge_tiles.select("e", "tile").distinct(), "edge-tiles")
    n_pairs = pairs.count()
    loaded = work.cut(start.select("tile").distinct(), "tiles0")
    fresh, k = loaded, 0
    while fresh.limit(1).count():
        k += 1
        # A tile may have very many edges: those of hot tiles join by broadcast of the tile only.
        touched = skew_join(pairs, fresh, "tile", "inner", n_pairs).select("e").distinct()
        found = pairs.join(touched, "e", "left_semi").select("tile").distinct().join(loaded, "tile", "left_anti")
        fresh = work.cut(found, f"fresh{k}")
        loaded = work.cut(loaded.unionByName(fresh), f"tiles{k}")
        work.drop(f"tiles{k - 1}", f"fresh{k - 1}")
    return loaded
