"""Faces of a planar graph: half-edges in their order around a vertex, orbits of always turning right, rings and polygons.

Half-edge ``2e`` runs along edge ``e``, ``2e+1`` against it. With the half-edges leaving a vertex sorted counter-clockwise,
what follows an arriving half-edge when one always turns right is the entry after its own reverse. This makes the graph a
permutation of half-edges whose cycles are the faces, labelled by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarloom.functions import geo, identity, tiles
from planarloom.functions.trig import flat
from planarloom.operators import graph
from planarloom.operators.landuse import spread
from planarloom.runtime import Workspace, broadcast_if_small

#: Tiles that every task may hold, and pairs of box and tile formed at once.
HELD, PAIRS = 2_000_000, 1_000_000


def half_edges(edges: DataFrame) -> DataFrame:
    """``h``, ``e``, ``v_from``, ``v_to``, ``azimuth`` (towards the line's first point off the vertex) of both directions of every
    edge that is no loop."""
    p, n = F.col("pts"), F.size("pts")
    one = F.struct((F.col("e") * 2).alias("h"), F.col("v1").alias("v_from"), F.col("v2").alias("v_to"), geo.azimuth(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("azimuth"))
    two = F.struct((F.col("e") * 2 + 1).alias("h"), F.col("v2").alias("v_from"), F.col("v1").alias("v_to"), geo.azimuth(F.get(p, n - 1), F.get(p, n - 2)).alias("azimuth"))
    return edges.where("v1 <> v2").select("e", F.explode(F.array(one, two)).alias("x")).select("x.h", "e", "x.v_from", "x.v_to", "x.azimuth")


def turn(half: DataFrame, right: bool = True, back: bool = False) -> DataFrame:
    """``h``, ``nx``: the half-edge that follows each arriving one by the sharpest turn to the right (or left); null at a
    vertex of one edge, or with ``back`` the way back. Equal directions are ordered by ``h``. A vertex's half-edges are sorted in one window, which spills."""
    around = Window.partitionBy("v_from").orderBy("azimuth", "h")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.lead("h").over(around), F.first("h").over(whole)) if right else F.coalesce(F.lag("h").over(around), F.last("h").over(whole))
    turned = half.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), step.alias("nx"), F.col("h").alias("_own"))
    return turned.select("h", "nx") if back else turned.select("h", F.when(F.col("nx") != F.col("_own"), F.col("nx")).alias("nx"))


def clockwise_order(half: DataFrame) -> DataFrame:
    """``h``, ``v``, ``rank`` (from 1), ``degree``: the half-edges leaving each vertex, counter-clockwise from east. Seen from one
    that arrives, the others follow in this order after its reverse."""
    around = Window.partitionBy("v_from").orderBy("azimuth", "h")
    return half.select("h", F.col("v_from").alias("v"), F.row_number().over(around).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("v_from")).alias("degree"))


def loops(half: DataFrame, work: Workspace, label: str = "loops", back: bool = False) -> DataFrame:
    """``h``, ``loop``: the cycle each half-edge lies on, named by its smallest; null when the way leads to a dead end, unless
    ``back`` turns round there."""
    steps = work.cut(turn(half, back=back).select(F.col("h").alias("id"), "nx"), f"{label}-turns")
    ways = graph.follow(steps, work, label)
    return ways.select(F.col("id").alias("h"), F.when(F.col("last").isNull(), F.col("least")).alias("loop"))


def assign_faces(edges: DataFrame, work: Workspace) -> DataFrame:
    """``h``, ``e``, ``v_from``, ``v_to``, ``nx``, ``face``, ``ahead``: the half-edges that bound a face on their right, the face,
    and how many steps ahead its smallest half-edge is.

    An edge whose two sides lie on one loop (a bridge or a spur) bounds nothing: such edges are taken out and the loops
    formed anew until there are none, so every face is a closed way that passes no edge twice. The loop round the outside
    of a component is a face as well. A loop without such edges stays as it is, so only the others are formed anew.
    """
    whole = work.cut(half_edges(edges), "halves")
    settled = _assigned(turn(whole, back=True).select(F.col("h").alias("id"), "nx"), lambda e: whole.join(e, "e", "left_semi"), work)
    return whole.drop("e", "azimuth").join(settled.withColumnRenamed("id", "h"), "h").select("h", "e", "v_from", "v_to", "nx", F.col("least").alias("face"), "ahead")


def _assigned(steps: DataFrame, halves: Callable[[DataFrame], DataFrame], work: Workspace) -> DataFrame:
    """``id``, ``e``, ``nx``, ``least``, ``ahead`` of the half-edges of loops (a permutation ``id``, ``nx``) that bound a face. ``halves``: the
    half-edges of given edges (``e``)."""
    settled, k = None, 0
    while True:
        k += 1
        found = graph.cycles(steps, work, f"loops{k}-").withColumn("e", F.shiftright("id", 1))
        sides = found.groupBy("e").agg(F.count(F.lit(1)).alias("_n"), F.min("least").alias("least"), F.max("least").alias("_b"))
        bad, seen = work.cut_counting(sides.where("_n = 2 and least = _b").select("e", "least"), f"bridges{k}", n=F.lit(True))
        if not seen["n"]:
            settled = found if settled is None else settled.unionByName(found)
            break
        torn = bad.select("least").distinct()
        good = found.join(torn, "least", "left_anti").select(found.columns)
        settled = good if settled is None else settled.unionByName(good)
        again = work.cut(found.join(torn, "least", "left_semi").join(bad.select("e"), "e", "left_anti").select("id", "e"), f"again{k}")
        # The other sides of their edges stand in the order around a vertex too; what follows a half-edge of such a loop is one again.
        half = halves(again.select("e").distinct())
        steps = turn(half, back=True).withColumnRenamed("h", "id").join(again.select("id"), "id", "left_semi")
    return settled


TRACED = "h bigint, nx bigint, face bigint, n_edges bigint, ring array<struct<lon: double, lat: double>>"


def _traced(key: tuple, table: pa.Table) -> pa.Table:
    """The loops of a block (see ``trace``), as rows ``TRACED``."""
    own, table = key[0].as_py(), table.combine_chunks()
    e, v1, v2, a1, a2 = (table[c].to_numpy() for c in ("e", "v1", "v2", "a1", "a2"))
    n = len(e)
    # Place 2k is edge k forward, 2k+1 back, so the other side of a half-edge is at its place with the last bit turned.
    h = (2 * e[:, None] + np.arange(2)).ravel()
    start, azimuth = np.stack([v1, v2], 1).ravel(), np.stack([a1, a2], 1).ravel()
    leaves = np.flatnonzero(graph.blocks_of(start) == own)
    leaves = leaves[np.lexsort((h[leaves], azimuth[leaves], start[leaves]))]
    fresh = np.diff(start[leaves], prepend=-1) != 0
    first, size = np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(leaves)))
    following = np.append(leaves[1:], -1)
    following[first + size - 1] = leaves[first]
    # The last place stands for all that is not known here.
    nx = np.full(2 * n + 1, 2 * n)
    nx[leaves ^ 1] = following
    # Pointer doubling, as in ``graph.cycles``.
    names = np.append(h, -1)
    least, ahead, to, step = names, np.zeros(2 * n + 1, int), nx, 1
    while True:
        there = least[to]
        ahead = np.where(least <= there, ahead, ahead[to] + step)
        done = np.array_equal(least, there)
        least, to, step = np.minimum(least, there), to[to], 2 * step
        if done:
            break
    whole = least[:-1] >= 0
    torn = np.unique(least[:-1:2][(least[:-1:2] == least[1:-1:2]) & whole[::2]])
    whole &= ~np.isin(least[:-1], torn)
    open_ = np.flatnonzero(~whole & (nx[:-1] < 2 * n))
    # Rings: the smallest half-edge comes first, then the one farthest from coming to it again.
    at = np.flatnonzero(whole)
    at = at[np.lexsort((np.where(ahead[at] > 0, -ahead[at], np.iinfo(np.int64).min), least[at]))]
    face = least[at]
    begins = np.diff(face, prepend=-1) != 0
    lead, ring = np.flatnonzero(begins), graph.joined_lines(table, at, begins)
    none = lambda m, kind: pa.nulls(m, kind)
    m, o, r = len(at), len(open_), len(lead)
    columns = {
        "h": pa.chunked_array([pa.array(h[at]), pa.array(h[open_]), none(r, pa.int64())]),
        "nx": pa.chunked_array([none(m, pa.int64()), pa.array(names[nx[open_]]), none(r, pa.int64())]),
        "face": pa.chunked_array([pa.array(face), none(o, pa.int64()), pa.array(face[lead])]),
        "n_edges": pa.chunked_array([none(m + o, pa.int64()), pa.array(np.diff(np.append(lead, m)).astype(np.int64))]),
        "ring": pa.chunked_array([none(m + o, ring.type), ring]),
    }
    return pa.table(columns)


def trace(edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``assign_faces`` (``h``, ``e``, ``face`` only) and ``rings`` of edges between vertices named by their cells, with the same faces.

    Loops whose vertices all lie in one block of tiles are followed there, and their rings put together, so an edge is
    shuffled once with its line. Only the other loops, and those with an edge on both their sides, are followed by joins."""
    lines = edges.where("v1 <> v2")
    p, n = F.col("pts"), F.size("pts")
    ends = {"a1": geo.azimuth(F.get(p, F.lit(0)), F.get(p, F.lit(1))), "a2": geo.azimuth(F.get(p, n - 1), F.get(p, n - 2))}
    rows = graph.in_blocks(lines.select("e", "v1", "v2", "pts").withColumns(ends))
    traced = work.cut(rows.groupBy("block").applyInArrow(_traced, TRACED), "traced")
    rest = work.cut(traced.where("h is not null and face is null").select(F.col("h").alias("id"), "nx"), "rest")
    own = broadcast_if_small(rest.select(F.shiftright("id", 1).alias("e")).distinct(), graph.HELD)
    few = work.cut(lines.join(own, "e", "left_semi").select("e", "v1", "v2", "pts"), "rest-edges")
    others = work.cut(_assigned(rest, lambda e: half_edges(few).join(e, "e", "left_semi"), work), "rest-faces")
    closed = traced.where("h is not null and face is not null").select("h", F.shiftright("h", 1).alias("e"), "face")
    ringed = traced.where("ring is not null").select("face", "n_edges", "ring")
    others = others.select(F.col("id").alias("h"), F.shiftright("id", 1).alias("e"), F.col("least").alias("face"), "ahead")
    return closed.unionByName(others.drop("ahead")), ringed.unionByName(work.cut(rings(others, few), "rest-rings"))


def rings(assigned: DataFrame, edges: DataFrame, _work: Workspace | None = None) -> DataFrame:
    """``face``, ``n_edges``, ``ring``: the closed line of points of every face, from the start of its smallest half-edge, in the
    direction in which the face lies on the right, however many its edges are. No face has one edge only, as an edge that is
    a loop has no half-edges."""
    line = assigned.select("h", "e", "face", "ahead").join(edges.select("e", "pts"), "e")
    # The smallest half-edge comes first, then the one farthest from coming to it again.
    order = F.when(F.col("ahead") > 0, -F.col("ahead")).otherwise(F.lit(-(1 << 62)).cast("bigint"))
    line = line.select("face", order.alias("o"), F.when(F.col("h") % 2 == 0, F.col("pts")).otherwise(F.reverse("pts")).alias("pts"))
    parts = line.groupBy("face").agg(F.count(F.lit(1)).alias("n_edges"), F.array_sort(F.collect_list(F.struct("o", "pts"))).alias("r"))
    ring = F.concat(F.get("r", F.lit(0))["pts"], F.flatten(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda q: F.slice(q["pts"], 2, F.size(q["pts"]) - 1))))
    return parts.select("face", "n_edges", ring.alias("ring"))


def polygons(ringed: DataFrame) -> DataFrame:
    """``face``, ``face_guid``, ``n_edges``, ``signed_area`` (positive counter-clockwise), ``is_outer``, ``ring`` of the faces whose
    ring has more than three points. The loop round the outside of a component runs counter-clockwise: ``is_outer``."""
    area = -geo.signed_area(F.col("ring"))
    rows = ringed.where(F.size("ring") > 3).select("face", "n_edges", area.alias("signed_area"), (area > 0).alias("is_outer"), "ring")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            face, n_edges, signed, outer, ring = batch.columns
            guid = pa.array(identity.face_guids(*flat(ring)), pa.string())
            yield pa.RecordBatch.from_arrays([face, guid, n_edges, signed, outer, ring], names=["face", "face_guid", "n_edges", "signed_area", "is_outer", "ring"])

    return rows.mapInArrow(named, "face bigint, face_guid string, n_edges bigint, signed_area double, is_outer boolean, ring array<struct<lon: double, lat: double>>")


def adjacency(assigned: DataFrame) -> DataFrame:
    """``face_a`` < ``face_b``, ``n_edges``: faces on the two sides of an edge."""
    two = assigned.groupBy("e").agg(F.min("face").alias("face_a"), F.max("face").alias("face_b")).where("face_a < face_b")
    return two.groupBy("face_a", "face_b").agg(F.count(F.lit(1)).alias("n_edges"))


class KnownTiles:
    """Distinct tiles by row and column, and which of them ranges of columns and rows touch."""

    def __init__(self, tile: np.ndarray, zoom: int):
        self.tile = np.unique(tile)
        self.y, self.x = self.tile >> zoom, self.tile & ((1 << zoom) - 1)
        self.rows, self.first = np.unique(self.y, return_index=True)
        self.key = (np.searchsorted(self.rows, self.y) << zoom) + self.x
        self.zoom = zoom

    def touched(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of range and of tile, of all pairs that touch, some ``PAIRS`` at a time."""
        most = (1 << self.zoom) - 1
        x0, x1 = np.maximum(x0, 0), np.minimum(x1, most)
        low, high = np.searchsorted(self.rows, y0), np.searchsorted(self.rows, y1, "right")
        box = np.flatnonzero((x0 <= x1) & (low < high))
        for part in chunks((high - low)[box]):
            b = box[part]
            own, row = spread((high - low)[b])
            row += low[b[own]]
            start = np.searchsorted(self.key, (row << self.zoom) + x0[b[own]])
            stop = np.searchsorted(self.key, (row << self.zoom) + x1[b[own]], "right")
            some = np.flatnonzero(stop > start)
            own, start, n = own[some], start[some], (stop - start)[some]
            for few in chunks(n):
                line, at = spread(n[few])
                yield b[own[few][line]], start[few][line] + at


def chunks(n: np.ndarray, size: int = PAIRS) -> Iterator[slice]:
    """Consecutive stretches of lists of sizes ``n`` that hold at most ``size`` places together, or one list."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield slice(at, stop)
        at = stop


def known_tiles(known: DataFrame, zoom: int = tiles.ZOOM) -> KnownTiles | None:
    """The tiles as an index that every task holds; None if there are more than ``HELD``."""
    some = known.where(F.col("tile").between(0, (1 << 2 * zoom) - 1)).select(F.col("tile").cast("bigint").alias("tile")).distinct()
    got = some.limit(HELD + 1).toArrow().column("tile").to_numpy()
    return KnownTiles(got, zoom) if len(got) <= HELD else None


def spans(box: Column, zoom: int = tiles.ZOOM) -> list[Column]:
    """First and last column and row of the tiles a box touches."""
    ends = {"x0": tiles.tile_x(box["left"], zoom), "x1": tiles.tile_x(box["right"], zoom), "y0": tiles.tile_y(box["top"], zoom), "y1": tiles.tile_y(box["bottom"], zoom)}
    return [c.alias(k) for k, c in ends.items()]


def boxes_in_tiles(rows: DataFrame, ident: str, box: str, known: DataFrame, zoom: int = tiles.ZOOM) -> DataFrame:
    """``tile``, ``ident`` of every tile of ``known`` that a box touches. Every task holds the known tiles and looks up those of
    its boxes' rows, so no pair is formed that does not touch; for more than ``HELD`` tiles, joins."""
    index = known_tiles(known, zoom)
    if index is None:
        return boxes_in_many_tiles(rows, ident, box, known, zoom)
    held = rows.sparkSession.sparkContext.broadcast(index.tile)
    at = rows.where(F.col(box).isNotNull()).select(ident, *spans(F.col(box), zoom)).dropna(subset=["x0", "x1", "y0", "y1"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = KnownTiles(held.value, zoom)
        for batch in batches:
            for i, t in index.touched(*(batch.column(k).to_numpy() for k in ("x0", "x1", "y0", "y1"))):
                yield pa.RecordBatch.from_arrays([pa.array(index.tile[t]), batch.column(0).take(pa.array(i))], names=["tile", ident])

    return at.mapInArrow(look, f"tile bigint, {ident} {dict(rows.dtypes)[ident]}")


def outer_boxes(rows: DataFrame, box: str, known: DataFrame, zoom: int = tiles.ZOOM) -> DataFrame:
    """``tile`` and the box of all boxes that touch it, of every tile of ``known`` that one touches. A task keeps one box for
    every tile, so a row per task and tile is shuffled, however many boxes there are."""
    index, sides = known_tiles(known, zoom), ("left", "top", "right", "bottom")
    if index is None:
        b = rows.select(F.monotonically_increasing_id().alias("_i"), F.col(box).alias("box"))
        b = Workspace(rows.sparkSession, "outer").cut(b, "boxes")
        found = boxes_in_many_tiles(b, "_i", "box", known, zoom).join(b, "_i").select("tile", "box.*")
    else:
        held = rows.sparkSession.sparkContext.broadcast(index.tile)
        at = rows.where(F.col(box).isNotNull()).select(*[F.col(box)[k].alias(k) for k in sides], *spans(F.col(box), zoom)).dropna()

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = KnownTiles(held.value, zoom)
            n = len(index.tile)
            # Of left and bottom the least, of right and top the greatest: all as least.
            least, met, sign = np.full((4, n), np.inf), np.zeros(n, bool), (1, -1, -1, 1)
            for batch in batches:
                own = [s * batch.column(k).to_numpy() for s, k in zip(sign, sides, strict=True)]
                for i, t in index.touched(*(batch.column(k).to_numpy() for k in ("x0", "x1", "y0", "y1"))):
                    order = np.argsort(t, kind="stable")
                    i, t = i[order], t[order]
                    first = np.flatnonzero(np.diff(t, prepend=-1))
                    t = t[first]
                    met[t] = True
                    for k in range(4):
                        least[k, t] = np.minimum(least[k, t], np.minimum.reduceat(own[k][i], first))
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(index.tile[met]), *[pa.array(s * v[met]) for s, v in zip(sign, least, strict=True)]], names=["tile", *sides])

        found = at.mapInArrow(look, "tile bigint, left double, top double, right double, bottom double")
    return found.groupBy("tile").agg(F.min("left").alias("left"), F.max("top").alias("top"), F.max("right").alias("right"), F.min("bottom").alias("bottom"))


def boxes_in_many_tiles(rows: DataFrame, ident: str, box: str, known: DataFrame, zoom: int = tiles.ZOOM) -> DataFrame:
    """``boxes_in_tiles`` by joins, for any number of tiles. A box is filed under the at most four tiles it touches at
    the zoom where it is no larger than one; a tile is filed under its parents of all zooms. So neither the size of a box
    nor the number of tiles it covers makes more than a few rows."""
    b = F.col(box)
    spans = rows.where(b.isNotNull()).select(F.col(ident), tiles.tile_x(b["left"], zoom).alias("x0"), tiles.tile_x(b["right"], zoom).alias("x1"), tiles.tile_y(b["top"], zoom).alias("y0"), tiles.tile_y(b["bottom"], zoom).alias("y1"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    spans = spans.withColumn("up", F.least(F.lit(zoom), F.ceil(F.log2(wide.cast("double"))).cast("int")))
    up = F.col("up")

    def shifted(c: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), up))

    at = F.flatten(F.transform(F.sequence(shifted(F.col("x0")), shifted(F.col("x1"))), lambda x: F.transform(F.sequence(shifted(F.col("y0")), shifted(F.col("y1"))), lambda y: F.struct(x.alias("px"), y.alias("py")))))
    filed = spans.withColumn("p", F.explode(at)).select(ident, "x0", "x1", "y0", "y1", "up", "p.px", "p.py")
    t = known.select("tile", tiles.x_of(F.col("tile"), zoom).alias("x"), tiles.y_of(F.col("tile"), zoom).alias("y"))
    t = t.select("tile", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("up"))
    t = t.select("tile", "x", "y", "up", F.floor(F.col("x") / F.pow(F.lit(2.0), up)).alias("px"), F.floor(F.col("y") / F.pow(F.lit(2.0), up)).alias("py"))
    hit = filed.join(t, ["up", "px", "py"]).where("x between x0 and x1 and y between y0 and y1")
    return hit.select("tile", ident)
