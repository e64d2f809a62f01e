"""Joins of boxes and points by grid cells: equi-joins on the cells a box touches, then the exact test.

A cell that holds very many rows is salted: the rows of one side are dealt out over several tasks and the other side's
rows copied to each. Long boxes stand in many cells; cut lines into segments first (``segments``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarloom.functions import geo

#: Rows of a cell that one task tests against the cell's other rows.
CELL_ROWS = 5_000


def segments(lines: DataFrame, pts: str, *keep: str) -> DataFrame:
    """``keep``, ``seg``, ``a``, ``b``: the straight pieces of each line of points, numbered from 0. Lines of fewer than two
    points, and null ones, give none."""
    p = F.col(pts)
    pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return lines.where(F.size(pts) > 1).select(*keep, F.posexplode(pairs).alias("seg", "_s")).select(*keep, "seg", "_s.a", "_s.b")


def cells_of(box: Column, size: float, margin: float = geo.BOX_EPS) -> Column:
    """Array of (cx, cy) of all cells a box touches, a little widened."""
    at = lambda v: F.floor(v / size)
    xs = F.sequence(at(box["left"] - margin), at(box["right"] + margin))
    ys = F.sequence(at(box["bottom"] - margin), at(box["top"] + margin))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def salted(left: DataFrame, right: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: a cell of n rows on the left is dealt out over n/``CELL_ROWS`` tasks. The table of crowded
    cells is joined by the optimizer's choice, by size."""
    n = left.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_n")).where("_n > 1")
    parts = F.coalesce("_n", F.lit(1))
    one = left.join(n, ["cx", "cy"], "left").withColumn("salt", F.pmod(F.xxhash64(ident), parts).cast("int")).drop("_n")
    two = right.join(n, ["cx", "cy"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    return one, two


def overlapping_pairs(rows: DataFrame, ident: str, box: str, size: float) -> DataFrame:
    """``id_a`` < ``id_b``, ``box_a``, ``box_b`` of all pairs of rows whose boxes meet. A pair is reported from the first cell
    both stand in only, so it comes once per pair of rows. Null boxes meet nothing."""
    placed = rows.where(F.col(box).isNotNull()).select(F.col(ident).alias("id"), F.col(box).alias("box")).select("id", "box", F.explode(cells_of(F.col("box"), size)).alias("c")).select("id", "box", "c.cx", "c.cy")
    one, two = salted(placed, placed, "id")
    one, two = (x.withColumnsRenamed({"id": f"id_{s}", "box": f"box_{s}"}) for x, s in ((one, "a"), (two, "b")))
    pairs = one.join(two, ["cx", "cy", "salt"]).where(F.col("id_a") < F.col("id_b")).where(geo.overlaps(F.col("box_a"), F.col("box_b")))
    low = lambda k: F.floor((F.greatest(f"box_a.{k}", f"box_b.{k}") - geo.BOX_EPS) / size)
    return pairs.where((F.col("cx") == low("left")) & (F.col("cy") == low("bottom"))).select("id_a", "id_b", "box_a", "box_b")


def points_in_boxes(points: DataFrame, ident: str, rows: DataFrame, box_id: str, box: str, size: float) -> DataFrame:
    """``box_id``, ``ident`` of every point (lon, lat) in a box; left and bottom sides are outside."""
    at = points.where("lon is not null and lat is not null").select(F.col(ident), "lon", "lat", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
    placed = rows.where(F.col(box).isNotNull()).select(F.col(box_id), F.col(box).alias("_box"), F.explode(cells_of(F.col(box), size)).alias("_c")).select(box_id, "_box", "_c.cx", "_c.cy")
    one, two = salted(at, placed, ident)
    return one.join(two, ["cx", "cy", "salt"]).where(geo.holds(F.col("_box"), F.col("lon"), F.col("lat"))).select(box_id, ident)


#: Coarsest level: a cell of 2^16 times the size.
LEVELS = 16


def filed(rows: DataFrame, ident: str, box: str, size: float, own: bool) -> DataFrame:
    """``id``, ``box``, ``cx``, ``cy`` of the at most four cells a box touches at the level where it is no larger than one
    (``own``), or at every coarser level. Cells of level l are 2^l times ``size`` wide; ``cx`` holds the level as well."""
    b = F.col(box)
    wide = F.greatest(b["right"] - b["left"], b["top"] - b["bottom"]) + 2 * geo.BOX_EPS
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(wide / size)).cast("int")))
    placed = rows.where(b.isNotNull()).select(F.col(ident).alias("id"), b.alias("box"), level.alias("_own"))
    up = placed.withColumn("_l", F.col("_own")) if own else placed.where(F.col("_own") < LEVELS).withColumn("_l", F.explode(F.sequence(F.col("_own") + 1, F.lit(LEVELS))))
    step = F.pow(F.lit(2.0), F.col("_l")) * size
    at = lambda v: F.floor(v / step)
    xs = F.sequence(at(F.col("box.left") - geo.BOX_EPS), at(F.col("box.right") + geo.BOX_EPS))
    ys = F.sequence(at(F.col("box.bottom") - geo.BOX_EPS), at(F.col("box.top") + geo.BOX_EPS))
    cells = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct((x * (LEVELS + 1) + F.col("_l")).alias("cx"), y.alias("cy")))))
    return up.withColumn("_c", F.explode(cells)).select("id", "box", "_c.cx", "_c.cy")


def meeting(a: DataFrame, b: DataFrame, ident: str, box: str, size: float) -> DataFrame:
    """``id_a``, ``id_b`` of all pairs of a row of ``a`` and one of ``b`` whose boxes meet, each once. Boxes of every size make a
    bounded number of rows: the larger of a pair is met at its own level, the smaller stands in that level's cells too."""
    found = None
    for left_own, right_own in ((True, True), (True, False), (False, True)):
        left, right = salted(filed(a, ident, box, size, left_own), filed(b, ident, box, size, right_own), "id")
        left, right = (x.withColumnsRenamed({"id": f"id_{k}", "box": f"box_{k}"}) for x, k in ((left, "a"), (right, "b")))
        pairs = left.join(right, ["cx", "cy", "salt"]).where(geo.overlaps(F.col("box_a"), F.col("box_b"))).select("id_a", "id_b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()
