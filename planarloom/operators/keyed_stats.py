"""Per-key results when a few keys hold most of the rows.

Every result here is an algebraic aggregate: Spark's partial hash aggregate keeps one state per key and task (spilling
when it outgrows memory), so what is shuffled is at most keys x tasks states, however the rows are spread over the keys.
Distinct counts first reduce to (key, id), whose hash spreads a hot key's ids over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_per_key(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """``key``, ``n``: how many distinct non-null ``ident`` each non-null ``key`` has. Empty input gives no rows."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(key, ident).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(rows: DataFrame, key: str, ident: str, share: float) -> DataFrame:
    """``key``, ``n`` of each non-null key that holds more than ``share`` of all distinct ``ident``.

    An ``ident`` counts once for the total, with or without a key; repeated rows change nothing; an ``ident`` under two
    keys counts for both. Null ``ident`` rows are left out. Empty input gives no rows.
    """
    total = rows.agg(F.count_distinct(ident).alias("n"))
    return distinct_per_key(rows, key, ident).where(F.col("n") > F.lit(share) * total.scalar())


def tile_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per non-null tile: rows, distinct vertices, located vertices, bounding box, sum and maximum of degrees.

    A vertex's degree is the number of distinct edges with it at an end (a loop counts once). Repeated vertex rows count
    once except in ``n_rows``; of several locations of one vertex in a tile the greatest (lon, lat) counts. Vertices
    without a whole location count but add nothing to the box (null when none is located).
    Edges whose end is no vertex add nothing. Degrees reduce per vertex before they reach the vertices, so a star's
    centre arrives as one row.
    """
    ends = edges.select("e", F.explode(F.array_distinct(F.array("v1", "v2"))).alias("v")).where(F.col("v").isNotNull() & F.col("e").isNotNull())
    degree = ends.distinct().groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    own = (
        vertices.where(F.col("tile").isNotNull() & F.col("v").isNotNull())
        .groupBy("tile", "v")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.when(located, F.struct("lon", "lat"))).alias("at"))
    )
    return (
        own.join(degree, "v", "left")
        .groupBy("tile")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_vertices"),
            F.count("at").alias("n_located"),
            F.min("at.lon").alias("box_left"),
            F.max("at.lat").alias("box_top"),
            F.max("at.lon").alias("box_right"),
            F.min("at.lat").alias("box_bottom"),
            F.sum(F.coalesce("degree", F.lit(0))).alias("degree_sum"),
            F.max(F.coalesce("degree", F.lit(0))).alias("degree_max"),
        )
    )
