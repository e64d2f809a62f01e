"""Planar and spherical scalars as columns. Points are structs (lon, lat); boxes are structs (left, top, right, bottom)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
#: Tolerance of box overlap, in degrees.
BOX_EPS = 1e-8


def azimuth(a: Column, b: Column) -> Column:
    """Direction from a to b, counter-clockwise from east, in radians."""
    return F.atan2(b["lat"] - a["lat"], b["lon"] - a["lon"])


def turn_angle(a: Column, b: Column, c: Column) -> Column:
    """Counter-clockwise angle from the ray b-a to the ray b-c in (0, 2 pi]; rays that coincide give 2 pi, a ray without
    length null."""
    d = azimuth(b, c) - azimuth(b, a)
    d = F.when(d < 1e-9, d + 2 * math.pi).otherwise(d)
    d = F.when(d < 1e-9, F.lit(2 * math.pi)).otherwise(d)
    same = lambda p, q: (p["lon"] == q["lon"]) & (p["lat"] == q["lat"])
    return F.when(~same(a, b) & ~same(b, c), d)


def metres(a: Column, b: Column) -> Column:
    """Distance by the equirectangular estimate."""
    x = (F.radians(b["lon"]) - F.radians(a["lon"])) * F.cos((F.radians(a["lat"]) + F.radians(b["lat"])) / 2.0)
    y = F.radians(b["lat"]) - F.radians(a["lat"])
    return F.sqrt(x * x + y * y) * RADIUS_M


def offset_x(p: Column, m: float) -> Column:
    """The point ``m`` metres further east, by the length of a thousandth of a degree there."""
    step = F.struct((p["lon"] + 0.001).alias("lon"), p["lat"].alias("lat"))
    return F.struct((p["lon"] + F.lit(m) / metres(step, p) * 0.001).alias("lon"), p["lat"].alias("lat"))


def to_box(points: Column) -> Column:
    """Bounding box of an array of points; null for an empty or null array."""
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    b = F.struct(side(F.array_min, "lon").alias("left"), side(F.array_max, "lat").alias("top"), side(F.array_max, "lon").alias("right"), side(F.array_min, "lat").alias("bottom"))
    return F.when(F.size(points) > 0, b)


def expand(a: Column, b: Column) -> Column:
    """The smallest box that holds both."""
    pick = lambda f, k: f(a[k], b[k]).alias(k)
    return F.struct(pick(F.least, "left"), pick(F.greatest, "top"), pick(F.greatest, "right"), pick(F.least, "bottom"))


def surface(b: Column) -> Column:
    return (b["top"] - b["bottom"]) * (b["right"] - b["left"])


def holds(b: Column, lon: Column, lat: Column) -> Column:
    """Whether a box holds a location; its left and bottom sides are outside."""
    return (b["bottom"] < lat) & (lat <= b["top"]) & (b["left"] < lon) & (lon <= b["right"])


def covers(a: Column, b: Column) -> Column:
    """Whether box a holds both corners of box b. As ``holds`` is half-open, no box covers itself."""
    return holds(a, b["left"], b["top"]) & holds(a, b["right"], b["bottom"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes meet, within ``BOX_EPS``."""
    return (a["left"] - b["right"] <= BOX_EPS) & (b["bottom"] - a["top"] <= BOX_EPS) & (b["left"] - a["right"] <= BOX_EPS) & (a["bottom"] - b["top"] <= BOX_EPS)


def signed_area(ring: Column) -> Column:
    """Area of a closed ring in square degrees, positive when it runs clockwise (y upwards): half the sum of
    (x2 - x1)(y2 + y1), taken from the first point, in order."""
    x0, y0 = F.get(ring, F.lit(0))["lon"], F.get(ring, F.lit(0))["lat"]
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: ((q["lon"] - x0) - (p["lon"] - x0)) * ((q["lat"] - y0) + (p["lat"] - y0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2.0


def scaled(c: Column) -> Column:
    """Degrees as whole ten-millionths."""
    return F.round(c * 1e7).cast("bigint")


def points_text(points: Column) -> Column:
    """Points as ``lon lat`` in whole ten-millionths of a degree, parted by semicolons."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", scaled(p["lon"]).cast("string"), scaled(p["lat"]).cast("string"))), ";")
