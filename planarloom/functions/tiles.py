"""Web-Mercator tile maths as columns. A local tile id is ``y * 2^zoom + x``; boxes are (left, top, right, bottom)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZOOM = 14
#: Cells per side of a tile in quantised coordinates.
RESOLUTION = 16384
#: Beyond this latitude there is no tile.
MAX_LAT = 85.0511


def tile_x(lon: Column, zoom: int = ZOOM) -> Column:
    """Column of the tile that holds a longitude."""
    return F.floor((lon + 180.0) / 360.0 * float(2**zoom))


def tile_y(lat: Column, zoom: int = ZOOM) -> Column:
    """Row of the tile that holds a latitude, counted from the north."""
    rad = lat / 180.0 * math.pi
    return F.floor((F.lit(1.0) - F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / math.pi) / 2.0 * float(2**zoom))


def local_id(x: Column, y: Column, zoom: int = ZOOM) -> Column:
    return y * F.lit(2**zoom).cast("bigint") + x


def tile_of(lon: Column, lat: Column, zoom: int = ZOOM) -> Column:
    """Local id of the tile that holds a location."""
    return local_id(tile_x(lon, zoom), tile_y(lat, zoom), zoom)


def x_of(tile: Column, zoom: int = ZOOM) -> Column:
    return F.pmod(tile, F.lit(2**zoom).cast("bigint"))


def y_of(tile: Column, zoom: int = ZOOM) -> Column:
    return F.shiftright(tile, zoom)


def left_of(x: Column, zoom: int = ZOOM) -> Column:
    return x / float(2**zoom) * 360.0 - 180.0


def top_of(y: Column, zoom: int = ZOOM) -> Column:
    return F.atan(F.sinh(F.lit(math.pi) - (F.lit(2.0 * math.pi) * y) / float(2**zoom))) * (180.0 / math.pi)


def box(tile: Column, zoom: int = ZOOM) -> Column:
    """The box of a tile."""
    x, y = x_of(tile, zoom), y_of(tile, zoom)
    return F.struct(left_of(x, zoom).alias("left"), top_of(y, zoom).alias("top"), left_of(x + 1, zoom).alias("right"), top_of(y + 1, zoom).alias("bottom"))


def quantize(lon: Column, lat: Column, zoom: int = ZOOM, resolution: int = RESOLUTION) -> Column:
    """``x``, ``y``, ``tile`` of a location: its cell in its tile, cut towards zero."""
    tile = tile_of(lon, lat, zoom)
    b = box(tile, zoom)
    x = ((lon - b["left"]) / ((b["right"] - b["left"]) / resolution)).cast("int")
    y = ((b["top"] - lat) / ((b["top"] - b["bottom"]) / resolution)).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), tile.alias("tile"))


def dequantize(cell: Column, zoom: int = ZOOM, resolution: int = RESOLUTION) -> Column:
    """``lon``, ``lat`` of the top-left corner of a quantised location's cell."""
    b = box(cell["tile"], zoom)
    lon = b["left"] + (b["right"] - b["left"]) / resolution * cell["x"]
    lat = b["top"] - cell["y"] * ((b["top"] - b["bottom"]) / resolution)
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def tiles_for(left: Column, top: Column, right: Column, bottom: Column, zoom: int = ZOOM) -> Column:
    """Array of (x, y) of all tiles a box touches, column by column; null when a side is null."""
    xs = F.sequence(tile_x(left, zoom), tile_x(right, zoom))
    ys = F.sequence(tile_y(top, zoom), tile_y(bottom, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def sub_tiles(x: Column, y: Column, levels: int) -> Column:
    """Array of (x, y) of the 4^levels tiles that make up a tile, ``levels`` zooms further in."""
    n = 2**levels
    span = lambda v: F.sequence(v * n, v * n + (n - 1))
    return F.flatten(F.transform(span(x), lambda a: F.transform(span(y), lambda b: F.struct(a.alias("x"), b.alias("y")))))


def first_id(zoom: int) -> int:
    """Global id of tile (0, 0): the number of tiles of all coarser zooms."""
    return (4**zoom - 1) // 3


def global_id(x: Column, y: Column, zoom: int = ZOOM) -> Column:
    """Id that is unique over all zooms."""
    return F.lit(first_id(zoom)).cast("bigint") + local_id(x, y, zoom)


def zoom_of(gid: Column, most: int = 30) -> Column:
    """Zoom of a global id."""
    return sum((gid >= F.lit(first_id(z)).cast("bigint")).cast("int") for z in range(1, most + 1))


def around(lon: Column, lat: Column, zoom: int = ZOOM) -> Column:
    """Global id of the tile around a location: null beyond ``MAX_LAT``; longitude 180 lies in the last column."""
    lon = F.when(lon == 180.0, lon - 0.000001).otherwise(lon)
    return F.when(F.abs(lat) <= MAX_LAT, global_id(tile_x(lon, zoom), tile_y(lat, zoom), zoom))


def rounded_box(tile: Column, zoom: int = ZOOM) -> Column:
    """The box in single precision, and its centre, as tiles of the global kind have them."""
    b = box(tile, zoom)
    f = {k: b[k].cast("float") for k in ("left", "top", "right", "bottom")}
    mid = lambda p, q: ((f[p].cast("double") + f[q].cast("double")) / 2.0).cast("float")
    return F.struct(*[c.alias(k) for k, c in f.items()], mid("left", "right").alias("mid_lon"), mid("top", "bottom").alias("mid_lat"))
