"""Sinks: GeoJSON features, vector tiles and tile descriptions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geometry(kind: str, points: Column) -> Column:
    """GeoJSON geometry of an array of points: LineString, or Polygon with one shell, or Point of its first."""
    pairs = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    body = {"Point": F.to_json(F.get(pairs, F.lit(0))), "LineString": F.to_json(pairs), "Polygon": F.to_json(F.array(pairs))}[kind]
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), body, F.lit("}"))


def feature(kind: str, points: Column, properties: Column) -> Column:
    """GeoJSON feature as text; ``properties`` is a struct or a map."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry(kind, points), F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def read_features(lines: DataFrame, column: str = "feature") -> DataFrame:
    """``kind``, ``points`` (text), ``properties`` (map) of GeoJSON features with a line or a polygon shell, one per row."""
    f = F.from_json(column, "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>")
    kind = f["geometry"]["type"]
    flat = F.when(kind == "Polygon", F.get(F.from_json(f["geometry"]["coordinates"], "array<array<array<double>>>"), F.lit(0))).otherwise(F.from_json(f["geometry"]["coordinates"], "array<array<double>>"))
    pts = F.transform(flat, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return lines.select(kind.alias("kind"), pts.alias("points"), f["properties"].alias("properties"))


# Vector tiles: protocol buffers by hand, as the layout is small. --------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        return _varint(number << 3) + _varint(body)
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def polygon_commands(ring: list[tuple[int, int]]) -> list[int]:
    """Drawing commands of a closed ring in tile units: move, lines, close."""
    pts = ring[:-1]
    out, x, y = [], 0, 0
    for i, (px, py) in enumerate(pts):
        if i == 0:
            out.append(1 << 3 | 1)
        if i == 1:
            out.append((len(pts) - 1) << 3 | 2)
        out += [_zigzag(px - x), _zigzag(py - y)]
        x, y = px, py
    return [*out, 1 << 3 | 7]


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers from 0 to below 2^35, one behind the other, and where each begins."""
    n = 1 + sum((values >= 1 << 7 * k).astype(int) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        some = np.flatnonzero(n > k)
        out[at[some] + k] = values[some] >> 7 * k & 0x7F | np.where(n[some] > k + 1, 0x80, 0)
    return out, at


def outlines(points: np.ndarray, starts: np.ndarray, i: np.ndarray, box: np.ndarray, extent: int = 4096) -> pa.Array:
    """``polygon_commands`` as bytes, of the closed rings number ``i`` in the units of the tiles with the boxes (left, top, right,
    bottom). Rings (points one behind the other, and where each begins) have more than two points; halves are rounded away from 0."""
    n = np.diff(starts)[i] - 1
    own = np.repeat(np.arange(len(i)), n)
    k = np.arange(len(own)) - (np.cumsum(n) - n)[own]
    p, (left, top, right, bottom) = points[starts[i][own] + k], box.T
    size = 2 * n + 3
    base = np.cumsum(size) - size
    values = np.zeros(int(size.sum()), np.int64)
    values[base], values[base + 3], values[base + size - 1] = 1 << 3 | 1, (n - 1) << 3 | 2, 1 << 3 | 7
    across = ((p[:, 0] - left[own]) / (right - left)[own], (top[own] - p[:, 1]) / (top - bottom)[own])
    for axis, v in enumerate(across):
        v = v * extent
        whole = np.floor(np.abs(v))
        unit = (np.sign(v) * (whole + (np.abs(v) - whole >= 0.5))).astype(np.int64)
        step = np.diff(unit, prepend=0)
        step[k == 0] = unit[k == 0]
        values[base[own] + 1 + axis + 2 * k + (k > 0)] = step << 1 ^ step >> 63
    raw, at = varints(values)
    ends = at[np.append(base, len(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])


def vector_layer(name: str, rows: list[tuple[list[tuple[int, int]], dict]], extent: int = 4096) -> bytes:
    """A tile with one layer of polygons and their properties (text or numbers; null ones left out)."""
    return encoded_layer(name, [(b"".join(map(_varint, polygon_commands(ring))), props) for ring, props in rows], extent)


def encoded_layer(name: str, rows: list[tuple[bytes, dict]], extent: int = 4096) -> bytes:
    """``vector_layer`` of polygons given by the bytes of their drawing commands."""
    keys: dict[str, int] = {}
    values: dict[object, int] = {}
    body = []
    for commands, props in rows:
        tags = []
        for k, v in props.items():
            if v is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
        body.append(_field(2, _field(2, b"".join(map(_varint, tags))) + _field(3, 3) + _field(4, commands)))
    named = b"".join(_field(3, k.encode()) for k in keys)
    typed = b"".join(_field(4, _field(1, v.encode()) if isinstance(v, str) else _varint(3 << 3 | 1) + struct.pack("<d", float(v))) for v in values)
    return _field(3, b"".join((_field(15, 2), _field(1, name.encode()), *body, named, typed, _field(5, extent))))


def tile_json(layer: str, min_zoom: int, max_zoom: int, url: str, description: str) -> dict:
    """Description of a tile set."""
    one = {"id": layer, "description": description, "minzoom": min_zoom, "maxzoom": max_zoom}
    return {"id": layer, "basename": layer, "minzoom": min_zoom, "maxzoom": max_zoom, "tiles": [url], "vector_layers": [one]}
