"""Name-based GUIDs (RFC 4122, version 5) of quantised locations, as columns; hexadecimal text throughout."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from planarloom.functions.tiles import RESOLUTION, ZOOM

# The name spaces of vertex, edge and face identifiers.
VERTEX_NS = "cff2a084-3138-486b-84e4-6f8099cb4c70"
EDGE_NS = "62b34a03-f1fd-4d04-965f-4e8355a8ac24"
FACE_NS = "2115f6f1-20c3-46e0-9f82-863ba536dee9"


def le32(n: Column) -> Column:
    """Four bytes of a whole number, lowest first, as hexadecimal text."""
    h = F.lpad(F.lower(F.hex(F.pmod(n.cast("bigint"), F.lit(1 << 32).cast("bigint")))), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def cell_hex(cell: Column) -> Column:
    """Tile, x and y of a quantised location, four bytes each."""
    return F.concat(le32(cell["tile"]), le32(cell["x"]), le32(cell["y"]))


def guid5(namespace: str, name_hex: Column) -> Column:
    """Version-5 GUID of a name given in hexadecimal; null for a null name."""
    h = F.sha1(F.unhex(F.concat(F.lit(namespace.replace("-", "")), name_hex)))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def vertex_guid(cell: Column) -> Column:
    return guid5(VERTEX_NS, cell_hex(cell))


def edge_guid(cells: Column) -> Column:
    """Of the quantised points of an edge in forward direction."""
    return guid5(EDGE_NS, F.array_join(F.transform(cells, cell_hex), ""))


def face_guid(cells: Column, corners: Column) -> Column:
    """Of a closed ring of quantised points: from its left-most, of these top-most, corner on, direction kept, closing
    point left out; null for an empty ring. ``corners`` are the cells' top-left corners (lon, lat), in the same order."""
    open_n = F.size(cells) - 1
    keys = F.transform(F.slice(corners, 1, F.greatest(open_n, F.lit(0))), lambda p: F.struct(p["lon"].alias("lon"), (-p["lat"]).alias("south")))
    start = F.array_position(keys, F.array_min(keys)).cast("int")
    body = F.slice(cells, 1, F.greatest(open_n, F.lit(0)))
    turned = F.concat(F.slice(body, start, open_n), F.slice(body, F.lit(1), start - 1))
    return F.when(F.size(cells) > 1, guid5(FACE_NS, F.array_join(F.transform(turned, cell_hex), "")))


def cells_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tile``, ``x``, ``y`` of places (n, 2), and their cells' corners, as ``tiles.quantize`` and ``tiles.dequantize`` have them;
    places without a cell have the corner minus infinity."""
    n, lon, lat = float(2**ZOOM), points[:, 0], points[:, 1]
    with np.errstate(all="ignore"):
        rad = lat / 180.0 * math.pi
        x = np.floor((lon + 180.0) / 360.0 * n)
        y = np.floor((1.0 - np.log(np.tan(rad) + 1.0 / np.cos(rad)) / math.pi) / 2.0 * n)
        left, right = x / n * 360.0 - 180.0, (x + 1) / n * 360.0 - 180.0
        top, bottom = (np.arctan(np.sinh(math.pi - (2.0 * math.pi * k) / n)) * (180.0 / math.pi) for k in (y, y + 1))
        cx = np.trunc((lon - left) / ((right - left) / RESOLUTION))
        cy = np.trunc((top - lat) / ((top - bottom) / RESOLUTION))
        corner = np.stack([left + (right - left) / RESOLUTION * cx, top - cy * ((top - bottom) / RESOLUTION)], 1)
        cells = np.stack([y * n + x, cx, cy], 1)
    known = np.isfinite(cells).all(1)
    corner[~known] = -np.inf
    return np.where(known[:, None], cells, np.nan), corner


def cell_keys(points: np.ndarray) -> np.ndarray:
    """Places' cells as one number each of tile, x and y; -1 where there is none."""
    tile, x, y = np.nan_to_num(cells_of(points)[0], nan=-1).astype(np.int64).T
    return np.where(tile < 0, -1, (tile << 28) + (x << 14) + y)


def guid5_text(space: bytes, name: bytes) -> str:
    """``guid5`` of one name."""
    h = hashlib.sha1(space + name).hexdigest()
    return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"


def vertex_guids(cells: np.ndarray) -> list[str]:
    """``vertex_guid`` of known cells (n, 3), as ``cells_of`` has them."""
    raw, space = cells.astype(np.int64).astype("<u4").tobytes(), bytes.fromhex(VERTEX_NS.replace("-", ""))
    return [guid5_text(space, raw[at : at + 12]) for at in range(0, len(raw), 12)]


def edge_guids(cells: np.ndarray, starts: np.ndarray) -> list[str]:
    """``edge_guid`` of lines: their cells one behind the other, and where each begins. Places without a cell are passed over."""
    known = ~np.isnan(cells[:, 0])
    at = np.concatenate([[0], np.cumsum(known)])[starts].tolist()
    raw, space = cells[known].astype(np.int64).astype("<u4").tobytes(), bytes.fromhex(EDGE_NS.replace("-", ""))
    return [guid5_text(space, raw[12 * a : 12 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def face_guids(points: np.ndarray, starts: np.ndarray) -> list[str | None]:
    """``face_guid`` of closed rings: their points one behind the other, and where each begins."""
    own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    last = np.zeros(len(points), bool)
    last[starts[1:][np.diff(starts) > 0] - 1] = True
    cells, corner = cells_of(points)
    known = ~np.isnan(cells[:, 0])
    raw = np.where(known[:, None], cells, 0).astype(np.int64).astype("<u4").tobytes()
    order = np.lexsort((np.arange(len(points)), -corner[:, 1], corner[:, 0], last, own))
    space, out = bytes.fromhex(FACE_NS.replace("-", "")), []
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True)):
        if b <= a:
            out.append(None)
            continue
        m = int(order[starts[k]])
        name = raw[12 * m : 12 * b] + raw[12 * a : 12 * m]
        if not known[a:b].all():
            name = b"".join(raw[12 * q : 12 * q + 12] for q in (*range(m, b), *range(a, m)) if known[q])
        out.append(guid5_text(space, name))
    return out
