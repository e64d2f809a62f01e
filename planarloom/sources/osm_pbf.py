"""Scan of OSM PBF files as node and way tables, block by block.

A PBF file is a row of independent blocks. One pass over the block headers, which skips the bodies, gives every block's place;
the blocks are then read and decoded in parallel, wherever they lie. The messages are protocol buffers; only the fields
needed here are decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

ELEMENT = "kind string, id bigint, lon double, lat double, refs array<bigint>, tags array<struct<k: string, v: string>>"


def varint(b: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, and the place behind it."""
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 0x7F) << shift
        if c < 0x80:
            return n, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a message."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = b[at : at + n], at + n
        else:
            raise ValueError(f"field type {kind}")
        yield key >> 3, value


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        n, at = varint(b, at)
        out.append(n)
    return out


def signed(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def running(values: list[int]) -> list[int]:
    """Sums of signed differences."""
    out, total = [], 0
    for v in values:
        total += signed(v)
        out.append(total)
    return out


def blob_body(b: bytes) -> bytes:
    f = dict(fields(b))
    return zlib.decompress(f[3]) if 3 in f else f.get(1, b"")


def decode_block(body: bytes) -> list[tuple]:
    """Nodes and ways of a primitive block, as rows of ``ELEMENT``."""
    strings: list[str] = []
    groups: list[bytes] = []
    scale, lat0, lon0 = 100, 0, 0
    for n, v in fields(body):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            scale = v
        elif n == 19:
            lat0 = v - (v >> 63 << 64)
        elif n == 20:
            lon0 = v - (v >> 63 << 64)
    degrees = lambda v, zero: (zero + scale * v) * 1e-9
    tags = lambda ks, vs: [{"k": strings[k], "v": strings[v]} for k, v in zip(ks, vs, strict=True)]
    rows: list[tuple] = []
    for group in groups:
        for n, v in fields(group):
            if n == 1:
                f = dict(fields(v))
                rows.append(("n", signed(f[1]), degrees(signed(f[9]), lon0), degrees(signed(f[8]), lat0), None, tags(packed(f.get(2, b"")), packed(f.get(3, b"")))))
            elif n == 2:
                f = dict(fields(v))
                kv, j = packed(f.get(10, b"")), 0
                for ident, lat, lon in zip(running(packed(f.get(1, b""))), running(packed(f.get(8, b""))), running(packed(f.get(9, b""))), strict=True):
                    own = []
                    while j < len(kv) and kv[j]:  # each node's pairs end with a 0
                        own.append({"k": strings[kv[j]], "v": strings[kv[j + 1]]})
                        j += 2
                    j += 1
                    rows.append(("n", ident, degrees(lon, lon0), degrees(lat, lat0), None, own))
            elif n == 3:
                f = dict(fields(v))
                rows.append(("w", f[1] - (f[1] >> 63 << 64), None, None, running(packed(f.get(8, b""))), tags(packed(f.get(2, b"")), packed(f.get(3, b"")))))
    return rows


def block_places(path: str) -> Iterator[tuple[str, int, int]]:
    """Path, place and length of every data block of a file; a file broken off gives those before the break."""
    fs, name = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    with (fs.open_input_file(name) if fs else open(name, "rb")) as f:
        at = 0
        while len(head := f.read(4)) == 4:
            n = int.from_bytes(head, "big")
            h = dict(fields(f.read(n)))
            at += 4 + n
            if h.get(1) == b"OSMData":
                yield path, at, h[3]
            at += h[3]
            f.seek(at)


def elements(spark: SparkSession, paths: list[str], tasks: int = 200) -> DataFrame:
    """``ELEMENT`` of every node ('n') and way ('w') in the files; relations are passed over. Paths are seen by all executors."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                yield pd.DataFrame(list(block_places(p)), columns=["path", "place", "size"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("kind s", "id b", "lon d", "lat d", "refs a", "tags a")]
        for pdf in batches:
            for p, own in pdf.groupby("path"):
                fs, name = FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (None, p)
                with (fs.open_input_file(name) if fs else open(name, "rb")) as f:
                    for place, size in zip(own["place"], own["size"], strict=True):
                        f.seek(int(place))
                        yield pd.DataFrame(decode_block(blob_body(f.read(int(size)))), columns=names)

    blocks = files.mapInPandas(places, "path string, place bigint, size bigint").repartition(tasks)
    return blocks.mapInPandas(read, ELEMENT)
