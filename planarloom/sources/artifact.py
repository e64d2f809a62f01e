"""The graph with its faces as an artefact: four parquet tables keyed by identifiers, and the compact binary file per tile for
exchange.

Parquet is the form to work with. Its files are partitioned by blocks of tiles and sorted by tile, so their number does not
grow with that of the tiles, and those of a few tiles are found by the blocks and by the files' statistics. A tile may stand
in several files, and reading takes identifiers once and checks that every reference is met. The binary form holds a tile in one file; numbers are little-endian, identifiers stand in the mixed
byte order of GUIDs, and each of its three sections (vertices, edges by first vertex, faces) ends with sixteen 0xFF.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.functions import identity, tiles
from planarloom.functions.trig import flat
from planarloom.runtime import Workspace, hadoop_path

TABLES = {"vertex": "guid", "edge": "guid", "face": "guid", "face_edge": None}
END = b"\xff" * 16
CELL = "struct<x: int, y: int, tile: bigint>"
#: Tiles are filed in SIDE x SIDE blocks (a power of two).
SIDE = 8


def _cells(cells: np.ndarray) -> pa.StructArray:
    none = np.isnan(cells[:, 0])
    tile, x, y = np.where(none[:, None], 0, cells).astype(np.int64).T
    return pa.StructArray.from_arrays([pa.array(v, t, mask=none) for v, t in ((x, pa.int32()), (y, pa.int32()), (tile, pa.int64()))], names=["x", "y", "tile"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers and quantised points of edges (e, tags, pts)."""
    for batch in batches:
        e, tags, pts = batch.columns
        points, starts = flat(pts)
        cells, _ = identity.cells_of(points)
        first, last = starts[:-1], starts[1:] - 1
        inner = np.ones(len(points), bool)
        inner[first] = inner[last] = False
        shape = pa.ListArray.from_arrays((starts - 2 * np.arange(len(starts))).astype("int32"), _cells(cells[inner]))
        ends = [pa.array(identity.vertex_guids(cells[at]), pa.string()) for at in (first, last)]
        guid = pa.array(identity.edge_guids(cells, starts), pa.string())
        yield pa.RecordBatch.from_arrays([e, guid, _cells(cells[first]), _cells(cells[last]), *ends, shape, tags], names=["e", "guid", "a", "b", "v1", "v2", "shape", "tags"])


def tables(edges: DataFrame, assigned: DataFrame, polygons: DataFrame, shares: DataFrame | None = None) -> dict[str, DataFrame]:
    """The artefact's tables, each with ``tile``: ``vertex`` (guid, x, y), ``edge`` (guid, v1, v2, shape, tags), ``face`` (guid,
    shares) and ``face_edge`` (face, edge, seq, forward). An edge is filed under its first vertex's tile, a face under the
    tile of its ring's first point."""
    kinds = dict(edges.dtypes)
    lines = edges.select("e", "tags", "pts").mapInArrow(_named, f"e {kinds['e']}, guid string, a {CELL}, b {CELL}, v1 string, v2 string, shape array<{CELL}>, tags {kinds['tags']}")
    e = Workspace(edges.sparkSession, "artifact-edges").cut(lines, "edges")
    vertex = e.select(F.explode(F.array(F.struct(F.col("v1").alias("guid"), "a"), F.struct(F.col("v2").alias("guid"), F.col("b").alias("a")))).alias("x")).select("x.guid", "x.a.tile", "x.a.x", "x.a.y").distinct()
    edge = e.select("guid", "v1", "v2", "shape", "tags", F.col("a.tile").alias("tile"))
    start = tiles.quantize(F.col("ring")[0]["lon"], F.col("ring")[0]["lat"])["tile"]
    p = polygons.where("face_guid is not null").select("face", F.col("face_guid").alias("guid"), start.alias("tile"))
    if shares is None:
        face = p.select("guid", F.array().cast("array<struct<type:string,share:double>>").alias("shares"), "tile", "face")
    else:
        own = shares.groupBy("face").agg(F.array_sort(F.collect_list(F.struct("type", "share"))).alias("shares"))  # one per type
        face = p.join(own, "face", "left").select("guid", F.coalesce("shares", F.array().cast("array<struct<type:string,share:double>>")).alias("shares"), "tile", "face")
    fe = assigned.join(p.select("face", F.col("guid").alias("face_guid"), "tile"), "face").join(e.select("e", F.col("guid").alias("edge")), "e")
    face_edge = fe.select(F.col("face_guid").alias("face"), "edge", F.col("h").alias("seq"), (F.col("h") % 2 == 0).alias("forward"), "tile")
    return {"vertex": vertex, "edge": edge, "face": face.drop("face"), "face_edge": face_edge}


def block(tile: Column) -> Column:
    """The block of a tile: tiles less than ``SIDE`` apart lie in different ones."""
    return (tile.bitwiseAND(F.lit(SIDE - 1)) + F.shiftright(tile, tiles.ZOOM).bitwiseAND(F.lit(SIDE - 1)) * SIDE).cast("int")


def write(parts: dict[str, DataFrame], path: str) -> None:
    """Write the tables below ``path``; a tile that is written again replaces itself only."""
    for name, df in parts.items():
        spark, at = df.sparkSession, f"{path}/{name}"
        rows = df.withColumn("block", block(F.col("tile")))
        fs, p = hadoop_path(spark, at)
        there = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        if any(x.startswith("tile=") for x in there):
            raise ValueError(f"{at} has a folder for every tile; write to another place")
        if any(x.startswith("block=") for x in there):
            # The other tiles of the blocks that are written stay as they are.
            work = Workspace(spark, "artifact-write")
            rows = work.cut(rows, "rows")
            old = spark.read.parquet(at)
            new = rows.select(F.col("tile").alias("_tile")).distinct()
            stay = old.join(rows.select(F.col("block").alias("_block")).distinct(), F.col("block").eqNullSafe(F.col("_block")), "left_semi")
            stay = stay.join(new, F.col("tile").eqNullSafe(F.col("_tile")), "left_anti")
            rows = rows.unionByName(work.cut(stay.select(rows.columns), "stay"))
        rows = rows.hint("rebalance", "block").sortWithinPartitions("block", "tile")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(at)


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> dict[str, DataFrame]:
    """The tables below ``path``, of the tiles ``wanted`` only if given: identifiers once, and every edge and face with what
    it refers to; a reference that is not met raises when the tables are used."""
    t = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    if wanted is not None:
        blocks = sorted({(k & (SIDE - 1)) + (k >> tiles.ZOOM & (SIDE - 1)) * SIDE for k in wanted})
        t = {name: df.where(F.col("block").isin(blocks)) if "block" in df.columns else df for name, df in t.items()}
        t = {name: df.where(F.col("tile").isin(wanted)) for name, df in t.items()}
    t = {name: df.drop("block") for name, df in t.items()}
    t = {name: df.dropDuplicates([key]) if (key := TABLES[name]) else df.distinct() for name, df in t.items()}
    known = t["vertex"].select(F.col("guid").alias("k"), F.lit(True).alias("ok"))
    check = lambda what: F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.lit(f"{what} not in the artefact")).cast("boolean"))
    for v in ("v1", "v2"):
        t["edge"] = t["edge"].join(known, F.col(v) == F.col("k"), "left").where(check("vertex")).drop("k", "ok")
    edges = t["edge"].select(F.col("guid").alias("k"), F.lit(True).alias("ok"))
    t["face_edge"] = t["face_edge"].join(edges, F.col("edge") == F.col("k"), "left").where(check("edge")).drop("k", "ok")
    return t


# Binary --------------------------------------------------------------------------------------------------------------


def _guid(text: str) -> bytes:
    return uuid.UUID(text).bytes_le


def _cell(c: dict) -> bytes:
    return struct.pack("<Iii", c["tile"], c["x"], c["y"])


def var_int(n: int) -> bytes:
    """A signed number in groups of seven bits, low ones first; its sign is the lowest bit."""
    n = (abs(n) << 1) | (n < 0)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_var_int(stream: BytesIO) -> int:
    n = shift = 0
    while True:
        b = stream.read(1)[0]
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return -(n >> 1) if n & 1 else n >> 1


def text(s: str | None) -> bytes:
    """A text with its size: 0 for null, 1 for a blank one (which comes back empty), else UTF-16 bytes and their number + 2."""
    if s is None:
        return var_int(0)
    if not s.strip():
        return var_int(1)
    raw = s.encode("utf-16-le")
    return var_int(len(raw) + 2) + raw


def read_text(stream: BytesIO) -> str | None:
    n = read_var_int(stream)
    return None if n == 0 else "" if n == 1 else stream.read(n - 2).decode("utf-16-le")


def encode(vertices: list[dict], edges: list[dict], faces: list[dict]) -> bytes:
    """The binary form of a tile, gzipped. Edges are grouped by their first vertex; faces hold ``edges`` (edge, forward) in
    order and ``shares`` (type, share)."""
    out = BytesIO()
    for v in vertices:
        out.write(_guid(v["guid"]) + _cell(v))
    out.write(END)
    by_first: dict[str, list[dict]] = {}
    for e in edges:
        by_first.setdefault(e["v1"], []).append(e)
    for v1, own in by_first.items():
        out.write(_guid(v1) + struct.pack("<i", len(own)))
        for e in own:
            out.write(_guid(e["guid"]) + _guid(e["v2"]) + struct.pack("<i", len(e["shape"])) + b"".join(map(_cell, e["shape"])))
            tags = e["tags"] if e["tags"] is not None else []
            out.write(struct.pack("<i", len(tags)) + b"".join(text(t["k"]) + text(t["v"]) for t in tags))
    out.write(END)
    for f in faces:
        out.write(_guid(f["guid"]) + struct.pack("<i", len(f["edges"])))
        for x in f["edges"]:
            out.write(_guid(x["edge"]) + bytes([x["forward"]]))
        out.write(struct.pack("<i", len(f["shares"])) + b"".join(text(s["type"]) + struct.pack("<d", s["share"]) for s in f["shares"]))
    out.write(END)
    return gzip.compress(out.getvalue(), 1, mtime=0)


def decode(raw: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Vertices, edges and faces of a binary tile."""
    s = BytesIO(gzip.decompress(raw))

    def guid() -> str | None:
        b = s.read(16)
        return None if b == END else str(uuid.UUID(bytes_le=b))

    def number() -> int:
        return struct.unpack("<i", s.read(4))[0]

    def cell() -> dict:
        return dict(zip(("tile", "x", "y"), struct.unpack("<Iii", s.read(12)), strict=True))

    vertices, edges, faces = [], [], []
    while (g := guid()) is not None:
        vertices.append({"guid": g, **cell()})
    while (v1 := guid()) is not None:
        for _ in range(number()):
            e = {"v1": v1, "guid": guid(), "v2": guid(), "shape": [cell() for _ in range(number())]}
            edges.append(e | {"tags": [{"k": read_text(s), "v": read_text(s)} for _ in range(number())]})
    while (g := guid()) is not None:
        own = [{"edge": guid(), "forward": s.read(1)[0] == 1} for _ in range(number())]
        faces.append({"guid": g, "edges": own, "shares": [{"type": read_text(s), "share": struct.unpack("<d", s.read(8))[0]} for _ in range(number())]})
    return vertices, edges, faces


#: Places of the hexadecimal digits in a GUID's text, the order of its bytes, and the values of the digits.
DIGITS = np.array([k for k in range(36) if k not in (8, 13, 18, 23)])
MIXED = np.array([3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16)])
NIBBLE = np.zeros(256, np.uint8)
NIBBLE[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = [*range(16), *range(10, 16)]


def _sized(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text or binary value begins, and the bytes of all."""
    starts = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(int) if len(values) else np.zeros(1, int)
    return starts, memoryview(values.buffers()[2] or b"")


def guid_bytes(texts: pa.Array) -> np.ndarray:
    """``_guid`` of many texts: (n, 16)."""
    starts, raw = _sized(texts)
    if texts.null_count or (np.diff(starts) != 36).any():
        raise ValueError("not an identifier")
    digits = NIBBLE[np.frombuffer(raw, np.uint8)[starts[0] : starts[-1]].reshape(-1, 36)[:, DIGITS]]
    return (digits[:, ::2] << 4 | digits[:, 1::2])[:, MIXED]


def _cell_bytes(*columns: pa.Array) -> np.ndarray:
    """``_cell`` of many tiles, x and y: (n, 12)."""
    if any(c.null_count for c in columns):
        raise ValueError("a point without a cell")
    return np.ascontiguousarray(np.stack([c.to_numpy().astype("<u4") for c in columns], 1)).view(np.uint8).reshape(-1, 12)


def _int_bytes(numbers: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(numbers.astype("<i4")[:, None]).view(np.uint8)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins, and all their values; null is as empty."""
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]), column.flatten()


def _vertex_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = np.concatenate([guid_bytes(batch.column("guid")), _cell_bytes(*(batch.column(k) for k in ("at", "x", "y")))], 1)
        record = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((28 * np.arange(len(raw) + 1)).astype(np.int32)), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("tile"), batch.column("guid"), record], names=["tile", "guid", "record"])


def _edge_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coded: dict[tuple, bytes] = {}
    for batch in batches:
        (cells, shape), (upto, tags) = _lists(batch.column("shape")), _lists(batch.column("tags"))
        head = np.concatenate([guid_bytes(batch.column("guid")), guid_bytes(batch.column("v2")), _int_bytes(np.diff(cells))], 1).tobytes()
        body = _cell_bytes(*(shape.field(k) for k in ("tile", "x", "y"))).tobytes()
        pairs = list(zip(tags.field("k").to_pylist(), tags.field("v").to_pylist(), strict=True))
        for p in set(pairs) - coded.keys():
            coded[p] = text(p[0]) + text(p[1])
        cells, upto, rows = cells.tolist(), upto.tolist(), []
        for i in range(len(batch)):
            own = pairs[upto[i] : upto[i + 1]]
            rows.append(b"".join((head[36 * i : 36 * i + 36], body[12 * cells[i] : 12 * cells[i + 1]], struct.pack("<i", len(own)), *[coded[p] for p in own])))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("tile", "v1", "guid", "tags")), pa.array(rows, pa.binary())], names=["tile", "v1", "guid", "tags", "record"])


def _face_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (first, edges), shares = _lists(batch.column("edges")), batch.column("shares").to_pylist()
        head = np.concatenate([guid_bytes(batch.column("guid")), _int_bytes(np.diff(first))], 1).tobytes()
        forward = edges.field("forward").to_numpy(zero_copy_only=False).astype(np.uint8)
        body = np.concatenate([guid_bytes(edges.field("edge")), forward[:, None]], 1).tobytes()
        seq = edges.field("seq").take(pa.array(first[:-1]))
        at, rows = first.tolist(), []
        for i, own in enumerate(shares):
            rows.append(b"".join((head[20 * i : 20 * i + 20], body[17 * at[i] : 17 * at[i + 1]], struct.pack("<i", len(own)), *[text(s["type"]) + struct.pack("<d", s["share"]) for s in own])))
        yield pa.RecordBatch.from_arrays([batch.column("tile"), batch.column("guid"), seq, pa.array(rows, pa.binary())], names=["tile", "guid", "seq", "record"])


def binary_tiles(parts: dict[str, DataFrame]) -> DataFrame:
    """``tile``, ``file``: the binary form of every tile (as ``encode`` has it), with the far vertices of its edges. The form wants a
    tile in one file, so a tile is put together by one task; use the parquet form for tiles too large for that. Vertices,
    edges and faces become bytes before they meet in their tile, where they are only joined and packed."""
    far = parts["edge"].select("tile", F.explode(F.array("v1", "v2")).alias("guid")).distinct()
    at = parts["vertex"].select("guid", F.col("tile").alias("at"), "x", "y").dropDuplicates(["guid"])
    sorted_ = lambda *keys: F.array_sort(F.collect_list(F.struct(*keys, "record")))
    v = far.join(at, "guid").select("tile", "guid", "at", "x", "y").mapInArrow(_vertex_records, "tile bigint, guid string, record binary")
    v = v.groupBy("tile").agg(sorted_("guid")["record"].alias("vertices"))
    kind = dict(parts["edge"].dtypes)["tags"]
    e = parts["edge"].select("tile", "v1", "guid", "v2", "shape", "tags").mapInArrow(_edge_records, f"tile bigint, v1 string, guid string, tags {kind}, record binary")
    e = e.groupBy("tile").agg(sorted_("v1", "guid", "tags").alias("r")).select("tile", F.col("r.v1").alias("v1"), F.col("r.record").alias("edges"))
    own = parts["face_edge"].groupBy("face").agg(F.array_sort(F.collect_list(F.struct("seq", "edge", "forward"))).alias("edges"))
    f = parts["face"].join(own, F.col("face") == F.col("guid")).select("tile", "guid", "edges", "shares").mapInArrow(_face_records, "tile bigint, guid string, seq bigint, record binary")
    f = f.groupBy("tile").agg(sorted_("guid", "seq")["record"].alias("faces"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for k in ("vertices", "edges", "faces"):
                first, records = _lists(batch.column(k))
                found[k] = first.tolist(), *_sized(records)
            v1 = batch.column("v1").flatten()
            ids, v1 = guid_bytes(v1).tobytes(), v1.to_pylist()
            files = []
            for i in range(len(batch)):
                section = {}
                for k, (first, starts, raw) in found.items():
                    section[k] = bytes(raw[starts[first[i]] : starts[first[i + 1]]])
                first, starts, raw = found["edges"]
                out, at_, stop = [section["vertices"], END], first[i], first[i + 1]
                while at_ < stop:
                    upto = at_ + 1
                    while upto < stop and v1[upto] == v1[at_]:
                        upto += 1
                    out += [ids[16 * at_ : 16 * at_ + 16], struct.pack("<i", upto - at_), raw[starts[at_] : starts[upto]]]
                    at_ = upto
                files.append(gzip.compress(b"".join((*out, END, section["faces"], END)), 1, mtime=0))
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(files, pa.binary())], names=["tile", "file"])

    # A tile may hold faces only: a face is filed where its ring begins, and its edges may all begin in other tiles.
    return e.join(v, "tile", "left").join(f, "tile", "full").select("tile", "vertices", "v1", "edges", "faces").mapInArrow(pack, "tile bigint, file binary")


def scan(raw: bytes) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The identifiers, as bytes, of the vertices, edges and faces of a binary tile; the rest is stepped over."""
    b = gzip.decompress(raw)
    at, vertices, edges, faces = 0, [], [], []
    number = lambda k: int.from_bytes(b[k : k + 4], "little")

    def past_text(k: int) -> int:
        n = shift = 0
        while True:
            byte = b[k]
            k, n, shift = k + 1, n | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return k + max(0, (n >> 1) - 2)

    while (g := b[at : at + 16]) != END:
        vertices.append(g)
        at += 28
    at += 16
    while b[at : at + 16] != END:
        n, at = number(at + 16), at + 20
        for _ in range(n):
            edges.append(b[at : at + 16])
            at += 36 + 12 * number(at + 32)
            tags, at = number(at), at + 4
            for _ in range(2 * tags):
                at = past_text(at)
    at += 16
    while (g := b[at : at + 16]) != END:
        faces.append(g)
        at += 20 + 17 * number(at + 16)
        shares, at = number(at), at + 4
        for _ in range(shares):
            at = past_text(at) + 8
    if at + 16 != len(b):
        raise ValueError("a binary tile that does not end where it should")
    return vertices, edges, faces


def _guid_text(b: bytes) -> str:
    h = b.hex()
    return f"{h[6:8]}{h[4:6]}{h[2:4]}{h[:2]}-{h[10:12]}{h[8:10]}-{h[14:16]}{h[12:14]}-{h[16:20]}-{h[20:]}"


def read_binary(files: DataFrame) -> DataFrame:
    """``tile``, ``n_vertices``, ``n_edges``, ``n_faces``, ``guids`` (of all three, sorted and joined) of binary tiles (tile, file)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, raw in zip(pdf["tile"], pdf["file"], strict=True):
                v, e, f = scan(bytes(raw))
                rows.append((t, len(v), len(e), len(f), ",".join(sorted(map(_guid_text, (*v, *e, *f))))))
            yield pd.DataFrame(rows, columns=["tile", "n_vertices", "n_edges", "n_faces", "guids"])

    return files.mapInPandas(unpack, "tile bigint, n_vertices int, n_edges int, n_faces int, guids string")
