"""Scan of OSM XML files, plain or gzipped, as node and way tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "tag array<struct<_k string, _v string>>"
_NODE = f"_id bigint, _lat double, _lon double, {_TAG}, _bad string"
_WAY = f"_id bigint, nd array<struct<_ref bigint>>, {_TAG}, _bad string"


def _scan(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    # Elements that are broken, or files that are, give no rows; files are split and read in parallel.
    rows = spark.read.format("xml").option("rowTag", row).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).load(path)
    return rows.where("_id is not null")


def _tags() -> F.Column:
    return F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))).alias("tags")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node_id``, ``lon``, ``lat``, ``tags`` of the nodes in the files at ``path`` (a glob)."""
    return _scan(spark, path, "node", _NODE).select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags())


def ways(spark: SparkSession, path: str) -> DataFrame:
    """``way_id``, ``refs``, ``tags`` of the ways in the files at ``path`` (a glob)."""
    refs = F.transform("nd", lambda n: n["_ref"]).alias("refs")
    return _scan(spark, path, "way", _WAY).select(F.col("_id").alias("way_id"), refs, _tags())


CACHED = "file_name string, kind string, id bigint, lon double, lat double, refs array<bigint>, tags array<struct<k: string, v: string>>"


def cached(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """``CACHED``: nodes ('n') and ways ('w') of the cached tile files below ``folder``: gzipped XML under any name that ends in
    ``.tile.zip``. ``wanted`` (file_name) picks files; one that is not there, or is broken, gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tile.zip").load(folder)
    files = files.withColumn("file_name", F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))))
    if wanted is not None:
        files = files.join(wanted.select("file_name").distinct(), "file_name", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["file_name"], pdf["content"], strict=True):
                rows = []
                try:
                    for _, x in ElementTree.iterparse(gzip.GzipFile(fileobj=BytesIO(raw))):
                        if x.tag in ("node", "way") and x.get("id"):
                            tags = [{"k": t.get("k"), "v": t.get("v")} for t in x.iter("tag")]
                            place = [float(x.get(c)) if x.get(c) else None for c in ("lon", "lat")]
                            rows.append((name, x.tag[0], int(x.get("id")), *place, [int(n.get("ref")) for n in x.iter("nd")] if x.tag == "way" else None, tags))
                            x.clear()
                except (ElementTree.ParseError, OSError, EOFError, ValueError):
                    rows = []
                yield pd.DataFrame(rows, columns=["file_name", "kind", "id", "lon", "lat", "refs", "tags"])

    return files.select("file_name", "content").mapInPandas(parse, CACHED)


def _xml_tags() -> F.Column:
    return F.transform(F.filter("tags", lambda t: t["k"].isNotNull() & t["v"].isNotNull()), lambda t: F.struct(t["k"].alias("_k"), t["v"].alias("_v"))).alias("tag")


def _write(rows: DataFrame, row: str, path: str) -> None:
    # Tasks write what they hold, so a tile of very many rows is written by several.
    rows.write.format("xml").option("rootTag", "osm").option("rowTag", row).option("compression", "gzip").mode("overwrite").partitionBy("tile").save(path)


def write_nodes(rows: DataFrame, path: str) -> None:
    """Write nodes (node_id, lon, lat, tags, tile) as gzipped XML files, partitioned by tile."""
    _write(rows.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), _xml_tags(), "tile"), "node", path)


def write_ways(rows: DataFrame, path: str) -> None:
    """Write ways (way_id, refs, tags, tile) as gzipped XML files, partitioned by tile."""
    nd = F.transform("refs", lambda r: F.struct(r.alias("_ref"))).alias("nd")
    _write(rows.select(F.col("way_id").alias("_id"), nd, _xml_tags(), "tile"), "way", path)
