"""Reading the project's tables, and the forms in which the graph operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v``, ``loc`` (lon, lat): one row per located vertex; of several locations the least counts."""
    rows = table(spark, sf_dir, "vertex").where("v is not null and lon is not null and lat is not null")
    return rows.groupBy("v").agg(F.min(F.struct("lon", "lat")).alias("loc"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id``, ``loc`` (lon, lat): one row per located node; of several locations the least counts."""
    rows = table(spark, sf_dir, "vertex").where("node_id is not null and lon is not null and lat is not null")
    return rows.groupBy("node_id").agg(F.min(F.struct("lon", "lat")).alias("loc"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e``, ``v1``, ``v2``, ``shape``, ``tags``: repeated rows once, rows with a null id or end left out."""
    return table(spark, sf_dir, "edge").where("e is not null and v1 is not null and v2 is not null").select("e", "v1", "v2", "shape", "tags").distinct()


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_id``, ``refs``, ``tags``: repeated deliveries once."""
    return table(spark, sf_dir, "way").where("way_id is not null").select("way_id", "refs", "tags").distinct()


def landuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_id``, ``type``, ``ring``: repeated deliveries once."""
    return table(spark, sf_dir, "landuse").where("way_id is not null").select("way_id", "type", "ring").distinct()


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e``, ``v1``, ``v2``, ``tags``, ``pts``: every edge whose ends are located, with its whole line of points."""
    at = vertices(spark, sf_dir)
    rows = edges(spark, sf_dir).join(at.select(F.col("v").alias("v1"), F.col("loc").alias("_a")), "v1").join(at.select(F.col("v").alias("v2"), F.col("loc").alias("_b")), "v2")
    shape = F.coalesce("shape", F.array().cast("array<struct<lon:double,lat:double>>"))
    return rows.select("e", "v1", "v2", "tags", F.concat(F.array("_a"), shape, F.array("_b")).alias("pts"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_lines`` of the edges whose ends differ."""
    return edge_lines(spark, sf_dir).where("v1 <> v2")


#: The same forms as common table expressions.
CTE = {
    "vx": "vx AS (SELECT v, min({'lon': lon, 'lat': lat}) AS loc FROM vertex WHERE v IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY v)",
    "nx": "nx AS (SELECT node_id, min({'lon': lon, 'lat': lat}) AS loc FROM vertex WHERE node_id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY node_id)",
    "ex": "ex AS (SELECT DISTINCT e, v1, v2, shape, tags FROM edge WHERE e IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL)",
    "wx": "wx AS (SELECT DISTINCT way_id, refs, tags FROM way WHERE way_id IS NOT NULL)",
    "lx": "lx AS (SELECT DISTINCT way_id, type, ring FROM landuse WHERE way_id IS NOT NULL)",
    "eg": "eg AS (SELECT e, v1, v2, tags, list_concat([a.loc], coalesce(shape, []), [b.loc]) AS pts FROM ex JOIN vx a ON a.v = v1 JOIN vx b ON b.v = v2)",
}


def ctes(*names: str) -> str:
    """``WITH`` clause of these forms."""
    return "WITH " + ", ".join(CTE[n] for n in names)
