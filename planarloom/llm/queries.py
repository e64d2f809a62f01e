"""Queries of the language-model data problems (1, 4 and 6 to 9) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planarloom.llm.canon import map_values, typed_values
from planarloom.llm.components import linked_groups
from planarloom.llm.leakage import leaked
from planarloom.llm.packing import pack
from planarloom.llm.splitting import long_texts, pieces
from planarloom.llm.term_stats import TermStats, by_arrival, tag_changes, type_changes
from planarloom.runtime import Workspace
from planarloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of ``way.tags`` and ``landuse.type`` in fewer than 3 records, or in more than 10 % of them."""
    stats = TermStats(Workspace(spark, "p1"))
    changes = tag_changes(table(spark, sf_dir, "way")).unionByName(type_changes(table(spark, sf_dir, "landuse")))
    for batch in by_arrival(changes):
        stats.apply(batch)
    return stats.marked(3, 0.1).where("mark is not null").select("field", "term", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked face with the smallest face of its group."""
    return linked_groups(table(spark, sf_dir, "face_match"), table(spark, sf_dir, "face"), Workspace(spark, "p4"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that is not in the reference list to the letter, with the entry it means, 0 if none."""
    values = typed_values(table(spark, sf_dir, "way"), table(spark, sf_dir, "landuse"))
    return map_values(values, table(spark, sf_dir, "canon_value"), Workspace(spark, "p6")).select("origin", "way_id", "k", "canon_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of at most 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), Workspace(spark, "p7"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of a held-out item."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than 1,024 tokens, and their lines of more."""
    return long_texts(table(spark, sf_dir, "documents"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of at most 1,024 tokens of these texts."""
    return pieces(table(spark, sf_dir, "documents")).drop("long_lines")


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}

ORACLE = {
    "p1_found": """
        WITH tag AS (SELECT way_id, unnest(tags) AS t FROM (SELECT DISTINCT way_id, tags FROM way WHERE way_id IS NOT NULL)),
        term AS (SELECT 'tags' AS field, way_id, lower(trim(t.k)) || '=' || lower(trim(t.v)) AS term FROM tag WHERE t.k IS NOT NULL AND trim(t.v) <> ''
          UNION ALL SELECT 'type', way_id, lower(trim(type)) FROM landuse WHERE way_id IS NOT NULL AND trim(type) <> ''),
        n AS (SELECT field, term, count(DISTINCT way_id) AS n FROM term GROUP BY field, term),
        total AS (SELECT 'tags' AS field, count(DISTINCT way_id) AS m FROM way UNION ALL SELECT 'type', count(DISTINCT way_id) FROM landuse)
        SELECT field, term, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM n JOIN total USING (field) WHERE n < 3 OR n > 0.1 * m""",
    "p4_found": """
        WITH RECURSIVE link AS (SELECT face_a AS a, face_b AS b FROM face_match WHERE is_match AND face_a <> face_b
            AND face_a IN (SELECT face FROM face) AND face_b IN (SELECT face FROM face)),
        ends AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a AS face, a AS other FROM ends UNION SELECT face, b FROM reach JOIN ends ON other = a)
        SELECT face, min(other) AS group_id FROM reach GROUP BY face""",
}
