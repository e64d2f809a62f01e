"""One group identifier for all records linked directly or through one another.

Deterministic Boruvka hooking. Each round every component selects its smallest outgoing edge, which under the order
(smaller label, larger label) is the one to its smallest neighbour; edges being totally ordered, the selections form
trees whose only cycles are the two ends of one edge, of which the smaller becomes the root. The trees collapse by
pointer doubling, edges are relabelled, and loops and copies dropped, until no edge is left. Every round at least halves
the components that still have edges. The smallest label of a component always stays a root, so it is the group's
identifier. Each step is a written table in the shared folder; what no later step reads is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarloom.runtime import Workspace, skew_join

MAX_ROUNDS = 64


def linked_groups(matches: DataFrame, faces: DataFrame, work: Workspace) -> DataFrame:
    """``face``, ``group_id`` (the group's smallest face) of every face linked to another one.

    Two faces are linked by a row of ``matches`` whose ``is_match`` is true and whose ``face_a`` and ``face_b`` both are
    in ``faces``; undecided, false and dangling rows link nothing.
    """
    known = work.cut(faces.select("face").where("face is not null").distinct(), "faces")
    links = work.cut(matches.where("is_match and face_a <> face_b").select("face_a", "face_b").distinct(), "links")
    n = links.count()
    half = work.cut(skew_join(links, known.withColumnRenamed("face", "face_a"), "face_a", "inner", n), "half-links")
    whole = skew_join(half, known.withColumnRenamed("face", "face_b"), "face_b", "inner", n)
    return connected_components(whole, "face_a", "face_b", work).withColumnRenamed("node", "face")


def connected_components(pairs: DataFrame, a: str, b: str, work: Workspace) -> DataFrame:
    """``node``, ``group_id`` (the group's smallest node) of every node with a pair to another node.

    Pairs may come in either order, repeated, with themselves or with a null side; the last two link nothing. Empty input
    gives no rows. Nodes are BIGINT.
    """
    spark = work.spark
    clean = pairs.select(F.least(a, b).cast("bigint").alias("x"), F.greatest(a, b).cast("bigint").alias("y"), F.col(a).isNull().alias("na"), F.col(b).isNull().alias("nb"))
    edges = work.cut(clean.where("not na and not nb and x <> y").select("x", "y").distinct(), "edges0")
    labels, n_labels = None, 0
    n_edges = edges.count()
    n = 0
    while n_edges:
        n += 1
        if n > MAX_ROUNDS:
            raise RuntimeError("the components did not collapse")
        hook, hook_name = _collapse(edges, n, work)
        if labels is None:
            labels = hook.select(F.col("c").alias("node"), F.col("p").alias("label"))
        else:
            moved = skew_join(labels, hook.withColumnRenamed("c", "label"), "label", "left", n_labels)
            labels = moved.select("node", F.coalesce("p", "label").alias("label"))
        labels = work.cut(labels, f"labels{n}")
        n_labels = n_labels or labels.count()
        half = skew_join(edges, hook.select(F.col("c").alias("x"), F.col("p").alias("px")), "x", "inner", n_edges).select("px", "y")
        half = work.cut(half, f"half{n}")
        both = skew_join(half, hook.select(F.col("c").alias("y"), F.col("p").alias("py")), "y", "inner", n_edges)
        both = both.where("px <> py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y"))
        edges = work.cut(both.distinct(), f"edges{n}")
        n_edges = edges.count()
        work.drop(f"edges{n - 1}", f"half{n}", hook_name, *([f"labels{n - 1}"] if n > 1 else []))
    if labels is None:
        return spark.createDataFrame([], "node bigint, group_id bigint")
    return labels.select("node", F.col("label").alias("group_id"))


def _collapse(edges: DataFrame, n: int, work: Workspace) -> tuple[DataFrame, str]:
    """``c``, ``p``: each component with an edge and the root of the tree it hooks into; and the table's name."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("d")), F.struct(F.col("y").alias("c"), F.col("x").alias("d")))).alias("e"))
    hook = work.cut(ends.groupBy("e.c").agg(F.min("e.d").alias("p")), f"hook{n}-0")
    rows = hook.count()
    k = 0
    while True:
        k += 1
        up = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        moved = skew_join(hook, up, "p", "left", rows)
        if k == 1:  # the smaller end of a two-cycle is a root
            root = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
            moved = moved.select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved"))
        else:
            moved = moved.select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        moved = work.cut(moved, f"hook{n}-{k}")
        work.drop(f"hook{n}-{k - 1}")
        hook = moved.select("c", "p")
        if not moved.where("moved").limit(1).count():
            return hook, f"hook{n}-{k}"
        if k > MAX_ROUNDS:
            raise RuntimeError("the trees did not collapse")
