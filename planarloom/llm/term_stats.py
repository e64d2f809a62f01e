"""Occurrence and record counts of every term, kept up to date by signed deltas.

``TermStats`` keeps, below one folder, one partitioned table under snapshot versions. Its slices ``s<k>`` hold the state,
what each record contributes now and by which version of it; its slices ``c<k>`` the counts per term. ``apply`` takes only
added, changed or deleted records, compares them with their state, and turns the difference into ``+``/``-`` changes per
term. These are summed before they are shuffled and merged into the counts of the slices they touch; nothing else is read
or written again. State and counts of a batch are published by one commit, so a batch counts wholly or not at all, and a
batch sent again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarloom.operators.compaction import SnapshotStore, spread
from planarloom.runtime import Workspace, broadcast_if_small, hadoop_path

#: Columns of a change: the field, the record, its version (the latest counts), its terms (null: deleted).
CHANGE = ["field", "rec_id", "version", "terms"]
#: Records of the first batch per slice, and rows a task writes of a slice.
ROWS_PER_SLICE, ROWS_PER_TASK = 250_000, 500_000


def slice_of(kind: str, n: int, *cols: str) -> Column:
    """Partition of a key: ``<kind><k>``."""
    return F.concat(F.lit(kind), F.pmod(F.xxhash64(*cols), F.lit(n)).cast("string"))


class TermStats:
    """Persistent counts per (field, term): ``n_occ`` occurrences in ``n_rec`` records.

    They are kept below ``path``, which outlives the session: another ``TermStats`` on it goes on from there. Without
    ``path`` they are kept in the workspace and end with it. ``buckets`` is the number of slices of each kind; by default
    the first batch's size decides, and an existing store keeps its own. Writers may meet: the later commit is refused.
    """

    def __init__(self, work: Workspace, buckets: int | None = None, path: str | None = None):
        self.work, self.spark = work, work.spark
        self.root = (path or work.path).rstrip("/")
        self.store = SnapshotStore(self.spark, f"{self.root}/terms", "slice")
        fs, p = hadoop_path(self.spark, f"{self.root}/_buckets")
        known = [int(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        if known and buckets and known != [buckets]:
            raise ValueError(f"{self.root} has {known[0]} buckets")
        self.buckets = known[0] if known else buckets
        if self.buckets and not known:
            self._fix_buckets(self.buckets)

    def _fix_buckets(self, n: int) -> None:
        self.buckets = n
        fs, p = hadoop_path(self.spark, f"{self.root}/_buckets/{n}")
        fs.mkdirs(p)

    def apply(self, changes: DataFrame) -> None:
        """Merge a batch of changed records. Of all rows of a record, in this batch and the ones before, the one with the
        highest ``version`` counts (a null one is lowest; ties: the longest, then greatest, sorted term list), so the order
        of batches does not matter. Null ids are skipped; a null ``terms`` deletes the record, whose version is kept;
        deleting an unknown record, or sending one unchanged, changes no count."""
        spark, base = self.spark, self.store.version()
        name = f"batch{base + 1}"
        row = F.struct("version", F.coalesce(F.size("terms"), F.lit(-1)).alias("n"), F.array_sort("terms").alias("terms"))
        new = changes.where("field is not null and rec_id is not null").groupBy("field", "rec_id").agg(F.max(row).alias("new"))
        new = self.work.cut(new, f"{name}-new")
        n_new = new.count()
        if not n_new:
            return
        if not self.buckets:
            self._fix_buckets(max(4, -(-n_new // ROWS_PER_SLICE)))
        new = new.withColumn("slice", slice_of("s", self.buckets, "field", "rec_id"))
        touched = {r[0] for r in new.select("slice").distinct().collect()}  # at most the number of slices
        kept = self.store.read(base, touched) if base else None
        row_type = new.schema["new"].dataType.simpleString()
        if kept is None:
            both = new.withColumn("old", F.lit(None).cast(row_type))
        else:
            old = kept.select("slice", "field", "rec_id", F.struct("version", F.coalesce(F.size("terms"), F.lit(-1)).alias("n"), "terms").cast(row_type).alias("old"))
            both = new.join(old, ["slice", "field", "rec_id"], "left")
        both = self.work.cut(both.where("old is null or new > old"), name)

        def side(col: str, sign: int) -> DataFrame:
            # The terms are sorted, so the first of each run of equal ones counts the record.
            terms = F.col(f"{col}.terms")
            marked = F.transform(terms, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(terms, i - 1) != t)).cast("bigint").alias("first")))
            return both.select("field", F.explode(marked).alias("x")).where("x.term is not null").select("field", "x.term", F.lit(sign).cast("bigint").alias("d_occ"), (F.col("x.first") * sign).alias("d_rec"))

        there = lambda col: F.coalesce((F.col(f"{col}.n") >= 0).cast("bigint"), F.lit(0).cast("bigint"))
        totals = both.select("field", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("d_occ"), (there("new") - there("old")).alias("d_rec"))
        deltas = side("new", 1).unionByName(side("old", -1)).unionByName(totals).groupBy("field", "term").agg(F.sum("d_occ").alias("n_occ"), F.sum("d_rec").alias("n_rec"))
        deltas = self.work.cut(deltas.where("n_occ <> 0 or n_rec <> 0").withColumn("slice", slice_of("c", self.buckets, "field", "term")), f"{name}-deltas")
        changed = {r[0] for r in deltas.select("slice").distinct().collect()}  # likewise
        counts = [deltas]
        before = self.store.read(base, changed) if base and changed else None
        if before is not None:
            counts.append(before.select(deltas.columns))
        merged = reduce(DataFrame.unionByName, counts).groupBy("slice", "field", "term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_rec").alias("n_rec")).where("n_rec <> 0 or n_occ <> 0")
        state = both.select("slice", "field", "rec_id", "new.version", "new.terms")
        if kept is not None:
            same = kept.join(both.select("slice", "field", "rec_id"), ["slice", "field", "rec_id"], "left_anti")
            state = state.unionByName(same.select(state.columns))
        rows = state.unionByName(merged, allowMissingColumns=True)
        salts = F.lit(max(1, -(-n_new // (self.buckets * ROWS_PER_TASK))))
        self.store.write(spread(rows, "slice", salts, ["field", "rec_id", "term"]), base, touched | changed, name)
        self.work.drop(name, f"{name}-new", f"{name}-deltas")

    def terms(self) -> DataFrame:
        """``field``, ``term``, ``n_occ``, ``n_rec`` of every term that occurs now."""
        return self._rows().where("term is not null").select("field", "term", "n_occ", "n_rec")

    def totals(self) -> DataFrame:
        """``field``, ``n_records`` (records without terms count too)."""
        return self._rows().where("term is null").select("field", F.col("n_rec").alias("n_records"))

    def _rows(self) -> DataFrame:
        version = self.store.version()
        slices = {p for p, _ in self.store._dirs(version) if p.startswith("c")}
        rows = self.store.read(version, slices) if slices else None
        return self.spark.createDataFrame([], "slice string, field string, term string, n_occ bigint, n_rec bigint") if rows is None else rows

    def marked(self, rare_below: int, common_share: float) -> DataFrame:
        """Every term with ``mark``: 'rare' in fewer than ``rare_below`` records, 'common' in more than ``common_share``
        of its field's records, null if neither; a term that is both is 'rare'."""
        totals = broadcast_if_small(self.totals(), 10_000)
        mark = F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") > common_share * F.col("n_records"), "common")
        return self.terms().join(totals, "field").select("field", "term", "n_occ", "n_rec", mark.alias("mark"))


def by_arrival(changes: DataFrame, batches: int = 2) -> list[DataFrame]:
    """The changes in ``batches`` parts of equal spans of ``version`` (a timestamp), the earliest, and null ones, first."""
    low, top = changes.agg(F.min("version"), F.max("version")).first()
    if low is None or low == top:
        return [changes]
    at = [F.lit(low + (top - low) * k / batches) for k in range(1, batches)]
    place = F.coalesce(sum(((F.col("version") >= x).cast("int") for x in at), F.lit(0)), F.lit(0))
    return [changes.where(place == k) for k in range(batches)]


def tag_changes(way: DataFrame) -> DataFrame:
    """Ways as changes of field 'tags': terms ``k=v``, trimmed and in lower case. Null tags are a record without terms;
    tags with a null key, or a value that is null or blank, are none."""
    k, v = (lambda t: F.lower(F.trim(t["k"]))), (lambda t: F.lower(F.trim(t["v"])))
    terms = F.transform(F.filter("tags", lambda t: t["k"].isNotNull() & (v(t) != "")), lambda t: F.concat(k(t), F.lit("="), v(t)))
    return way.select(F.lit("tags").alias("field"), F.col("way_id").alias("rec_id"), F.col("loaded_at").alias("version"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))


def type_changes(landuse: DataFrame) -> DataFrame:
    """Land uses as changes of field 'type': the trimmed, lower-case ``type``; null and blank ones have no term."""
    t = F.lower(F.trim("type"))
    return landuse.select(F.lit("type").alias("field"), F.col("way_id").alias("rec_id"), F.col("loaded_at").alias("version"), F.filter(F.array(t), lambda x: x != "").alias("terms"))
