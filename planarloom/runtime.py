"""Session helpers: the shared work folder, cutting lineage, size checks and joins that stand hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys ...
HOT_SHARE = 1000
#: ... and more than HOT_FLOOR of them; fewer rows of one key weigh on no task.
HOT_FLOOR = 2_000

#: Shuffle files of a table that is written are deleted with the end of its job, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, local masters get one folder for the
    process, deleted at its end; other masters are refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="planarloom-"))
        atexit.register(shutil.rmtree, _made[0], True)
    return _made[0]


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Workspace:
    """Intermediate tables below the shared folder. Each is a written table, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/planarloom-{name}-{uuid.uuid4().hex}"
        self._tables: dict[str, str] = {}
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        try:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)
        except Exception:
            pass  # the session has ended already

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: the result has no lineage beyond the files. A label used again names another table;
        the one before stays, as something may still read it."""
        at = self._tables[label] = f"{self.path}/{label}" if label not in self._tables else f"{self.path}/{label}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before) if before is not None else self.spark.conf.unset(FREE_SHUFFLES)
        return self.spark.read.schema(df.schema).parquet(at)

    def cut_counting(self, df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``cut``, and how many rows meet each condition, counted by the job that writes."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]), label)
        return out, dict(seen.get)

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more."""
        for label in labels:
            self._remove(self._tables.pop(label, f"{self.path}/{label}"))

    def drop_all_but(self, *labels: str) -> None:
        """Delete all tables but these."""
        self.drop(*[label for label in self._tables if label not in labels])


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of ``df``; of a written table, its exact size on disk times the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast after counting: only a side of at most ``max_rows`` rows is sent whole."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Equi-join of ``left`` to ``right``, whose ``key`` is unique, without sending a hot key's rows to one task.

    Keys that hold more than 1/``HOT_SHARE`` of ``left`` and more than ``HOT_FLOOR`` rows (at most ``HOT_SHARE`` keys, so
    the set is bounded) join by broadcast of just their rows of ``right``; all other rows shuffle. The keys are counted
    at every size. ``left`` is read twice and should be a written table. ``how``: inner or left.
    """
    n = left.count() if rows is None else rows
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = [r[0] for r in counts.where(F.col("count") > max(n // HOT_SHARE, HOT_FLOOR)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
