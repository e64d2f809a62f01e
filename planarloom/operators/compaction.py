"""Many tiny files into few well-sized ones, partition by partition, under snapshot versions.

A ``SnapshotStore`` is a partitioned parquet dataset below one folder. Each commit writes its partitions, with dynamic
overwrite, into directories of their own (``<partition>/snap=<n>``), then publishes version ``n``: a commit file that
names a manifest (the live directories) and the partitions it touched. Readers see a published version only and read its
directories by path, so a writer that fails, or is run again by a retried job, leaves no half-written or doubled records,
and old snapshots cost no listing. A commit names the version it started from; when another commit changed one of its
partitions since then it is refused (``ConflictError``), when other partitions changed it is rebased. Manifests hold a
line per live directory, never one per record or file; the driver reads and writes them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planarloom.runtime import Workspace, hadoop_path

#: Directories one scan takes; more are read by several scans, one after the other in the plan.
DIRS_PER_SCAN = 5_000


class ConflictError(RuntimeError):
    """Another commit changed a partition that this one rewrites."""


class SnapshotStore:
    """Partitioned parquet data with snapshot versions; ``part`` is the partition column.

    Publishing needs a file system whose rename without overwrite is atomic (HDFS and POSIX are; on an object store put
    the ``_commits`` folder where conditional writes exist). Data files may lie anywhere.
    """

    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def version(self) -> int:
        """The newest published version; 0 when nothing is published."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        return [int(x) for x in self._list("_commits") if x.isdigit()]

    def commit_info(self, version: int) -> dict:
        """What a published commit says of itself: version, parent, op, token, manifest and touched (file names)."""
        return json.loads(self._read_text(f"_commits/{version}"))

    def _dirs(self, version: int) -> list[tuple[str, str]]:
        """Live (partition value, directory below ``data``) of ``version``."""
        if not version:
            return []
        return [tuple(json.loads(x)) for x in self._read_text(f"_manifests/{self.commit_info(version)['manifest']}").splitlines()]

    def _touched(self, version: int) -> set[str | None]:
        return {json.loads(x) for x in self._read_text(f"_manifests/{self.commit_info(version)['touched']}").splitlines()}

    def manifest(self, version: int) -> DataFrame:
        """Live ``(part, dir)`` pairs of ``version``."""
        return self.spark.createDataFrame(self._dirs(version), f"`{self.part}` string, dir string")

    def read(self, version: int | None = None, parts: set[str] | None = None) -> DataFrame | None:
        """The records of ``version`` (the newest by default), of the partitions ``parts`` only if given; None when there
        are none. Only live directories are listed and scanned."""
        version = self.version() if version is None else version
        dirs = [d for p, d in self._dirs(version) if parts is None or p in parts]
        return self._load(dirs)

    def _load(self, dirs: list[str]) -> DataFrame | None:
        if not dirs:
            return None
        base = f"{self.path}/data"
        scans = []
        for i in range(0, len(dirs), DIRS_PER_SCAN):
            paths = [f"{base}/{d}" for d in dirs[i : i + DIRS_PER_SCAN]]
            scans.append(self.spark.read.option("basePath", base).parquet(*paths).drop("snap"))
        return reduce(DataFrame.unionByName, scans)

    def write(self, rows: DataFrame, base: int, replaced: DataFrame | set | None, op: str) -> int:
        """Write ``rows`` as new partition versions and publish them.

        ``replaced``: partitions (a set of their values as strings, or a frame of column ``part``) whose older
        directories the new ones stand for; None when the rows are added to what is live. Returns the published version.
        """
        if isinstance(replaced, DataFrame):
            replaced = {r[0] for r in replaced.select(F.col(self.part).cast("string")).distinct().collect()}  # a row per partition
        token = base + 1
        while not self._create(f"_claims/{token}", op):
            token += 1  # another writer holds this directory number, perhaps for ever
        rows = rows.withColumn("snap", F.lit(token))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part, "snap").parquet(f"{self.path}/data"))
        return self._publish(token, base, replaced, op)

    def _publish(self, token: int, base: int, replaced: set | None, op: str) -> int:
        fresh = self._written(token)
        touched = {p for p, _ in fresh} | (replaced or set())
        while True:
            newest = self.version()
            if replaced is not None:
                for v in range(base + 1, newest + 1):
                    if self._touched(v) & touched:
                        raise ConflictError(f"{op} from version {base}: its partitions were changed up to version {newest}")
            live = [x for x in self._dirs(newest) if replaced is None or x[0] not in replaced]
            # Names hold the writer's token, so a loser never overwrites what a winner published.
            name = f"{newest + 1}-{token}-{uuid.uuid4().hex[:8]}"
            self._write_text(f"_manifests/{name}", "\n".join(json.dumps(x) for x in live + fresh))
            self._write_text(f"_manifests/{name}.touched", "\n".join(json.dumps(x) for x in sorted(touched, key=str)))
            info = {"version": newest + 1, "parent": newest, "op": op, "token": token, "manifest": name, "touched": f"{name}.touched"}
            if self._publish_file(f"_commits/{newest + 1}", json.dumps(info)):
                return newest + 1

    def _written(self, token: int) -> list[tuple[str | None, str]]:
        """(partition value, directory) of every directory that ``token`` wrote."""
        fs, p = hadoop_path(self.spark, f"{self.path}/data/*/snap={token}")
        out = []
        for x in fs.globStatus(p) or []:
            name = x.getPath().getParent().getName()
            value = unquote(name.split("=", 1)[1])
            out.append((None if value == "__HIVE_DEFAULT_PARTITION__" else value, f"{name}/snap={token}"))
        return sorted(out, key=str)

    # Small files -----------------------------------------------------------------------------------------------------

    def _list(self, below: str) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.path}/{below}")
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, name: str) -> str:
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _create(self, name: str, text: str) -> bool:
        """Create a file unless it exists; whether this call made it."""
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _publish_file(self, name: str, text: str) -> bool:
        """Put a whole file in place unless one is there: written under another name, then renamed without overwrite, so
        no reader sees half of it and of two writers one wins."""
        temp = f"_commits/.{uuid.uuid4().hex}"
        self._write_text(temp, text)
        fs, src = hadoop_path(self.spark, f"{self.path}/{temp}")
        _, dst = hadoop_path(self.spark, f"{self.path}/{name}")
        try:
            if fs.getScheme() == "file":  # its rename overwrites; a hard link does not
                local = lambda p: urlparse(p.toString()).path
                os.link(local(src), local(dst))
                return True
            jvm = self.spark._jvm
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)
            return True
        except Exception:
            if fs.exists(dst):
                return False
            raise
        finally:
            if fs.exists(src):
                fs.delete(src, False)

    # Upkeep ----------------------------------------------------------------------------------------------------------

    def file_stats(self, small_bytes: int, version: int | None = None) -> DataFrame:
        """Per partition: ``n_files``, ``n_small`` (files under ``small_bytes``), ``n_bytes``, from the listing alone."""
        version = self.version() if version is None else version
        dirs = self._dirs(version)
        if not dirs:
            return self.spark.createDataFrame([], f"`{self.part}` string, n_files bigint, n_small bigint, n_bytes bigint")
        # Only path and length are read, so no file is opened; many directories are listed by a distributed job.
        files = [
            self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load([f"{self.path}/data/{d}" for _, d in dirs[i : i + DIRS_PER_SCAN]]).select("path", "length")
            for i in range(0, len(dirs), DIRS_PER_SCAN)
        ]
        listed = reduce(DataFrame.unionByName, files).withColumn("dir", F.regexp_extract("path", r"/([^/]+/snap=\d+)/[^/]+$", 1))
        # Paths come back percent-encoded or not, depending on the file system: both spellings are known.
        names = {d: p for p, d in dirs} | {d.replace("%", "%25").replace(" ", "%20"): p for p, d in dirs}
        known = self.spark.createDataFrame([(d, p) for d, p in names.items()], f"dir string, `{self.part}` string")
        return (
            listed.join(known, "dir")
            .groupBy(self.part)
            .agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("length") < small_bytes, 1)).alias("n_small"), F.sum("length").alias("n_bytes"))
        )

    def compact(self, max_small: int, small_bytes: int, target_bytes: int, keys: list[str] | None = None) -> int:
        """Rewrite each partition with more than ``max_small`` files under ``small_bytes`` into files of about
        ``target_bytes`` (measured on the files as they are stored); leave the others as they are. With ``keys`` rows that
        agree in them become one, which has the smallest of the other columns. Returns the version then current."""
        base = self.version()
        todo = self.file_stats(small_bytes, base).where(F.col("n_small") > max_small).select(F.col(self.part), files_for("n_bytes", target_bytes).alias("_n"))
        plan = {r[0]: r[1] for r in todo.collect()}  # a row per partition, as in the manifest
        rows = self.read(base, set(plan)) if plan else None
        if rows is None:
            return base
        # The plan is as long as the manifest; partitions of one file are left out of the lookup.
        salted = {p: n for p, n in plan.items() if n > 1}
        n_files = F.lit(1)
        if salted:
            table = self.spark.createDataFrame([*salted.items()], "_p string, _n int")
            rows = rows.withColumn("_p", F.col(self.part).cast("string")).join(table, "_p", "left")
            n_files = F.coalesce("_n", F.lit(1))
        columns = [c for c in rows.columns if c not in ("_p", "_n")]
        packed = spread(rows, self.part, n_files, keys or columns, keep=True)
        if keys:
            rest = [c for c in columns if c not in keys and c != self.part]
            packed = packed.groupBy(self.part, "_salt", *keys).agg(*[F.min(c).alias(c) for c in rest])
        return self.write(packed.select(columns), base, set(plan), "compact")

    def expire(self, keep_versions: int = 1, grace_s: float = 24 * 3600) -> int:
        """Delete what only versions older than the newest ``keep_versions`` use: their commits and manifests, and data
        directories no kept version names. Directories of writers that have not published are kept until their claim is
        ``grace_s`` seconds old. Returns how many data directories were deleted."""
        versions = sorted(self._versions())
        kept, old = versions[-keep_versions:], versions[:-keep_versions]
        if not kept:
            return 0
        live = {d for v in kept for _, d in self._dirs(v)}
        infos = {v: self.commit_info(v) for v in versions}
        published = {i["token"] for i in infos.values()}
        fs, claims = hadoop_path(self.spark, f"{self.path}/_claims")
        now = time.time() * 1000
        open_claims = {int(x.getPath().getName()) for x in fs.listStatus(claims) if x.getPath().getName().isdigit() and now - x.getModificationTime() < grace_s * 1000} - published
        _, every = hadoop_path(self.spark, f"{self.path}/data/*/snap=*")
        n = 0
        for x in fs.globStatus(every) or []:
            p = x.getPath()
            if f"{p.getParent().getName()}/{p.getName()}" not in live and int(p.getName().split("=")[1]) not in open_claims:
                n += bool(fs.delete(p, True))
        for v in old:
            for name in (f"_commits/{v}", f"_manifests/{infos[v]['manifest']}", f"_manifests/{infos[v]['touched']}"):
                fs.delete(hadoop_path(self.spark, f"{self.path}/{name}")[1], False)
        return n


def files_for(n_bytes: str, target_bytes: int) -> Column:
    """How many files of about ``target_bytes`` hold ``n_bytes``."""
    return F.greatest(F.lit(1), F.ceil(F.col(n_bytes) / F.lit(target_bytes))).cast("int")


def spread(rows: DataFrame, part: str, n_files: Column, by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Shuffle so that each partition's rows meet in ``n_files`` tasks: a large partition is salted, a small one whole.
    Rows that agree in ``by`` (all columns by default) meet; ``keep`` leaves the salt as ``_salt``."""
    row_hash = F.xxhash64(*(by or rows.columns))
    salted = rows.withColumn("_salt", F.pmod(row_hash, n_files)).repartition(F.col(part), F.col("_salt"))
    return salted if keep else salted.drop("_salt")


#: Prefix of the partition directories' values: keeps them strings and non-empty whatever the folder is called.
SLOT = "f"
RECORD_SCHEMA = "cache_folder string, kind string, elem_id bigint, rev int, body string"
KEY = ["cache_folder", "kind", "elem_id", "rev"]


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Element records of files given as (cache_folder, content): each line that is one whole JSON object by itself, with
    ``kind`` 'n' or 'w' and whole-number ``id`` and ``rev`` (the digits 0 to 9 in quotes count). Other lines are skipped,
    also those with the bare words NaN and Infinity, which JSON does not know, and numbers too long for their type."""
    from json import JSONDecoder
    from re import compile as regex

    def refuse(name: str) -> float:
        raise ValueError(name)

    def bounded(digits: str) -> int | None:
        return int(digits) if len(digits) < 40 else None  # far beyond 64 bits, whatever the field

    digits = regex(r"-?[0-9]{1,30}")
    read = JSONDecoder(parse_constant=refuse).decode
    read_long = JSONDecoder(parse_constant=refuse, parse_int=bounded).decode

    def whole(x: object) -> int | None:
        if isinstance(x, bool):
            return None
        if isinstance(x, int):
            return x
        if isinstance(x, str) and digits.fullmatch(x.strip()):
            return int(x)
        return None

    for batch in batches:
        out: list[tuple] = []
        for folder, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            for line in (content or "").split("\n"):
                line = line.strip(" \t\r")
                if len(line) < 2 or line[0] != "{" or line[-1] != "}":
                    continue
                try:
                    o = (read if len(line) < 4000 else read_long)(line)
                except (ValueError, RecursionError):
                    continue
                kind, ident, rev = o.get("kind"), whole(o.get("id")), whole(o.get("rev"))
                if kind in ("n", "w") and ident is not None and rev is not None and -(2**63) <= ident < 2**63 and -(2**31) <= rev < 2**31:
                    out.append((folder, kind, ident, rev, line))
        types = [("cache_folder", pa.string()), ("kind", pa.string()), ("elem_id", pa.int64()), ("rev", pa.int32()), ("body", pa.string())]
        columns = list(zip(*out, strict=True)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def folder_stats(files: DataFrame, small_bytes: int) -> DataFrame:
    """Per folder: how many files, how many of them under ``small_bytes``, and their bytes (of the text as stored)."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return (
        files.where("cache_folder is not null")
        .groupBy("cache_folder")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(size < small_bytes, 1)).alias("n_small"), F.sum(size).alias("n_bytes"))
    )


def load_folders(files: DataFrame, store: SnapshotStore, batches: int = 2) -> None:
    """Append the records of all files to ``store``, a partition per folder, in ``batches`` commits.

    Each commit takes the files of one hash class of (folder, content), so a job that fails between two loses none of
    the earlier ones. Tasks write what they have read without a shuffle, so the partitions consist of small files, as
    the folders do. Files with null folder or content give nothing.
    """
    slot = F.concat(F.lit(SLOT), F.col("cache_folder"))
    known = files.where("cache_folder is not null and content is not null").select("cache_folder", "content")
    for k in range(batches):
        part = known.where(F.pmod(F.xxhash64("cache_folder", "content"), F.lit(batches)) == k)
        store.write(part.mapInArrow(parse_records, RECORD_SCHEMA).withColumn("slot", slot), store.version(), None, f"load {k + 1} of {batches}")


def compact_folders(files: DataFrame, work: Workspace, max_small: int = 1, small_bytes: int = 32 << 20, target_bytes: int = 128 << 20, path: str | None = None) -> DataFrame:
    """Consolidate the files below each folder; returns the records of all folders (``KEY`` and ``body``), each once.

    The files are loaded into a ``SnapshotStore`` at ``path`` (by default in the workspace, which ends with the session) by
    several commits; then the partitions with more than ``max_small`` files under ``small_bytes`` are rewritten into files
    of about ``target_bytes`` that hold every readable record once, and the files this makes superfluous are deleted.
    The result is read from the published version. ``body`` is the smallest of a record's lines. Extra columns are
    ignored; empty input gives no rows.
    """
    store = SnapshotStore(work.spark, path or f"{work.path}/store", "slot")
    load_folders(files, store)
    before = store.version()
    compacted = store.compact(max_small, small_bytes, target_bytes, KEY)
    # What compaction has written is distinct already; partitions it has left alone may hold a record in several files.
    done = store._touched(compacted) if compacted > before else set()
    store.expire(1)
    rest = {p for p, _ in store._dirs(compacted)} - done
    found = [store.read(compacted, done)] if done else []
    if rest:
        left = store.read(compacted, rest)
        found.append(left.groupBy(*KEY).agg(F.min("body").alias("body")))
    found = [x.select(*KEY, "body") for x in found if x is not None]
    return reduce(DataFrame.unionByName, found) if found else work.spark.createDataFrame([], RECORD_SCHEMA)
