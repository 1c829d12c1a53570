"""Sharded storage by size-tiered compaction with a versioned manifest.

append() writes an arrival as small immutable shards, as many as its tasks have,
and commits a manifest that names them. compact() takes the shards of the current
manifest, puts them in tiers by size (each FAN times the last), and cuts a tier of FAN
shards or more, in order of their names, into runs of about TARGET_BYTES. Each run is
read and written as one file by one task, so nothing is shuffled; what is large enough
is left alone. JOBS jobs of RUNS_PER_JOB runs each run at a time.

A commit first claims its version by a file that only one writer can create, then
writes the manifest under another name and renames it: readers see a version whole or
not at all, and of two writers one wins and the other is told. A claim that a writer
left behind when it died is removed by unclaim(). Files that no version names are
garbage that is never read. Shards of older versions stay readable until expire()
removes them.

The manifest has a row for each shard, not for each document; the driver handles
shard names and sizes only, some 200 bytes a shard (at 100 TB, with a target of 1 GB,
20 MB). Rows move once an arrival and once a tier.

Nulls and repeated rows are stored as they are, and columns keep their names, types
and values, whatever the names. An empty arrival commits a version without new
shards. Shards of equal size are merged in the order of their names.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20
FAN = 4
FLOOR_BYTES = 64 << 10
RUNS_PER_JOB = 200
JOBS = 8


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    level: int  # how many merges its rows have been through


class Store:
    """A folder of shards and manifests, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        # unions of one-task reads must stay as many tasks, one a run
        self._merging = spark.newSession()
        self._merging.conf.set("spark.sql.unionOutputPartitioning", "false")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the newest."""
        have = self.versions()
        if not have:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest-{have[-1] if version is None else version:09d}.json"))
        try:
            body = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(body)["shards"]]

    def _claim(self, version: int) -> bool:
        """Create the version's claim, which fails if it is there: on a local disk by the system's own exclusive create, elsewhere by the store's."""
        path = self._path(f"{self.root}/claim-{version:09d}")
        if self._fs.getScheme() == "file":
            return self.spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:
            return False
        return True

    def unclaim(self, version: int) -> None:
        """Give up a version that was claimed but never committed."""
        if version not in self.versions():
            self._fs.delete(self._path(f"{self.root}/claim-{version:09d}"), False)

    def commit(self, shards: list[Shard], base: int) -> int:
        """Make ``shards`` version base + 1; an error if another writer has that version."""
        version = base + 1
        if version in self.versions() or not self._claim(version):
            raise RuntimeError(f"version {version} was taken by another writer")
        body = json.dumps({"version": version, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]}).encode()
        draft, final = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{version:09d}.json")
        stream = self._fs.create(draft, False)
        stream.write(body)
        stream.close()
        if not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} could not be written")
        return version

    def expire(self, keep: int = 2) -> int:
        """Remove manifests but the newest ``keep``, and the shards that only those named; how many shards went."""
        have = self.versions()
        named = {s.path for v in have[-keep:] for s in self.manifest(v)}
        gone = {s.path for v in have[:-keep] for s in self.manifest(v)} - named
        for v in have[:-keep]:  # the manifest first, so that no version names a shard that isn't there
            self._fs.delete(self._path(f"{self.root}/manifest-{v:09d}.json"), False)
        for path in gone:
            self._fs.delete(self._path(path), False)
        return len(gone)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of the shards in a folder."""
        files, out = self._fs.listFiles(self._path(folder), True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet") and f.getLen():
                out.append((f.getPath().toString(), f.getLen()))
        return out

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as small shards and commit them."""
        base = (self.versions() or [0])[-1]
        folder = f"{self.root}/arrival-{uuid.uuid4().hex}"
        arrival.write.parquet(folder)
        return self.commit(self.manifest() + [Shard(p, n, 0) for p, n in self._files(folder)], base)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards to merge, each of about the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                t, top = 0, FLOOR_BYTES
                while s.size > top:
                    t, top = t + 1, top * self.fan
                tiers.setdefault(t, []).append(s)
        runs = []
        for _, tier in sorted(tiers.items()):
            if len(tier) < self.fan:
                continue
            run, size = [], 0
            for s in sorted(tier, key=lambda s: s.path):
                if run and size + s.size > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int | None:
        """Merge what plan() names, a task a run, and commit; None if there is nothing to do."""
        base, shards = (self.versions() or [0])[-1], self.manifest()
        runs = self.plan(shards)
        if not runs:
            return None
        schema = self.spark.read.parquet(runs[0][0].path).schema
        folder = f"{self.root}/merged-{uuid.uuid4().hex}"

        def merge(at: int) -> list[Shard]:
            parts = [self._merging.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1) for run in runs[at : at + RUNS_PER_JOB]]
            reduce(DataFrame.union, parts).write.parquet(f"{folder}/{at:09d}")
            # a file's number is that of its task, and so of its run
            level = lambda path: 1 + max(s.level for s in runs[at + int(path.rsplit("/part-", 1)[1][:5])])
            return [Shard(p, n, level(p)) for p, n in self._files(f"{folder}/{at:09d}")]

        with ThreadPoolExecutor(JOBS) as pool:
            merged = [s for done in pool.map(merge, range(0, len(runs), RUNS_PER_JOB)) for s in done]
        gone = {s.path for run in runs for s in run}
        return self.commit([s for s in shards if s.path not in gone] + merged, base)

    def read(self, *columns: Column) -> DataFrame:
        """The rows of the newest version with the name of their shard."""
        return self.spark.read.parquet(*[s.path for s in self.manifest()]).select(*columns, F.col("_metadata.file_name").alias("shard"))


def shard_documents(docs: DataFrame, root: str, arrivals: int = 4, doc_id: str = "doc_id", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Store ``docs`` as ``arrivals`` appended parts, compact until nothing is left to merge, and say where each row is.

    doc_id, shard, level, shard_rows, shard_bytes, version: one row per row.
    """
    spark = docs.sparkSession
    store = Store(spark, root, target_bytes)
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(arrivals)) == k))
    while store.compact() is not None:
        store.expire()
    shards = store.manifest()
    version = store.versions()[-1]
    schema = f"doc_id {docs.select(doc_id).schema[0].dataType.simpleString()}, shard string, level int, shard_rows long, shard_bytes long, version int"
    if not shards:
        return spark.createDataFrame([], schema)
    rows = store.read(F.col(doc_id).alias("doc_id"))
    sizes = spark.createDataFrame([(s.path.rsplit("/", 1)[-1], s.level, s.size) for s in shards], "shard string, level int, shard_bytes long")
    counts = rows.groupBy("shard").agg(F.count("*").alias("shard_rows")).join(sizes, "shard")
    return rows.join(F.broadcast(counts), "shard").select("doc_id", "shard", "level", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
