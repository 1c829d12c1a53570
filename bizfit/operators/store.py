"""Tables that grow by small changes: companies in buckets, a score history by tail of the key, pages by day of expiry.

There is no table format here, so what a change may touch is bounded by folders: an
upsert rewrites the buckets of its own keys, an append looks for its keys in the
folders of their tails only, a purge drops whole days and rewrites one. Paths are the caller's.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bizfit.operators.shared import cut, discard

TRIES = 20


class Files:
    """The few calls on the file system of a path that Spark's readers and writers don't have."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.at = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if self.fs.exists(self.at(path)) else []

    def text(self, path: str) -> str:
        source = self.fs.open(self.at(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def create(self, path: str, text: str, still: Callable[[], bool] = lambda: True) -> bool:
        """Write a file that isn't there yet; false if it is, or if ``still`` doesn't hold when its name is taken."""
        try:
            out = self.fs.create(self.at(path), False)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception) or self.fs.exists(self.at(path)):
                return False
            raise
        if not still():
            out.close()
            self.delete(path)
            return False
        out.write(text.encode())
        out.close()
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


@dataclass(frozen=True)
class KeyedTable:
    """K1, K2: a table with one row a key, in buckets of the key's hash, each version a list of the buckets' folders.

    An upsert writes the buckets of its keys into a new folder and then a version file,
    which is the commit: readers see the newest whole version, files of untouched buckets
    stay as they are, and a writer that dies before its version file has changed nothing.
    The version file is created exclusively; who finds it taken merges anew with what the
    other writer left. A writer may number its changes (epoch): one that is already in
    the table, as after a restart, is not done again. Buckets that no version lists any
    more stay until vacuum().
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64
    files_per_bucket: int = 1

    def _files(self) -> Files:
        return Files(self.spark, self.path)

    def _version(self, below: str = "~") -> tuple[int, str, dict]:
        """(number to be taken next, name of the newest whole version, what it says)."""
        files = self._files()
        names = [n for n in files.names(f"{self.path}/_versions") if n < below]
        for name in reversed(names):
            text = files.text(f"{self.path}/_versions/{name}")
            if text.endswith("}}"):  # else its writer died while it wrote it
                return int(names[-1]) + 1, name, json.loads(text)
        return int(names[-1]) + 1 if names else 0, "", {"folders": {}, "epochs": {}}

    def epoch(self, writer: str) -> int:
        """The last epoch of a writer that is in the table; -1 for none."""
        return self._version()[2]["epochs"].get(writer, -1)

    def _read(self, folders: dict[str, str], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._version()[2]["folders"])

    def upsert(self, new: DataFrame, order: str | None = None, writer: str = "", epoch: int | None = None) -> DataFrame:
        """The table after the rows of ``new`` were put in place by key, nested fields replaced whole.

        Of several new rows with a key the one with the highest ``order`` is taken, or,
        without an order, the one that sorts last by its own contents.
        """
        values = F.struct(*[F.col(f"`{c}`") for c in self.schema.names])
        rank = F.col(order) if order else F.to_json(values)
        dealt = [f"`{f.name}`" for f in self.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]  # the others have no hash
        new = new.repartition(*dealt)  # small files of many rows come in one task, which would sort all of them
        newest = new.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(values, rank).alias("_row")).select("_row.*")
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("_bucket")
        newest = cut(newest.select("*", bucket), "upsert")
        touched = [r["_bucket"] for r in newest.select("_bucket").distinct().collect()]
        for _ in range(TRIES):
            number, latest, version = self._version()
            if epoch is not None and version["epochs"].get(writer, -1) >= epoch:
                break
            before = self._read(version["folders"], touched).join(newest.select(self.key), self.key, "left_anti").select("*", bucket)
            folder = f"data-{uuid.uuid4().hex}"
            spread = F.pmod(F.xxhash64(F.lit(7), F.col(self.key)), F.lit(self.files_per_bucket)).alias("_file")
            after = before.select(*newest.columns).unionByName(newest).select("*", spread)
            after = after.hint("rebalance", "_bucket", "_file").drop("_file")  # a bucket too large for one task is split
            after.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            folders = version["folders"] | {str(b): folder for b in touched}
            epochs = version["epochs"] | ({writer: epoch} if epoch is not None else {})
            name = f"{number:010d}"
            still = lambda: self._version(below=name)[1] == latest  # noqa: B023, E731  a slow writer's file isn't whole now
            if self._files().create(f"{self.path}/_versions/{name}", json.dumps({"folders": folders, "epochs": epochs}), still):
                if self._files().names(f"{self.path}/_versions")[-1] == name:
                    break
                self._files().delete(f"{self.path}/_versions/{name}")  # it took too long: another writer went on without it
            self._files().delete(f"{self.path}/{folder}")
        else:
            raise RuntimeError("other writers took every version")
        discard(newest)
        return self.read()

    def vacuum(self) -> list[str]:
        """Remove the buckets that the newest version doesn't list, and older version files; no reader or writer may be under way."""
        files, (_, newest, version) = self._files(), self._version()
        used = {f"{folder}/_bucket={b}" for b, folder in version["folders"].items()}
        there = [f"{f}/{n}" for f in files.names(self.path) if f.startswith("data-") for n in files.names(f"{self.path}/{f}") if n.startswith("_bucket=")]
        gone = [n for n in there if n not in used] + [f"_versions/{n}" for n in files.names(f"{self.path}/_versions") if n < newest]
        for name in gone:
            files.delete(f"{self.path}/{name}")
        return gone


def keyed_table(rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
    """A new table that holds ``rows``."""
    table = KeyedTable(rows.sparkSession, path, key, rows.schema, buckets)
    table.upsert(rows)
    return table


def history_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The score history in ``path``; empty if there is none."""
    return spark.read.schema(schema).parquet(path).select(*schema.names) if Files(spark, path).names(path) else spark.createDataFrame([], schema)


def _tail(key: str, digits: int) -> Column:
    return F.right(F.col(key), F.lit(digits)).alias("_tail")


def unknown_scores(scores: DataFrame, path: str, key: str = "cache_key", digits: int = 2) -> DataFrame:
    """The scores whose key the history doesn't have, one a key. Of the history only the key column is read, in the folders of the scores' own tails."""
    spark, whole = scores.sparkSession, F.struct(*[F.col(f"`{c}`") for c in scores.columns])
    fresh = scores.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    fresh = cut(fresh.select("*", _tail(key, digits)), "scores-fresh")
    if not Files(spark, path).names(path):
        return fresh
    tails = [r["_tail"] for r in fresh.select("_tail").distinct().collect()]  # 16^digits at most
    there = spark.read.schema(StructType([scores.schema[key]]).add("_tail", "string")).parquet(path).filter(F.col("_tail").isin(tails))
    return fresh.join(there, ["_tail", key], "left_anti").select(*fresh.columns)


def append_scores(scores: DataFrame, path: str, key: str = "cache_key", digits: int = 2) -> DataFrame:
    """K4: the history in ``path``, after those scores were appended whose key it doesn't have. Appending the same scores again changes nothing.

    Keys end with a hexadecimal digest; the history is in folders by their last ``digits``.
    """
    unknown_scores(scores, path, key, digits).repartition("_tail").write.partitionBy("_tail").mode("append").parquet(path)
    return history_of(scores.sparkSession, path, scores.schema)


def append_payloads(rows: DataFrame, key: str, path: str, at: str, epoch: str | None = None) -> DataFrame:
    """K3: one JSON payload per row, appended. What an epoch has written before is replaced, so that a repeated one adds nothing."""
    out = rows.select(F.col(key).alias("company_id"), F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("payload"), F.lit(at).alias("fetched_at"))
    out.write.mode("overwrite").parquet(f"{path}/epoch={epoch or uuid.uuid4().hex}")
    return rows.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)


def write_pages(fetches: DataFrame, path: str) -> DataFrame:
    """Fetched pages (with expires_at) appended to the store in ``path``, in folders by the day on which they expire."""
    fetches.withColumn("_day", F.to_date("expires_at")).repartition("_day", F.pmod(F.xxhash64("url"), F.lit(8))).write.partitionBy("_day").mode("append").parquet(path)
    return fetches.sparkSession.read.schema(fetches.schema).parquet(path).select(*fetches.columns)


def purge_pages(spark: SparkSession, path: str, schema: StructType, as_of: dt.datetime) -> int:
    """Remove the pages that expired by ``as_of`` (in the session's time zone); how many they were.

    Folders of earlier days are dropped, that of the day itself is rewritten without
    them, later ones are not looked at. Pages without an expiry stay.
    """
    files, today = Files(spark, path), as_of.date().isoformat()
    days = [n for n in files.names(path) if n.startswith("_day=")]
    past = [n for n in days if n[5:] < today and n[5:].startswith(("0", "1", "2"))]
    removed = spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in past]).count() if past else 0
    if f"_day={today}" in days:
        rows = spark.read.schema(schema).parquet(f"{path}/_day={today}")
        kept = cut(rows.filter(F.col("expires_at") > F.lit(as_of)), "pages-kept")
        left = kept.count()
        if (gone := rows.count() - left) and left:
            kept.withColumn("_day", F.lit(as_of.date())).write.partitionBy("_day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        elif gone:
            past.append(f"_day={today}")
        removed += gone
    for name in past:
        files.delete(f"{path}/{name}")
    return removed
