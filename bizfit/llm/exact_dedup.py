"""Exact deduplication through an extendible-hash index kept in shared files.

Texts are equal when identical after lower-casing A-Z. Keys are 64-bit hashes. A
bucket is a run of leading bits of the key; a bucket over its capacity is split by one
more bit, which doubles the directory where needed, up to MAX_DEPTH bits. The
capacity grows with the number of keys, so that the directory has a bounded number of
slots at any size. Each owner task has neighbouring buckets, which are a range of
keys. A key that one row only has is filed as it is. The texts of keys that several
rows have go to the key's owner, which compares their bytes within the key: each
different text is an entry of the key's chain, with its rows counted and the largest
id taken. A key that holds a large share of the rows is combined within each task
first, so a group of copies sends one text a task. Entries are written as the index's
files, an owner's in key order; a row finds its entry by bucket, key and SHA-256.

Only DataFrame operations are used. Texts are read for the hashes, and those of
repeated keys a second time, which are shuffled once; other texts never are. Repeated
keys are broadcast up to BROADCAST_KEYS; beyond that, all texts go to the owners.

Nulls: a null text is the empty text; a null doc_id stays only where its group
has no other id. Rows that repeat both id and text all show the same result; of them
keep_exact keeps one. An empty table gives an empty result. Other columns, whatever
their names, are ignored, or kept by keep_exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizfit.llm.common import HOT_GROUPS, ascii_lower, join_groups
from bizfit.operators.shared import cut, fresh_path

MAX_DEPTH = 16
BUCKETS = 1 << 12
CAPACITY = 20_000
BROADCAST_KEYS = 1_000_000


@dataclass
class Directory:
    """slots: slot -> bucket, owner, as a small table; depth: bits of a slot; owners: number of owner tasks."""

    slots: DataFrame
    depth: int
    owners: int

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds bucket and owner to rows with a key."""
        return rows.withColumn("slot", slot(F.col("key"), self.depth)).join(F.broadcast(self.slots), "slot").drop("slot")


@dataclass
class Index:
    """path: the entry files, a folder an owner; entries: key, text_sha256, keep_id, group_size, chain, bucket, owner."""

    path: str
    directory: Directory
    entries: DataFrame


def slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split_buckets(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Leaves (first slot, slots, entries) of the directory: halve each bucket that is over its capacity.

    counts has the entries of each slot at full depth, at most 2**MAX_DEPTH numbers.
    """
    sums = [0]
    for i in range(1 << depth):
        sums.append(sums[-1] + counts.get(i, 0))
    leaves, open_ = [], [(0, 1 << depth)]
    while open_:
        first, width = open_.pop()
        n = sums[first + width] - sums[first]
        if n > capacity and width > 1:
            open_ += [(first + width // 2, width // 2), (first, width // 2)]
        else:
            leaves.append((first, width, n))
    return sorted(leaves)


def build_directory(keys: DataFrame, capacity: int) -> Directory:
    """The directory of a table with a row per key."""
    spark = keys.sparkSession
    counts = {r["slot"]: r["count"] for r in keys.groupBy(slot(F.col("key"), MAX_DEPTH).alias("slot")).count().collect()}  # 2**MAX_DEPTH rows at most
    leaves = split_buckets(counts, MAX_DEPTH, max(capacity, sum(counts.values()) // BUCKETS))
    depth = max(MAX_DEPTH - (w.bit_length() - 1) for _, w, _ in leaves)
    shrink = 1 << (MAX_DEPTH - depth)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share, taken, slots = max(1, -(-sum(counts.values()) // owners)), 0, []
    for bucket, (first, width, n) in enumerate(leaves):
        slots += [(s, bucket, min(owners - 1, taken // share)) for s in range(first // shrink, (first + width) // shrink)]
        taken += n
    return Directory(spark.createDataFrame(slots, "slot long, bucket int, owner int"), depth, owners)


def keyed(docs: DataFrame, doc_id: str, text: str, key: Callable[[Column], Column]) -> DataFrame:
    """row (all columns), doc_id, body (the text as it is compared) and key."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), ascii_lower(F.col(text)).alias("body")).withColumn("key", key(F.col("body")))


def chains(rows: DataFrame, keys: DataFrame, directory: Directory, best: Column) -> DataFrame:
    """key, body, keep, group_size and chain of each text of the keys in ``keys`` (key, n), by comparing bytes at the key's owner.

    Copies of a hot key are combined within their tasks before they move; there are at
    most HOT_GROUPS such keys.
    """
    total = rows.count()
    hot = F.broadcast(keys.filter(F.col("n") > max(100, total // HOT_GROUPS)).select("key"))

    def entries(members: DataFrame, by: list[str]) -> DataFrame:
        found = members.groupBy(*by, "body").agg(best.alias("keep"), F.count("*").alias("group_size"))
        return found.select("key", "body", "keep", "group_size", F.row_number().over(Window.partitionBy(*by).orderBy("body")).alias("chain"))

    cold = directory.place(rows.join(hot, "key", "left_anti")).repartition(directory.owners, "owner")
    return entries(cold, ["owner", "bucket", "key"]).unionByName(entries(rows.join(hot, "key"), ["key"]))


def split_repeated(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key needs its bytes compared, the others): all rows and None if there are too many repeated keys to broadcast."""
    repeated = keys.filter("n > 1").select("key")
    if repeated.count() > BROADCAST_KEYS:
        return rows, None
    return rows.join(F.broadcast(repeated), "key", "left_semi"), rows.join(F.broadcast(repeated), "key", "left_anti")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> tuple[Index, DataFrame]:
    """The index of ``docs``, written, and the rows' doc_id, key and text_sha256."""
    spark, whole = docs.sparkSession, keyed(docs, doc_id, text, key)
    rows = cut(whole.select("doc_id", "key", F.sha2("body", 256).alias("text_sha256")), "exact-rows")
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "exact-keys")
    directory = build_directory(keys, capacity)
    members, others = split_repeated(whole, keys)
    found = chains(members, keys, directory, F.max("doc_id")).select("key", F.sha2("body", 256).alias("text_sha256"), F.col("keep").alias("keep_id"), "group_size", "chain")
    if others is not None:
        found = found.unionByName(keys.filter("n = 1").select("key", "text_sha256", "keep_id", F.col("n").alias("group_size"), F.lit(1).alias("chain")))
    path = fresh_path(spark, "exact-index")
    placed = directory.place(found).repartition(directory.owners, "owner").sortWithinPartitions("owner", "bucket", "key", "chain")
    placed.write.partitionBy("owner").parquet(path)
    schema = f"key long, text_sha256 string, keep_id {dict(rows.dtypes)['doc_id']}, group_size long, chain int, bucket int, owner int"
    return Index(path, directory, spark.read.schema(schema).parquet(path)), rows


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    index, rows = build_index(docs, doc_id, text, capacity, key)
    found = join_groups(index.directory.place(rows).drop("owner"), index.entries.drop("owner", "chain"), ["bucket", "key", "text_sha256"], "group_size", rows.count())
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeating id and text, one.

    Rows whose key nobody shares aren't moved.
    """
    whole = keyed(docs, doc_id, text, F.xxhash64)
    keys = cut(whole.select("key").groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    members, others = split_repeated(whole, keys)
    stay = chains(members, keys, build_directory(keys, capacity), F.max_by("row", F.struct("doc_id"))).select("keep.*")
    return stay if others is None else stay.unionByName(others.select("row.*"))
