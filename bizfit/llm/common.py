"""What several of the training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizfit.operators.shared import cut

HOT_GROUPS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo parts; a null id hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(first, rows) of parts of a column with about ``most`` bytes."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    first, total = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > first and total + n > most:
            yield first, k - first
            first, total = k, 0
        total += n
    if len(size):
        yield first, len(size) - first


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups, where one group may hold any share of the rows.

    ``groups`` has one row per key with the number of its rows in ``size``. At
    most HOT_GROUPS groups can hold over total/HOT_GROUPS rows each, so those are
    broadcast; the others are joined by a shuffle in which no key is large.
    """
    limit = max(100, total // HOT_GROUPS)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    there = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(there, keys, "left_anti").join(cold, keys))


def relabel(rows: DataFrame, labels: DataFrame, column: str, label: str, total: int) -> DataFrame:
    """rows with ``column`` replaced by its ``label`` in ``labels`` (column, label), where there is one; one value may hold any share of the rows."""
    sizes = rows.groupBy(column).agg(F.count("*").alias("_size")).join(labels.withColumnRenamed(label, "_label"), column, "left")
    sizes = cut(sizes.select(column, "_size", F.coalesce("_label", column).alias("_label")), "relabel")
    return join_groups(rows, sizes, [column], "_size", total).withColumn(column, F.col("_label")).drop("_size", "_label")
