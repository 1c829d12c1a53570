"""Search filters, ranking modes, paging, history and overlays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bizfit.operators.shared import cut


@dataclass(frozen=True)
class Filters:
    q: str | None = None
    industry: str | None = None
    city: str | None = None
    business_type: str | None = None
    has_employees: bool | None = None
    min_age: int | None = None


def predicate(f: Filters, as_of_year: int) -> Column:
    """All filters as one condition that reaches the scan. Terms are literal; null columns never match."""
    parts: list[Column] = []
    for term in (f.q or "").lower().split():
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in ("name", "city", "industry")]))
    for column in ("industry", "city", "business_type"):
        value = getattr(f, column)
        if value:
            parts.append(F.lower(column) == value.lower())
    if f.has_employees is not None:
        parts.append(F.col("has_employees") == f.has_employees)
    if f.min_age is not None:
        parts.append(F.col("founded_year") <= as_of_year - f.min_age)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(companies: DataFrame, filters: Filters, as_of_year: int) -> DataFrame:
    return companies.filter(predicate(filters, as_of_year))


def min_score(scored: DataFrame, least: float) -> DataFrame:
    """over stored scores this is pushed to the scan."""
    return scored.filter(F.col("score") >= least)


def lookup(companies: DataFrame, id_: str) -> DataFrame:
    """F6."""
    return companies.filter(F.col("id") == id_)


def page(scored: DataFrame, offset: int, limit: int) -> DataFrame:
    """A slice of the ranking; ties in order of the id. total counts all rows before the slice."""
    total = scored.agg(F.count("*").alias("total"))
    return scored.orderBy(F.desc("score"), F.asc("id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def sort_modes(scored: DataFrame, mode: str) -> DataFrame:
    """By name (in a locale's order without regard to case, digit runs as numbers), coverage or score; ties by score, then id."""
    name = F.regexp_replace(F.regexp_replace("name", r"(\d+)", "000000000000000000$1"), r"0+(\d{18})", "$1")
    lead = {"name": [F.asc(F.collate(name, "UNICODE_CI"))], "coverage": [F.desc("covered_weight")], "score": []}[mode]
    return scored.orderBy(*lead, F.desc("score"), F.asc("id"))


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted rows with ``place``, from 1: numbered within the sorted parts, each of which starts after those before it, so no rows meet in one task."""
    dealt = cut(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_k")), "in-order")
    ends = dealt.groupBy("_part").agg(F.min("_k").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    starts = F.broadcast(ends.select("_part", "_low", F.coalesce(before, F.lit(0)).alias("_before")))
    return dealt.join(starts, "_part").withColumn("place", F.col("_before") + F.col("_k") - F.col("_low") + 1).drop("_part", "_k", "_low", "_before")


@dataclass(frozen=True)
class Ranking:
    """A ranking that is kept for paging: rows with their place, in folders of ``slab`` places each.

    A page reads the folders of its own places only, however deep it is. The last place
    of a page is the key from which the next one goes on.
    """

    spark: SparkSession
    path: str
    schema: StructType
    slab: int = 100_000

    def _read(self, first: int, last: int) -> DataFrame:
        rows = self.spark.read.schema(StructType([*self.schema]).add("place", "long").add("_slab", "long")).parquet(self.path)
        slabs = list(range((first - 1) // self.slab, (last - 1) // self.slab + 1))
        return rows.filter(F.col("_slab").isin(slabs) & F.col("place").between(first, last)).drop("_slab")

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows of places offset + 1 to offset + limit, in order."""
        return self._read(offset + 1, offset + max(limit, 1)).filter(F.lit(limit > 0)).orderBy("place")

    def after(self, place: int, limit: int) -> DataFrame:
        return self.page(place, limit)


def keep_ranking(ranked: DataFrame, path: str, slab: int = 100_000) -> Ranking:
    """Write sorted rows for paging."""
    placed = in_order(ranked).withColumn("_slab", ((F.col("place") - 1) / slab).cast("long"))
    placed.repartition("_slab").sortWithinPartitions("_slab", "place").write.partitionBy("_slab").parquet(path)
    return Ranking(ranked.sparkSession, path, ranked.schema, slab)


def select_ids(companies: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The rows with these ids; None means all."""
    return companies if ids is None else companies.join(ids, "id", "left_semi")


def overlay(base: DataFrame, refreshed: DataFrame, order: str) -> DataFrame:
    """Each row replaced by its newest refreshed version (by ``order``), if it has one."""
    columns = [c for c in base.columns if c != "id"]
    newest = refreshed.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("_new"))
    joined = base.join(newest, "id", "left")
    return joined.select("id", *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in columns])


def history(companies: DataFrame, scores: DataFrame) -> DataFrame:
    """The scores of companies that exist, newest first."""
    return scores.join(companies.select("id"), scores["company_id"] == companies["id"], "left_semi").orderBy("company_id", F.desc("scored_at"))
