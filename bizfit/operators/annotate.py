"""Neighbourhood facts, quality, facets, distributions and the stratified sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators.score import primary_contact
from bizfit.operators.shared import cut

RADIUS_KM = 15.0
CHAIN = 3


#: Fine cells to a radius, and the share by which coarse cells are wider than it, so that a fine cell's centre stands for it.
FINER = 8


def _bands(step: float) -> tuple:
    """(band of a latitude, cells of a band, cell of a longitude) of a grid of cells at least ``step`` degrees of latitude wide."""
    edge = lambda band: F.least(F.greatest(F.abs(band * step), F.abs((band + 1) * step)), F.lit(90.0))
    cells = lambda band: F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(edge(band))) / step), F.lit(1))
    return (lambda lat: F.floor(lat / step).cast("long")), cells, (lambda lon, n: F.floor((lon + 180.0) * n / 360.0))


def radius_counts(points: DataFrame, group: str, radius_km: float = RADIUS_KM) -> DataFrame:
    """For each distinct (group, latitude, longitude), the rows of the group within the radius, itself included.

    Equal points are counted first, and points are gathered in fine cells, an eighth of
    the radius wide. Cells meet through a coarse grid, of which each probes three bands
    and five cells, wrapped round the globe. Of two cells that are surely within the
    radius, only counts are added; only points of cells on the rim are compared.
    """
    degree = math.degrees(radius_km / C.EARTH_KM) * 1.000001
    band, cells, cell = _bands(degree / FINER)
    at = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(group).isNotNull())
    at = at.groupBy(F.col(group).alias("_g"), "latitude", "longitude").agg(F.count("*").alias("n")).withColumn("_b", band(F.col("latitude")))
    at = cut(at.withColumn("_c", F.pmod(cell(F.col("longitude"), cells(F.col("_b"))), cells(F.col("_b")))), "peer-points")

    low, high = F.col("_b") * (degree / FINER), (F.col("_b") + 1) * (degree / FINER)
    width = F.lit(360.0) / cells(F.col("_b"))
    widest = F.cos(F.radians(F.when(low * high <= 0, 0.0).otherwise(F.least(F.abs(low), F.abs(high)))))
    reach = F.lit(C.EARTH_KM) * F.radians((high - low) / 2 + F.least(width / 2 * widest, F.lit(90.0)))  # no point is farther from the centre
    boxes = at.groupBy("_g", "_b", "_c").agg(F.sum("n").alias("n")).select("_g", "_b", "_c", "n", ((low + high) / 2).alias("lat"), ((F.col("_c") + 0.5) * width - 180.0).alias("lon"), reach.alias("reach"))
    band2, cells2, cell2 = _bands(degree * (1 + 4 / FINER))
    boxes = cut(boxes.withColumn("_wide", band2(F.col("lat"))).withColumn("_at", F.pmod(cell2(F.col("lon"), cells2(F.col("_wide"))), cells2(F.col("_wide")))), "peer-cells")
    probe = boxes.drop("_at", "n").withColumn("_wide", F.explode(F.array(F.col("_wide") - 1, F.col("_wide"), F.col("_wide") + 1)))
    n, middle = cells2(F.col("_wide")), cell2(F.col("lon"), cells2(F.col("_wide")))
    # near the poles a band's cells are wider than they need be, so two to each side are enough
    probe = probe.withColumn("_at", F.explode(F.array_distinct(F.array(*[F.pmod(middle + d, n) for d in (-2, -1, 0, 1, 2)]))))
    other = boxes.select("_g", "_wide", "_at", *[F.col(c).alias(f"{c}2") for c in ("_b", "_c", "n", "lat", "lon", "reach")])
    apart, slack = C.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), F.col("reach") + F.col("reach2") + 1e-6
    pairs = probe.join(other, ["_g", "_wide", "_at"]).withColumn("apart", apart).filter(F.col("apart") - slack <= radius_km)
    pairs = cut(pairs.select("_g", "_b", "_c", "_b2", "_c2", "n2", (F.col("apart") + slack <= radius_km).alias("whole")), "peer-pairs")
    inner = pairs.filter("whole").groupBy("_g", "_b", "_c").agg(F.sum("n2").alias("inner"))
    right = at.select("_g", *[F.col(c).alias(f"{c}2") for c in ("_b", "_c")], F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), F.col("n").alias("m"))
    rim = at.join(pairs.filter("NOT whole").drop("n2", "whole"), ["_g", "_b", "_c"]).join(right, ["_g", "_b2", "_c2"])
    rim = rim.filter(C.haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) <= radius_km)
    rim = rim.groupBy("_g", "latitude", "longitude").agg(F.sum("m").alias("rim"))
    out = at.join(inner, ["_g", "_b", "_c"], "left").join(rim, ["_g", "latitude", "longitude"], "left")
    total = F.coalesce("inner", F.lit(0)) + F.coalesce("rim", F.lit(0))
    return out.select(F.col("_g").alias(group), "latitude", "longitude", total.alias("within"))


def peer_density(companies: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """A1: sets peer_count_in_niche: same industry within the radius, or at the postcode where a row has no coordinates.

    A row without an industry, or with neither place, keeps the count that it has, which is null unless it came with one.
    """
    had = F.col("peer_count_in_niche") if "peer_count_in_niche" in companies.columns else F.lit(None)
    rows = companies.withColumn("_had", had.cast("long")).drop("peer_count_in_niche").withColumns({"_industry": C.blank(F.col("industry")), "_code": C.postcode5(F.col("postcode"))})
    near = radius_counts(rows, "_industry", radius_km)
    by_code = rows.filter("_code IS NOT NULL").groupBy("_industry", "_code").agg(F.count("*").alias("_there"))
    out = rows.join(near, ["_industry", "latitude", "longitude"], "left").join(by_code, ["_industry", "_code"], "left")
    return out.withColumn("peer_count_in_niche", F.coalesce(F.col("within") - 1, F.col("_there") - 1, "_had")).drop("within", "_there", "_industry", "_code", "_had")


def peers_unmeasured(annotated: DataFrame) -> DataFrame:
    """Number of rows without a peer count."""
    return annotated.agg(F.count_if(F.col("peer_count_in_niche").isNull()).alias("unmeasured"))


def chain_locations(companies: DataFrame) -> DataFrame:
    """A2: sets sibling_location_count, the distinct premises under the row's name core; coordinates to three places, else the row itself."""
    place = F.coalesce(F.concat_ws(",", F.format_number(F.round("latitude", 3), 3), F.format_number(F.round("longitude", 3), 3)), F.col("id"))
    place = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place).otherwise(F.col("id"))
    rows = companies.drop("sibling_location_count").withColumn("_key", C.name_core(F.col("name")))
    counts = rows.select("_key", place.alias("_place")).groupBy("_key").agg(F.count_distinct("_place").alias("sibling_location_count"))
    return rows.join(counts, rows["_key"].eqNullSafe(counts["_key"])).drop("_key")


def chain_flag_count(annotated: DataFrame) -> DataFrame:
    """A3: number of rows in chains."""
    return annotated.agg(F.count_if(F.col("sibling_location_count") >= CHAIN).alias("in_chains"))


def _quality_checks() -> list[tuple[float, str, Column]]:
    """Weights and gap texts, in the order of the checklist."""
    best = primary_contact()
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    return [
        (0.20, "no phone number", text(best["phone"])),
        (0.10, "phone not validated", F.coalesce(best["phone_valid"], F.lit(False))),
        (0.15, "no email address", text(best["email"])),
        (0.10, "email unverified", F.coalesce(best["email_status"] == "verified", F.lit(False))),
        (0.15, "no named owner", F.exists("contacts", lambda c: F.coalesce(c["is_decision_maker"], F.lit(False)) & text(c["name"]))),
        (0.10, "no website", text(F.col("website"))),
        (0.05, "website not crawled", F.col("web")["fetched_at"].isNotNull()),
        (0.05, "no ownership form", text(F.col("business_type"))),
        (0.05, "no founding or licence date", (F.coalesce("founded_year", F.lit(0)) != 0) | F.col("licence_issued").isNotNull()),
        (0.05, "no postcode or coordinates", text(F.col("postcode")) | F.col("latitude").isNotNull()),
    ]


def quality(companies: DataFrame) -> DataFrame:
    """A4: adds data_quality (0-100) and quality_issues, the heaviest gap first."""
    checks = [(w, gap, F.coalesce(ok, F.lit(False))) for w, gap, ok in _quality_checks()]
    earned = F.lit(0.0)
    for w, _, ok in checks:
        earned = earned + F.when(ok, w).otherwise(0.0)
    gaps = F.array_compact(F.array(*[F.when(~ok, gap) for w, gap, ok in sorted(checks, key=lambda c: -c[0])]))
    return companies.withColumns({"data_quality": F.round(earned * 100, 1), "quality_issues": gaps})


def facets(companies: DataFrame) -> DataFrame:
    """A5: one row: row count and the sorted distinct values to filter by; their number is that of a menu's entries."""
    values = lambda c: F.array_sort(F.collect_set(C.blank(F.col(c)))).alias(c)
    return companies.agg(F.count("*").alias("companies"), values("industry"), values("city"), values("business_type"))


def order_statistics(rows: DataFrame, column: str) -> DataFrame:
    """Min, element n/4, n/2, 3n/4 and max of a column in ascending order, counted from 0.

    Values are counted first, dealt by range and counted up within their range; each
    range starts after what the ranges before it hold.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange("v").withColumn("_range", F.spark_partition_id()), "statistics")
    held = dealt.groupBy("_range").agg(F.sum("n").alias("_held"))
    before = F.sum("_held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = held.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_sum", F.sum("n").over(Window.partitionBy("_range").orderBy("v")))
    run = inside.join(F.broadcast(starts), "_range").withColumn("upto", F.col("_start") + F.col("_sum"))
    total = dealt.agg(F.sum("n").alias("total"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    t = F.col("total")
    return run.crossJoin(F.broadcast(total)).agg(
        F.min("v").alias("low"), at(F.floor(t / 4)).alias("quarter"), at(F.floor(t / 2)).alias("median"), at(F.floor(t * 3 / 4)).alias("three_quarters"), F.max("v").alias("high")
    )


def trade_counts(companies: DataFrame) -> DataFrame:
    """Rows per industry, the most first."""
    return companies.groupBy("industry").agg(F.count("*").alias("companies")).orderBy(F.desc("companies"), "industry")


def stratified_sample(companies: DataFrame, limit: int) -> DataFrame:
    """``limit`` rows, by trade in proportion: rows with a website first, then evenly spaced others; topped up in source order.

    Ranks within a trade are counted in blocks of source order, so that a trade with
    most of the rows is not sorted in one task: each block's start is the sum of the
    blocks before it.
    """
    rows = companies.select("id", "pos", F.coalesce(C.blank(F.col("industry")), F.lit("Unknown")).alias("trade"), C.blank(F.col("website")).isNotNull().alias("site"))
    per_trade = rows.groupBy("trade").agg(F.count("*").alias("n"), F.count_if("site").alias("sites"), F.min("pos").alias("first"))
    total = per_trade.agg(F.sum("n").alias("total"))
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(limit)) * F.col("n") / F.col("total")).cast("long"))
    plan = per_trade.crossJoin(F.broadcast(total)).withColumn("quota", quota)
    left = F.greatest(F.col("quota") - F.col("sites"), F.lit(0))
    plan = plan.withColumns({"left": left, "step": F.greatest(F.lit(1), F.floor((F.col("n") - F.col("sites")) / F.nullif(left, F.lit(0))))})
    plan = plan.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n"), "first")))  # a row per trade
    block = F.floor(F.col("pos") / 65536)
    inside = rows.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy("trade", "site", "block").orderBy("pos")))
    starts = inside.groupBy("trade", "site", "block").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("trade", "site").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    placed = inside.join(starts.select("trade", "site", "block", F.coalesce(before, F.lit(0)).alias("before")), ["trade", "site", "block"])
    k = F.col("before") + F.col("r") - 1
    chosen = placed.join(F.broadcast(plan.select("trade", "quota", "left", "step", "turn")), "trade").withColumn("k", k)
    spaced = ~F.col("site") & (F.col("k") % F.col("step") == 0) & (F.col("k") / F.col("step") < F.col("left"))
    picked = (F.col("site") & (F.col("k") < F.col("quota"))) | F.coalesce(spaced, F.lit(False))
    order = F.when(picked, F.col("turn")).otherwise(F.lit(1 << 40)), F.when(picked, (~F.col("site")).cast("int")).otherwise(0), F.col("pos")
    few = chosen.select("id", order[0].alias("o1"), order[1].alias("o2"), F.col("pos").alias("o3")).orderBy("o1", "o2", "o3").limit(limit)
    return companies.join(F.broadcast(few) if limit <= 100_000 else few, "id")
