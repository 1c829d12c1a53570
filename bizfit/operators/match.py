"""Entity resolution: standard keys, blocking, pair verdicts, components and survivors; source merging.

``pos`` is a row's place in source order, unique and long; "first" means lowest pos.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from bizfit.functions import columns as C
from bizfit.operators.graph import connected_components
from bizfit.operators.shared import cut, spread

LARGEST_BLOCK = 50
SAME_PREMISES_KM = 0.75
SAME_DOMAIN, NEAR_NAME, NAME_AND_PLACE = 60.0, 90.0, 80.0


def standardise(companies: DataFrame) -> DataFrame:
    """Adds key columns; nothing is overwritten."""
    site = F.coalesce(C.blank(F.col("website")), F.col("domain"))
    return spread(companies).withColumns({
        "key_domain": C.domain(site), "key_reg_domain": C.registrable(site), "key_name": C.name_core(F.col("name")),
        "key_block_name": C.block_name(F.col("name")), "key_postcode": C.postcode5(F.col("postcode")),
    })


def blocking_keys(rows: DataFrame) -> DataFrame:
    """Adds block_keys, the distinct keys under which a standardised row may meet its duplicate."""
    mail = F.transform("contacts", lambda c: C.email_domain(c["email"]))
    mail = F.filter(mail, lambda d: F.contains(d, F.lit(".")) & ~d.eqNullSafe(F.col("key_reg_domain")))
    phone = F.filter(F.transform("contacts", lambda c: C.phone10(c["phone"])), lambda p: p.isNotNull())
    city, code, name = C.blank(F.col("city")), F.col("key_postcode"), F.nullif(F.col("key_block_name"), F.lit(""))
    named = lambda tail: F.lower(F.concat(F.lit("n:"), name, F.lit(":"), tail))
    single = F.array(F.concat(F.lit("d:"), F.col("key_reg_domain")), named(code), named(city), F.when(code.isNull() & city.isNull(), named(F.lit(""))))
    keys = F.concat(single, F.transform(mail, lambda d: F.concat(F.lit("e:"), d)), F.transform(phone, lambda p: F.concat(F.lit("p:"), p)))
    return rows.withColumn("block_keys", F.array_distinct(F.array_compact(keys)))


#: What a pair is judged by.
COMPARED = ["key_name", "key_reg_domain", "key_postcode", "city", "latitude", "longitude"]


def blocked(companies: DataFrame) -> DataFrame:
    """pos, block_keys and what pairs are judged by, written once: pairs read it five times, and unfolding keys from files computes none of them again."""
    return cut(blocking_keys(standardise(companies)).select("pos", "block_keys", *COMPARED), "block-keys")


def block_sizes(rows: DataFrame) -> DataFrame:
    """Block and its rows; only blocks of 2 to LARGEST_BLOCK are compared."""
    return rows.select(F.explode("block_keys").alias("block")).groupBy("block").agg(F.count("*").alias("members"))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b, by pos) that share a block of permitted size.

    The size rule comes before the self-join, so no block yields over 1,225 pairs.
    """
    keyed = rows.select("pos", F.explode("block_keys").alias("block"))
    sized = block_sizes(rows).filter(F.col("members").between(2, LARGEST_BLOCK)).select("block")
    kept = keyed.join(sized, "block")
    left, right = kept.select("block", F.col("pos").alias("a")), kept.select("block", F.col("pos").alias("b"))
    return left.join(right, "block").filter("a < b").select("a", "b").distinct()


#: Characters whose counts bound a similarity from above; all others count together.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
WORD = 64


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b) of the space-joined sorted tokens, the LCS found bit-parallel."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of up to WORD characters, a row each; 0 behind the end."""
    return np.frombuffer("".join(t.ljust(WORD, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(-1, WORD)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """token_sort_ratio() of many pairs: the same recurrence on one machine word a pair, all pairs a step together; longer texts one by one."""
    a, b = ([" ".join(sorted(x.split())) for x in side] for side in (a, b))
    out = np.array([token_sort_ratio(x, y) if max(len(x), len(y)) > WORD or "\0" in x + y else 0.0 for x, y in zip(a, b, strict=True)])
    short = np.array([max(len(x), len(y)) <= WORD and "\0" not in x + y for x, y in zip(a, b, strict=True)], bool)
    x, y = ([t for t, s in zip(side, short, strict=True) if s] for side in (a, b))
    if not x:
        return out
    p, q = _codes(x), _codes(y)
    n, m = (np.array([len(t) for t in side]) for side in (x, y))
    bits = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
    s = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)  # a bit is 1 until its character is part of the subsequence
    for k in range(int(m.max())):
        there = ((p == q[:, k : k + 1]) & (k < m)[:, None]) @ bits
        u = s & there
        s = (s + u) | (s - u)
    inside = np.where(n == WORD, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(n, WORD - 1).astype(np.uint64)) - np.uint64(1))
    common = n - np.bitwise_count(s & inside).astype(np.int64)
    out[short] = np.where(n + m > 0, 200.0 * common / np.maximum(n + m, 1), 100.0)
    return out


def name_similarity(a: str, b: str) -> Column:
    """An Arrow UDF over candidate pairs only, which share a block of at most LARGEST_BLOCK rows."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = a.fillna(""), b.fillna("")
        return pd.Series(np.concatenate([token_sort_ratios(*(list(x[k : k + 4096]) for x in pairs)) for k in range(0, len(a), 4096)] or [np.zeros(0)]))

    return F.pandas_udf(ratios, "double", PandasUDFType.SCALAR)(a, b)


def letter_counts(name: Column) -> Column:
    """How often each of COUNTED occurs in a name, and last how many characters are none of them."""
    bare = F.translate(name, COUNTED, "")
    return F.array(*[F.char_length(name) - F.char_length(F.replace(name, F.lit(c), F.lit(""))) for c in COUNTED], F.char_length(bare))


def most_similar(a: Column, b: Column) -> Column:
    """No name similarity of two names with these letter counts is higher, as what they have in common can't be more than their letters."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    length = total(a) + total(b)
    return F.when(length > 0, 200.0 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / length).otherwise(100.0)


def judged_pairs(rows: DataFrame) -> DataFrame:
    """A, b, similarity, reason of each accepted pair; reason is that of the first rule that holds.

    Only pairs that could reach what their rule asks for, by their letters alone, are compared.
    """
    rows = rows.select("pos", "block_keys", *COMPARED, letter_counts(F.coalesce("key_name", F.lit(""))).alias("letters"))
    side = lambda p: rows.select(F.col("pos").alias(p), *[F.col(k).alias(f"{k}_{p}") for k in (*COMPARED, "letters")])
    pairs = candidate_pairs(rows).join(side("a"), "a").join(side("b"), "b")
    apart = C.haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b")) > SAME_PREMISES_KM
    pairs = pairs.filter(~F.coalesce(apart, F.lit(False)))
    same = lambda k: F.coalesce(F.col(f"{k}_a") == F.col(f"{k}_b"), F.lit(False))
    place = same("key_postcode") | F.coalesce((F.lower("city_a") == F.lower("city_b")) & (F.col("city_a") != ""), F.lit(False))
    asked = F.when(same("key_reg_domain"), SAME_DOMAIN).when(place, NAME_AND_PLACE).otherwise(NEAR_NAME)
    pairs = pairs.filter(most_similar(F.col("letters_a"), F.col("letters_b")) >= asked)
    pairs = pairs.withColumn("similarity", name_similarity("key_name_a", "key_name_b"))
    s = F.col("similarity")
    reason = (
        F.when((F.col("key_reg_domain_a") == F.col("key_reg_domain_b")) & (s >= SAME_DOMAIN), F.concat(F.lit("same domain ("), "key_reg_domain_a", F.lit(")")))
        .when(s >= NEAR_NAME, "near-identical name")
        .when((s >= NAME_AND_PLACE) & (F.col("key_postcode_a") == F.col("key_postcode_b")), F.concat(F.lit("similar name at the same postcode ("), "key_postcode_a", F.lit(")")))
        .when((s >= NAME_AND_PLACE) & (F.lower("city_a") == F.lower("city_b")) & (F.col("city_a") != ""), F.concat(F.lit("similar name in the same city ("), "city_a", F.lit(")")))
    )
    return pairs.select("a", "b", "similarity", reason.alias("reason")).filter("reason IS NOT NULL")


def completeness() -> Column:
    """(contact fields filled, crawled, fields filled), compared in this order."""
    full = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    contacts = F.aggregate("contacts", F.lit(0), lambda s, c: s + full(c["email"]) + full(c["phone"]) + full(c["name"]))
    fields = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in ("website", "industry", "city", "postcode", "founded_year", "employee_count")])
    return F.struct(F.coalesce(contacts, F.lit(0)).alias("contact_fields"), F.col("web")["fetched_at"].isNotNull().cast("int").alias("crawled"), fields.alias("fields"))


#: What a survivor learns from the others, besides coordinates, contacts and the page's signals.
FILLED = ["website", "domain", "industry", "naics", "city", "state", "postcode", "founded_year", "employee_count", "revenue_usd", "peer_count_in_niche"]


def dedupe(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving rows in source order, one audit row per merged row).

    The survivor is the most complete member, ties to the earliest. Missing scalars
    are filled from members in source order, the coordinates as one pair, contacts
    and web taken whole. Only members of groups are regrouped; other rows pass.
    """
    rows = blocked(companies)
    edges = cut(judged_pairs(rows), "dedupe-edges")
    groups = cut(connected_components(edges, "a", "b", within_tasks=True), "dedupe-groups").withColumnRenamed("node", "pos").withColumnRenamed("component", "group")
    grouped = companies.join(groups, "pos")
    alone = companies.join(groups.select("pos"), "pos", "left_anti")
    order, filled = F.col("pos"), [c for c in FILLED if c in companies.columns]
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), order))
    best = F.struct(completeness().alias("k"), (-order).alias("p"))
    where = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude"))
    some = F.when(F.size("contacts") > 0, F.col("contacts"))
    crawled = F.when(F.col("web")["fetched_at"].isNotNull(), F.col("web"))
    merged = grouped.groupBy("group").agg(
        F.max_by(F.struct(*companies.columns), best).alias("top"), *[first(F.col(c)).alias(f"_{c}") for c in filled],
        first(where).alias("_where"), first(some).alias("_contacts"), first(crawled).alias("_web"),
    )
    top = F.col("top")
    fill = {c: F.coalesce(top[c], F.col(f"_{c}")) for c in filled}
    has_place = top["latitude"].isNotNull() & top["longitude"].isNotNull()
    fill |= {c: F.when(has_place, top[c]).otherwise(F.coalesce(F.col("_where")[c], top[c])) for c in ("latitude", "longitude")}
    fill |= {"contacts": F.when(F.size(top["contacts"]) > 0, top["contacts"]).otherwise(F.coalesce("_contacts", top["contacts"])), "web": F.when(top["web"]["fetched_at"].isNotNull(), top["web"]).otherwise(F.coalesce("_web", top["web"]))}
    out = merged.select(*[fill.get(c, top[c]).alias(c) for c in companies.columns])
    kept = merged.select("group", top["id"].alias("kept_id"), top["pos"].alias("kept_pos"))
    lost = grouped.select("group", "pos", F.col("id").alias("dropped_id")).join(kept, "group").filter("pos <> kept_pos")
    both = edges.select(F.col("a").alias("pos"), "similarity", "reason").unionByName(edges.select(F.col("b").alias("pos"), "similarity", "reason"))
    why = both.groupBy("pos").agg(F.max(F.struct("similarity", "reason")).alias("why"))
    audit = lost.join(why, "pos").select("kept_id", "dropped_id", F.col("why.reason").alias("reason"), F.round("why.similarity", 1).alias("similarity"))
    return out.unionByName(alone.select(*companies.columns)), audit


def merge_sources(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Fill website and coordinates of the first primary row per (name core, city) from secondary rows; keep unmatched secondary rows.

    Adds enriched_by, the number of secondary rows with the key.
    """
    key = lambda df: df.withColumns({"_kn": C.name_core(F.col("name")), "_kc": F.coalesce(F.upper(F.trim("city")), F.lit(""))})
    p, s = key(primary), key(secondary)
    where = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude"))
    gives = s.groupBy("_kn", "_kc").agg(
        F.min_by(C.blank(F.col("website")), F.when(C.blank(F.col("website")).isNotNull(), F.col("pos"))).alias("_site"), F.min_by(where, F.when(where.isNotNull(), F.col("pos"))).alias("_place"), F.count("*").alias("_n")
    )
    first = p.groupBy("_kn", "_kc").agg(F.min("pos").alias("pos"))
    joined = p.join(first.join(gives, ["_kn", "_kc"]).select("pos", "_site", "_place", "_n"), "pos", "left")
    bare = F.col("latitude").isNull() | F.col("longitude").isNull()
    out = joined.withColumns({
        "website": F.coalesce(C.blank(F.col("website")), "_site"), "enriched_by": F.coalesce("_n", F.lit(0)),
        "latitude": F.when(bare, F.coalesce(F.col("_place.latitude"), F.col("latitude"))).otherwise(F.col("latitude")),
        "longitude": F.when(bare, F.coalesce(F.col("_place.longitude"), F.col("longitude"))).otherwise(F.col("longitude")),
    })
    rest = s.join(first, ["_kn", "_kc"], "left_anti").withColumn("enriched_by", F.lit(0).cast("long"))
    drop = ["_kn", "_kc", "_site", "_place", "_n"]
    return out.drop(*drop).unionByName(rest.drop(*drop), allowMissingColumns=True)


def attach_principal(companies: DataFrame, principals: DataFrame) -> DataFrame:
    """Name and title of the licence's principal on the first contact, if there is a contact."""
    p = principals.select("licence_number", F.col("person").alias("_person"), F.col("person_title").alias("_title"))
    joined = companies.join(p, "licence_number", "left")
    first = F.get("contacts", F.lit(0))
    named = first.withField("name", F.col("_person")).withField("title", F.col("_title")).withField("is_decision_maker", F.lit(True))
    contacts = F.concat(F.array(named), F.slice("contacts", F.lit(2), F.greatest(F.size("contacts") - 1, F.lit(0))))
    set_it = F.col("_person").isNotNull() & (F.size("contacts") > 0)
    return joined.withColumn("contacts", F.when(set_it, contacts).otherwise(F.col("contacts"))).drop("_person", "_title")


def first_sighting(rows: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")
