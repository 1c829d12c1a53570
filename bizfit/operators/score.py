"""Explainable scoring: six factors, each with evidence, missing signals and whether it was measured.

A factor is described as a list of findings: (condition, impact, label, detail,
url). From one list come the score, the evidence array and nothing can disagree.
Everything is column expressions over one scan of the table; no shuffle until the
final ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizfit.operators.shared import cut, spread

VERSION = "1"
FACTORS = ("succession", "buy_box", "digital_gap", "fragmentation", "contactability", "health")
#: Default weights, priors, impacts, patterns and lists of the scoring rules.
WEIGHTS = {"succession": 0.28, "buy_box": 0.24, "digital_gap": 0.16, "fragmentation": 0.12, "contactability": 0.12, "health": 0.08}
LEAST_COVERED = 0.25
CONFIDENCE = {"high": 1.0, "medium": 0.55, "low": 0.15}
FILED = {"sole owner": 28.0, "partnership": 22.0, "limited liability": 8.0, "corporation": 2.0, "jointventure": -12.0}
OWNERSHIP = [
    (r"\bfamily[- ]owned\b", "Describes itself as family-owned", 26.0),
    (r"\bfamily[- ](?:run|operated)\b", "Family-run business", 24.0),
    (r"\b(?:2nd|3rd|second|third)[- ]generation\b", "Multi-generational owner", 22.0),
    (r"\bowner[- ](?:operated|operator)\b", "Owner-operated", 20.0),
    (r"\bindependently owned\b", "Independently owned", 18.0),
    (r"\bour founder\b", "Founder still referenced on site", 10.0),
]
TENURE = [(r"\bserving .{0,40}since (\d{4})\b", "Long continuous trading history", 14.0), (r"\bfounded (?:in )?(\d{4})\b", "States a founding year", 8.0)]
BACKED = [
    (r"\b(?:portfolio|platform) company of\b", "Already PE-backed"),
    (r"\bbacked by\b.{0,30}\b(capital|partners|equity)\b", "Names an institutional backer"),
    (r"\b(?:a|the)\s+(?:wholly[- ]owned\s+)?(?:subsidiary|division) of\b", "Subsidiary of a larger group"),
    (r"\b(?:nasdaq|nyse)\s*:", "Publicly listed"),
]
MODERN = [
    "next.js", "react", "gatsby", "nuxt", "svelte", "astro", "hubspot", "shopify", "webflow", "squarespace", "wix",
]
LEGACY = ["frontpage", "dreamweaver", "wordpress 4", "joomla", "flash", "jquery 1", "table-layout", "godaddy website builder"]
DECISION = r"(?i)\b(owner|founder|president|ceo|principal|managing (?:director|partner)|proprietor|general manager)\b"
ROLES = [
    "info", "contact", "sales", "support", "hello", "admin", "office", "enquiries", "inquiries", "help", "team", "mail", "service", "billing",
    "accounts", "noreply", "no-reply", "webmaster", "postmaster",
]


@dataclass(frozen=True)
class BuyBox:
    min_employees: int = 10
    max_employees: int = 100
    min_revenue: float = 1e6
    max_revenue: float = 1e7
    tolerance: float = 0.5


@dataclass(frozen=True)
class Finding:
    when: Column
    impact: Column
    label: Column
    detail: Column
    url: Column


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(when: Column, impact, label, detail="", url=None) -> Finding:
    return Finding(F.coalesce(when, F.lit(False)), _lit(impact).cast("double"), _lit(label), _lit(detail), _lit(url).cast("string"))


def confidence(found: Column, missing: Column) -> Column:
    """Coverage of the signals looked for, not the size of the score."""
    ratio = found / F.nullif(found + missing, F.lit(0))
    return F.when((ratio >= 0.66) & (found >= 2), "high").when(ratio >= 0.34, "medium").otherwise("low")


@dataclass(frozen=True)
class Factor:
    """What one factor is made of: numbers that its score and confidence are told from, and the evidence for them."""

    total: Column
    found: Column
    gaps: Column
    measured: Column
    evidence: Column
    missing: Column


def factor(base, findings: list[Finding], missing: list[tuple[Column, Column | str]], measured: Column | None = None, score: Column | None = None) -> Factor:
    """One factor of its findings. score replaces the sum of base and impacts where given.

    Impacts are added in the order of the evidence. Sums and counts don't look at the
    evidence, so that where only scores are asked for, its texts are never made.
    """
    impact = [F.least(F.greatest(f.impact, F.lit(-100.0)), F.lit(100.0)) for f in findings]
    gap = [F.coalesce(c, F.lit(False)) for c, _ in missing]
    count = lambda cs: reduce(lambda n, c: n + c.cast("int"), cs, F.lit(0))
    added = reduce(lambda t, x: t + F.when(x[0].when, x[1]).otherwise(0.0), zip(findings, impact, strict=True), _lit(base).cast("double"))
    shown = [F.when(f.when, F.struct(f.label.alias("label"), f.detail.alias("detail"), f.url.alias("source_url"), i.alias("impact"))) for f, i in zip(findings, impact, strict=True)]
    found = count([f.when for f in findings])
    return Factor(
        added if score is None else F.coalesce(score.cast("double"), added), found, count(gap), F.coalesce(_lit(measured).cast("boolean"), F.lit(False)) | (found > 0),
        F.array_compact(F.array(*shown)), F.array_compact(F.array(*[F.when(g, _lit(n)) for g, (_, n) in zip(gap, missing, strict=True)])),
    )


def excerpt(text: Column, pattern: Column, window: int = 70) -> Column:
    """The first match of a pattern with what stands around it, white space collapsed, ellipses where cut; null if the pattern is."""
    head = F.call_function("regexp_extract", text, F.concat(F.lit("(?is)^(.*?)(?:"), pattern, F.lit(")")), F.lit(1))
    hit = F.call_function("regexp_extract", text, F.concat(F.lit("(?i)"), pattern), F.lit(0))
    start = F.char_length(head)
    stop = start + F.char_length(hit)
    low = F.greatest(start - window, F.lit(0))
    body = F.trim(F.regexp_replace(text.substr(low + 1, stop + window - low), r"(?U)\s+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(stop + window < F.char_length(text), "…").otherwise(""))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The number, from 0, of the first pattern that matches; null if none does."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(patterns))):
        out = F.when(text.rlike(f"(?i){patterns[k]}"), k).otherwise(out)
    return out


def nth(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), k)


def strongest(patterns: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """By impact, the highest first; equals in the order listed."""
    return sorted(patterns, key=lambda p: -p[2])


def present(c: Column) -> Column:
    """A year or a text that isn't missing: not null, not zero, not empty."""
    return F.nullif(c, F.lit(0))


def signals(companies: DataFrame, as_of_year: int) -> DataFrame:
    """Adds what the factors are told from as plain columns, in three steps, so that no factor repeats an expression."""
    c, w = F.col, lambda n: F.col("web")[n]
    words = lambda n: F.array_join(F.coalesce(w(n), F.array().cast("array<string>")), " ")
    form, filed = F.lower(F.trim(c("business_type"))), F.lit(None).cast("double")
    for k, v in FILED.items():
        filed = F.when(form == k, v).otherwise(filed)
    latest = F.coalesce(present(w("latest_content_year")), present(w("copyright_year")))
    founded = F.coalesce(present(c("founded_year")), present(w("founded_year")))
    plain = companies.withColumns({
        "_text": F.concat_ws(" ", F.coalesce(w("raw_text_excerpt"), F.lit("")), words("owner_mentions"), words("pe_backed_mentions"), c("name")),
        "_filed": filed, "_founded": founded, "_age": F.lit(as_of_year) - founded, "_latest": latest, "_stale": F.lit(as_of_year) - latest,
        "_owner": F.get(F.filter(c("contacts"), lambda x: F.coalesce(x["is_decision_maker"], F.lit(False))), F.lit(0)), "_first": F.get(c("contacts"), F.lit(0)),
        "_hints": F.transform(F.coalesce(w("tech_hints"), F.array().cast("array<string>")), F.lower), "_site": F.coalesce(c("website"), F.lit("")) != "",
    })
    listed = lambda names: F.array_sort(F.array_intersect("_hints", F.array(*[F.lit(x) for x in names])))
    chosen = plain.withColumns({
        "_claim": first_match(c("_text"), [p for p, *_ in strongest(OWNERSHIP)]), "_told": first_match(c("_text"), [p for p, *_ in strongest(TENURE)]),
        "_backed": first_match(c("_text"), [p for p, _ in BACKED]), "_best": F.coalesce("_owner", "_first"), "_old": listed(LEGACY), "_new": listed(MODERN),
    })
    quote = lambda k, patterns: excerpt(c("_text"), nth([p[0] for p in patterns], c(k)))
    return chosen.withColumns({
        "_claim_quote": quote("_claim", strongest(OWNERSHIP)), "_told_quote": quote("_told", strongest(TENURE)), "_backed_quote": quote("_backed", BACKED),
        "_claim_impact": nth([p[2] for p in strongest(OWNERSHIP)], c("_claim")), "_told_impact": nth([p[2] for p in strongest(TENURE)], c("_told")),
        "_chief": F.coalesce(c("_best")["title"], F.lit("")).rlike(DECISION),
    })


def succession() -> Factor:
    c, w = F.col, lambda n: F.col("web")[n]
    filed, claim, founded, age, told, owner = c("_filed"), c("_claim_impact"), c("_founded"), c("_age"), c("_told_impact"), c("_owner")
    by_filing = filed.isNotNull() & (claim.isNull() | (filed >= claim))
    origin = F.when(c("licence_issued").isNotNull(), "Licensed since").otherwise("Founded")
    by_age = F.when(age >= 25, F.least(F.lit(24.0), 8.0 + (age - 25) * 0.6))
    young = F.coalesce(age < 8, F.lit(False))
    older = by_age.isNotNull() & (told.isNull() | (by_age >= told))
    named = F.concat_ws(" - ", F.coalesce(owner["name"], F.lit("Decision maker")), F.nullif(owner["title"], F.lit("")))
    found = [
        finding(by_filing, filed, F.concat(F.lit("Ownership form: "), c("business_type")), "As filed with the licensing board.", c("source_url")),
        finding(~by_filing & claim.isNotNull(), claim, nth([p[1] for p in strongest(OWNERSHIP)], c("_claim")), c("_claim_quote"), c("website")),
        finding(young, -18.0, "Young business", F.concat_ws(" ", origin, founded.cast("string"), F.lit("-"), age.cast("string"), F.lit("years old.")), F.coalesce("source_url", "website")),
        finding(~young & older, by_age, "Long-established business", F.concat_ws(" ", origin, founded.cast("string"), F.lit("-"), age.cast("string"), F.lit("years of trading.")), c("website")),
        finding(~young & ~older & told.isNotNull(), told, nth([p[1] for p in strongest(TENURE)], c("_told")), c("_told_quote"), c("website")),
        finding(c("sibling_location_count") >= 3, -32.0, "Multi-location chain", F.concat(c("sibling_location_count").cast("string"), F.lit(" premises under this name.")), c("source_url")),
        finding(c("_backed").isNotNull(), -45.0, nth([label for _, label in BACKED], c("_backed")), c("_backed_quote"), c("website")),
        finding(owner.isNotNull(), 8.0, "Named decision maker", named, F.coalesce(owner["linkedin_url"], c("website"))),
    ]
    missing = [
        (~by_filing & claim.isNull(), "ownership evidence"), (founded.isNull(), "founding year"),
        (F.coalesce(w("raw_text_excerpt"), F.lit("")) == "", "website text"), (owner.isNull(), "named owner or principal"),
    ]
    return factor(35.0, found, missing)


def band(value: Column, low: float, high: float, tolerance: float) -> Column:
    """100 inside the band, falling to 0 at its edges widened by the tolerance."""
    floor, ceiling = low * (1 - tolerance), high * (1 + tolerance)
    return (
        F.when((value >= low) & (value <= high), 100.0).when((value <= floor) | (value >= ceiling), 0.0)
        .when(value < low, 100.0 * (value - floor) / (low - floor)).when(value > high, 100.0 * (ceiling - value) / (ceiling - high))
    )


def buy_box(box: BuyBox) -> Factor:
    c = F.col
    size = band(c("employee_count").cast("double"), box.min_employees, box.max_employees, box.tolerance)
    sales = band(c("revenue_usd"), box.min_revenue, box.max_revenue, box.tolerance)
    none = size.isNull() & sales.isNull()
    without, staffed = none & (c("has_employees") == False), none & c("has_employees")  # noqa: E712
    both = (F.coalesce(size, F.lit(0.0)) + F.coalesce(sales, F.lit(0.0))) / (size.isNotNull().cast("int") + sales.isNotNull().cast("int"))
    score = F.when(~none, both).when(F.coalesce(without, F.lit(False)), 12.0).when(F.coalesce(staffed, F.lit(False)), 55.0).otherwise(30.0)
    told = F.coalesce(without | staffed, F.lit(False))
    span = f"{box.min_employees}-{box.max_employees}"
    found = [
        finding(size.isNotNull(), size - 50, "Headcount", F.concat(c("employee_count").cast("string"), F.lit(f" employees against a {span} target band.")), c("source_url")),
        finding(sales.isNotNull(), sales - 50, "Revenue", F.concat(F.lit("$"), F.format_number("revenue_usd", 0), F.lit(" against the target band.")), c("source_url")),
        finding(without, -38.0, "No employees", f"The licence is exempt from workers' cover; below the {box.min_employees}-person floor.", c("source_url")),
        finding(staffed, 5.0, "Employs staff", "The licence carries workers' cover, which says at least one employee.", c("source_url")),
    ]
    missing = [
        (size.isNull() & ~told, "employee count"), (sales.isNull() & ~told, "revenue estimate"), (told, "exact headcount"), (told, "revenue estimate"),
    ]
    return factor(30.0, found, missing, score=score)


def digital_gap() -> Factor:
    c, w = F.col, lambda n: F.col("web")[n]
    site, old, new, stale = c("_site"), c("_old"), c("_new"), c("_stale")
    found, missing = [], []
    for field, label, impact in (("https", "HTTPS", 11.0), ("mobile_viewport", "mobile viewport", 13.0), ("has_analytics", "analytics", 9.0)):
        found.append(finding(site & (w(field) == False), impact, f"No {label}", "Not found on the site.", c("website")))  # noqa: E712
        found.append(finding(site & w(field), -impact * 0.5, f"Has {label}", "Already in place.", c("website")))
        missing.append((site & w(field).isNull(), f"no {label}".lower()))
    found.append(finding(site & (F.size(old) > 0), 13.0, "Legacy site technology", F.concat(F.lit("Detected "), F.array_join(old, ", ")), c("website")))
    found.append(finding(site & (F.size(old) == 0) & (F.size(new) > 0), -12.0, "Modern site technology", F.concat(F.lit("Detected "), F.array_join(new, ", ")), c("website")))
    missing.append((site & (F.size("_hints") == 0), "site technology"))
    found.append(finding(site & (stale >= 2), F.least(F.lit(15.0), 4.0 * stale), "Stale content", F.concat(F.lit("Newest content is from "), c("_latest").cast("string")), c("website")))
    found.append(finding(site & (stale < 2), -8.0, "Current content", F.concat(F.lit("Content is from "), c("_latest").cast("string")), c("website")))
    missing += [(site & c("_latest").isNull(), "content freshness"), (~site, "website"), (~site, "site technology"), (~site, "content freshness")]
    return factor(28.0, found, missing, score=F.when(~site, 50.0))


def fragmentation() -> Factor:
    n = F.col("peer_count_in_niche")
    score = F.when(n.isNull(), 45.0).when(n <= 2, 25.0).when(n <= 7, 58.0).when(n <= 40, 90.0).when(n <= 90, 70.0).otherwise(45.0)
    detail = F.concat(n.cast("string"), F.lit(" comparable operators in "), F.coalesce("city", F.lit("the same area")), F.lit("."))
    return factor(45.0, [finding(n.isNotNull(), score - 50, "Peer density", detail, F.col("source_url"))], [(n.isNull(), "peer density in niche")], score=score)


def primary_contact() -> Column:
    """The first decision maker, else the first contact."""
    c = F.col("contacts")
    return F.coalesce(F.get(F.filter(c, lambda x: F.coalesce(x["is_decision_maker"], F.lit(False))), F.lit(0)), F.get(c, F.lit(0)))


def contactability() -> Factor:
    best, c = F.col("_best"), F.col
    has = lambda n: F.coalesce(best[n], F.lit("")) != ""
    role = F.lower(F.substring_index(best["email"], "@", 1)).isin(ROLES)
    status = best["email_status"]
    mail = F.when(status == "verified", F.when(role, 20.0).otherwise(30.0)).when(status == "risky", 12.0).when(status == "invalid", -10.0).otherwise(8.0)
    chief = c("_chief")
    who = F.concat_ws(" - ", best["name"], F.nullif(best["title"], F.lit("")))
    link = F.coalesce(best["linkedin_url"], c("website"))
    found = [
        finding(has("email"), mail, "Email", F.concat(F.lit("Address is "), F.coalesce(status, F.lit("unknown"))), c("website")),
        finding(has("phone"), F.when(best["phone_valid"], 22.0).otherwise(10.0), "Phone", F.when(best["phone_valid"], "Valid.").otherwise("Not validated."), c("source_url")),
        finding(has("name") & chief, 30.0, "Decision maker identified", who, link),
        finding(has("name") & ~chief, 12.0, "Named contact", who, link),
        finding(has("linkedin_url"), 12.0, "LinkedIn profile", "A second channel.", best["linkedin_url"]),
    ]
    missing = [(~has("email"), "email address"), (~has("phone"), "phone number"), (~has("name"), "named contact")]
    return factor(0.0, found, missing, measured=F.coalesce(F.size("contacts") <= 0, F.lit(True)))


def health() -> Factor:
    c, w = F.col, lambda n: F.col("web")[n]
    latest, age = c("_latest"), c("_stale")
    found = [
        finding(age <= 1, 22.0, "Site actively maintained", F.concat(F.lit("Content dated "), latest.cast("string")), c("website")),
        finding(age >= 4, -28.0, "Possibly dormant", F.concat(F.lit("Nothing newer than "), latest.cast("string")), c("website")),
        finding(w("has_careers_page"), 16.0, "Hiring", "Has a careers page.", c("website")),
        finding(w("has_team_page"), 10.0, "Team page", "Names its staff.", c("website")),
        finding(w("fetched_at").isNotNull() & (w("page_bytes") < 2000), -20.0, "Placeholder site", "The homepage is nearly empty.", c("website")),
    ]
    missing = [(latest.isNull(), "content dates"), (~F.coalesce(w("has_careers_page"), F.lit(False)), "hiring signal"), (w("fetched_at").isNull(), "reachable website")]
    return factor(50.0, found, missing)


def with_factors(companies: DataFrame, as_of_year: int, box: BuyBox = BuyBox()) -> DataFrame:  # noqa: B008
    """Adds one struct column f_<factor> for each factor."""
    parts = {"succession": succession(), "buy_box": buy_box(box), "digital_gap": digital_gap(), "fragmentation": fragmentation(), "contactability": contactability(), "health": health()}
    rows = signals(spread(companies), as_of_year)
    rows = rows.withColumns({f"_{name}_{k}": column for k, p in parts.items() for name, column in (("total", p.total), ("found", p.found), ("gaps", p.gaps), ("measured", p.measured))})

    def result(k: str) -> Column:
        c = lambda n: F.col(f"_{n}_{k}")
        held = F.least(F.greatest(c("total"), F.lit(0.0)), F.lit(100.0))
        return F.struct(held.alias("score"), confidence(c("found"), c("gaps")).alias("confidence"), parts[k].evidence.alias("evidence"), parts[k].missing.alias("missing"), c("measured").alias("measured"))

    return rows.select(*companies.columns, *[result(k).alias(f"f_{k}") for k in FACTORS])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def normalised(weight: Callable[[str], Column]) -> dict[str, Column]:
    """Weights that sum to one; equal ones if they sum to nothing."""
    total = _sum([weight(k) for k in FACTORS])
    return {k: F.when(total > 0, weight(k) / F.nullif(total, F.lit(0.0))).otherwise(1.0 / len(FACTORS)) for k in FACTORS}


def tenths(x: Column) -> Column:
    """``x`` to one decimal, half away from zero once multiplied, as SQL engines and spreadsheets do it: F.round looks at the decimal text, where 55.249999999999996 is under a half."""
    return F.round(x * 10, 0) / 10


def with_total(rows: DataFrame, weight: Callable[[str], Column] | None = None) -> DataFrame:
    """Adds covered_weight, effective_weights, contributions, score_raw, score and confidence to rows with factors.

    weight gives the declared weight of a factor as a column; by default WEIGHTS.
    """
    declared = normalised(weight or (lambda k: F.lit(WEIGHTS[k])))
    rows = rows.withColumns({f"_w_{k}": v for k, v in declared.items()})
    w, f = (lambda k: F.col(f"_w_{k}")), (lambda k: F.col(f"f_{k}"))
    rows = rows.withColumn("_covered", _sum([F.when(f(k)["measured"], w(k)).otherwise(0.0) for k in FACTORS]))
    covered = F.col("_covered")
    use = lambda k: F.when(covered < LEAST_COVERED, w(k)).when(f(k)["measured"], w(k) / F.nullif(covered, F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumns({f"_e_{k}": use(k) for k in FACTORS})
    raw = F.least(F.greatest(_sum([f(k)["score"] * F.col(f"_e_{k}") for k in FACTORS]), F.lit(0.0)), F.lit(100.0))
    sure = F.lit(0.0)
    sure = _sum([F.when(f(k)["confidence"] == "high", CONFIDENCE["high"]).when(f(k)["confidence"] == "medium", CONFIDENCE["medium"]).otherwise(CONFIDENCE["low"]) * w(k) for k in FACTORS])
    out = rows.withColumns({
        "covered_weight": F.round(covered, 4), "effective_weights": F.create_map(*[x for k in FACTORS for x in (F.lit(k), F.col(f"_e_{k}"))]),
        "contributions": F.create_map(*[x for k in FACTORS for x in (F.lit(k), f(k)["score"] * F.col(f"_e_{k}"))]),
        "score_raw": raw, "score": tenths(raw), "confidence": F.when(sure >= 0.7, "high").when(sure >= 0.4, "medium").otherwise("low"),
    })
    return out.drop("_covered", *[f"_w_{k}" for k in FACTORS], *[f"_e_{k}" for k in FACTORS])


def score_table(companies: DataFrame, as_of_year: int, box: BuyBox = BuyBox(), explain: bool = True) -> DataFrame:  # noqa: B008
    """Writes the factors and total of every row, and reads them back, so that a filter on a score doesn't unfold what it is made of.

    Without ``explain`` only the totals are made, not the factors with their evidence.
    """
    rows = with_total(with_factors(companies, as_of_year, box))
    return cut(rows if explain else rows.drop(*[f"f_{k}" for k in FACTORS]), "scores")


def ranked(scored: DataFrame) -> DataFrame:
    """Best score first; equal scores in order of the id."""
    return scored.orderBy(F.desc("score"), F.asc("id"))


def what_if(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Every row under every weight vector of ``weights`` (scenario and the six factors' names).

    Each vector multiplies the output, which is what is asked for; the vectors are
    broadcast if they are few, else both sides are spread.
    """
    given = weights.select("scenario", *[F.col(k).cast("double").alias(f"_v_{k}") for k in FACTORS])
    few = given.limit(100_001).count() <= 100_000
    rows = with_total(cut(factors, "factors").crossJoin(F.broadcast(given) if few else given), lambda k: F.col(f"_v_{k}"))
    return rows.drop(*[f"_v_{k}" for k in FACTORS])


def places(scored: DataFrame, by: str = "scenario") -> DataFrame:
    """Adds place, the rank within ``by``: best score first, equal scores in order of the id.

    Rows are dealt by range of (by, score, id) and numbered within their range; each
    range starts after the rows of those before it. No group is sorted in one task.
    """
    order = [F.desc("score"), F.asc("id")]
    dealt = cut(scored.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "places")
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    joined = inside.join(F.broadcast(starts), inside[by].eqNullSafe(starts["_by"]) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("place", F.col("_start") + F.col("_k")).drop("_range", "_k", "_by", "_r", "_start")


#: Columns that change with a crawl or a visit but not with what is known of a company.
VOLATILE = ["last_refreshed", "first_seen", "pos", "data_quality", "quality_issues", "raw"]


def content_key(companies: DataFrame, as_of_year: int, box: BuyBox = BuyBox()) -> DataFrame:  # noqa: B008
    """Adds cache_key, which changes with whatever a score is made from: the record without its times, the weights, the buy box and the year."""
    parts = [F.col(c) for c in sorted(companies.columns) if c not in (*VOLATILE, "web", "cache_key") and not c.startswith("f_")]
    record = F.to_json(F.struct(*parts, F.col("web").dropFields("fetched_at").alias("web")), {"ignoreNullFields": "false"})
    thesis = "|".join([*(f"{k}={v}" for k, v in WEIGHTS.items()), *(f"{k}={v}" for k, v in sorted(asdict(box).items())), str(as_of_year)])
    crawled = F.col("web")["fetched_at"].isNotNull().cast("string")  # that there was a crawl counts, its time doesn't
    text = F.concat_ws("|", F.lit(VERSION), record, crawled, F.lit(thesis))
    return companies.withColumn("cache_key", F.concat(F.lit("score:"), F.left(F.sha2(text, 256), F.lit(32))))


def rescore_changed(companies: DataFrame, history: DataFrame, as_of_year: int, box: BuyBox = BuyBox()) -> DataFrame:  # noqa: B008
    """Scores only the rows whose content key isn't in ``history.cache_key``."""
    keyed = content_key(companies, as_of_year, box)
    return score_table(keyed.join(history.select("cache_key"), "cache_key", "left_anti"), as_of_year, box)
