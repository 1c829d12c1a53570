"""Sources as tables: licence register, principals, map elements, lead lists, snapshots, page cache.

Rows carry ``pos``, their place in source order. Where a file reader has to make
it, it is file order, then the reader's own row order within the file.
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators.match import first_sighting
from bizfit.operators.shared import cut

# Trade classes, coverage words, title ranks, map tags in order of priority, header aliases.
CLASSES = {"C10": "Electrical", "C-10": "Electrical", "C20": "HVAC", "C-20": "HVAC", "C36": "Plumbing", "C-36": "Plumbing"}
COVERED = ["workers' compensation", "self-insured", "leasing firm"]
TITLE_RANK = [
    "sole owner", "president", "chief executive officer", "owner", "partner", "responsible managing owner", "responsible managing officer",
    "responsible managing employee", "vice president", "officer", "treasurer", "secretary",
]
TRADE_TAGS = {
    "amenity=veterinary": "Veterinary", "amenity=dentist": "Dental", "shop=optician": "Optometry", "shop=hearing_aids": "Audiology", "shop=car_repair": "Auto repair",
    "shop=storage_rental": "Self-storage", "shop=funeral_directors": "Funeral services", "shop=dry_cleaning": "Dry cleaning", "shop=laundry": "Laundry",
    "amenity=childcare": "Childcare", "office=insurance": "Insurance agency", "office=accountant": "Accounting", "craft=hvac": "HVAC", "craft=plumber": "Plumbing",
    "craft=electrician": "Electrical", "craft=roofer": "Roofing", "shop=hvac": "HVAC", "craft=heating_engineer": "HVAC",
}
ALIASES = {
    "name": ["company", "companyname", "business", "businessname", "accountname", "name", "organization"],
    "website": ["website", "websiteurl", "url", "domain", "web", "site", "homepage", "companywebsite"],
    "email": ["email", "emailaddress", "contactemail", "workemail", "primaryemail"],
    "phone": ["phone", "phonenumber", "telephone", "contactphone", "tel", "mobile", "workphone"],
    "city": ["city", "town", "billingcity", "locationcity"],
    "state": ["state", "region", "province", "billingstate", "stateregion"],
    "postcode": ["zip", "zipcode", "postalcode", "postcode", "billingpostalcode", "postal"],
    "industry": ["industry", "sector", "category", "trade", "vertical", "naicsdescription"],
    "employee_count": ["employees", "employeecount", "headcount", "staff", "companysize", "numberofemployees", "size"],
    "revenue_usd": ["revenue", "annualrevenue", "sales", "estimatedrevenue", "revenueusd", "airevenue"],
    "founded_year": ["founded", "yearfounded", "established", "foundedyear", "foundingyear"],
    "business_type": ["ownership", "entitytype", "businesstype", "ownershipform", "legalform"],
    "contact_name": ["contactname", "contact", "owner", "ownername", "decisionmaker", "fullname", "name2"],
    "contact_title": ["title", "jobtitle", "role", "position", "contacttitle"],
}
CONTACT_TYPE = "struct<name:string,title:string,email:string,email_status:string,phone:string,phone_valid:boolean,linkedin_url:string,is_decision_maker:boolean>"


#: The columns of a company; sources fill some of them.
COMPANY = {
    "id": "string", "pos": "long", "name": "string", "domain": "string", "website": "string", "industry": "string", "city": "string", "state": "string", "country": "string",
    "postcode": "string", "latitude": "double", "longitude": "double", "employee_count": "int", "employee_count_is_estimate": "boolean", "revenue_usd": "double",
    "revenue_is_estimate": "boolean", "founded_year": "int", "business_type": "string", "has_employees": "boolean", "licence_number": "string", "licence_issued": "date",
    "contacts": f"array<{CONTACT_TYPE}>",
    "web": "struct<fetched_at:timestamp,https:boolean,mobile_viewport:boolean,has_analytics:boolean,generator:string,copyright_year:int,latest_content_year:int,page_bytes:int,tech_hints:array<string>,"
    "has_careers_page:boolean,has_team_page:boolean,founded_year:int,owner_mentions:array<string>,pe_backed_mentions:array<string>,raw_text_excerpt:string>",
    "peer_count_in_niche": "long", "sibling_location_count": "long", "source": "string", "source_url": "string",
}


def complete(rows: DataFrame) -> DataFrame:
    """Rows of a source with all columns of a company, those it doesn't know as nulls and contacts as an empty array."""
    have = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    known = {c: have(c, t) for c, t in COMPANY.items()}
    known["contacts"] = F.coalesce(known["contacts"], F.array().cast(COMPANY["contacts"]))
    known["country"] = F.coalesce(known["country"], F.lit("US"))
    return rows.select(*[v.alias(c) for c, v in known.items()], *[c for c in rows.columns if c not in COMPANY])


def _tagged(rows: DataFrame) -> DataFrame:
    """Rows read from files, with where each was read: file, block of the file, order in which the block was read."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_read"))


def numbered(tagged: DataFrame) -> DataFrame:
    """Adds pos, from 0, to tagged rows: by file name, then block, then order within the block; _file stays.

    How blocks are dealt to tasks is of no matter.
    """
    tagged = cut(tagged, "source-rows")
    sizes = tagged.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    starts = sizes.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = tagged.withColumn("_k", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_read")))
    return inside.join(starts, ["_file", "_block"]).withColumn("pos", F.col("_start") + F.col("_k") - 1).drop("_block", "_read", "_k", "_start")


def with_pos(rows: DataFrame) -> DataFrame:
    """Adds pos, from 0, to rows read from files: by file name, then place in the file."""
    return numbered(_tagged(rows)).drop("_file")


def licence_scan(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Register exports (CSV with headers) with pos, all values as text; empty values are null."""
    return with_pos(spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path))


def contact(name=None, title=None, email=None, phone=None, decides=None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if name is None else name).cast("string").alias("name"), (none if title is None else title).cast("string").alias("title"), (none if email is None else email).cast("string").alias("email"),
        F.lit("unknown").alias("email_status"), (none if phone is None else phone).cast("string").alias("phone"), none.cast("boolean").alias("phone_valid"),
        none.cast("string").alias("linkedin_url"), (F.lit(False) if decides is None else decides).alias("is_decision_maker"),
    )


def one_contact(c: Column, there: Column) -> Column:
    return F.when(F.coalesce(there, F.lit(False)), F.array(c)).otherwise(F.array().cast(f"array<{CONTACT_TYPE}>"))


def licence_load(exports: DataFrame) -> DataFrame:
    """The first row of each licence number in source order; rows without one are dropped."""
    return first_sighting(exports.filter(C.blank(F.col("LicenseNumber")).isNotNull()).withColumn("LicenseNumber", F.trim("LicenseNumber")), "LicenseNumber")


def licence_to_company(rows: DataFrame) -> DataFrame:
    """Register rows as companies; those without licence, name or a wanted class are dropped."""
    codes = F.filter(F.transform(F.split(F.col("Classification(s)"), r"[|,/]"), lambda c: F.upper(F.trim(c))), lambda c: c != "")
    labels = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    trade = F.get(F.filter(F.transform(codes, lambda c: labels[c]), lambda x: x.isNotNull()), F.lit(0))
    cover = F.lower(C.blank(F.col("WorkersCompCoverageType")))
    staffed = F.when(F.greatest(*[F.contains(cover, F.lit(m)) for m in COVERED]), True).when(F.contains(cover, F.lit("exempt")), False)
    issued, phone = C.parse_date(F.col("IssueDate")), C.blank(F.col("PhoneNumber"))
    out = rows.select(
        F.concat(F.lit("cslb:"), F.trim("LicenseNumber")).alias("id"), "pos", C.blank(F.col("BusinessName")).alias("name"), trade.alias("industry"),
        C.blank(F.col("City")).alias("city"), C.blank(F.col("State")).alias("state"), C.blank(F.col("County")).alias("county"), C.postcode5(F.col("ZIP Code")).alias("postcode"),
        C.blank(F.col("BusinessType")).alias("business_type"), staffed.alias("has_employees"), F.trim("LicenseNumber").alias("licence_number"), issued.alias("licence_issued"),
        F.year(issued).alias("founded_year"), codes.alias("licence_classifications"), one_contact(contact(phone=phone), phone.isNotNull()).alias("contacts"),
        F.lit(None).cast("string").alias("website"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
    )
    return out.filter("name IS NOT NULL AND industry IS NOT NULL AND licence_number <> ''")


def principal_best(rows: DataFrame) -> DataFrame:
    """S3: licence_number, person, person_title: the first usable row of a licence, the most senior of its titles."""
    words = F.filter(F.split(F.trim("Name"), r"\s+"), lambda w: w != "")
    turned = F.when(F.size(words) > 1, F.concat(F.slice(words, F.lit(2), F.size(words) - 1), F.slice(words, 1, 1))).otherwise(words)
    letters = F.regexp_extract_all(F.lower(F.array_join(turned, " ")), F.lit(r"([^\p{L}]*)(\p{L}+|$)"), F.lit(0))
    cased = F.array_join(F.transform(letters, lambda p: F.concat(F.regexp_extract(p, r"^([^\p{L}]*)", 1), F.initcap(F.regexp_replace(p, r"^[^\p{L}]*", "")))), "")
    titles = F.filter(F.transform(F.split(F.coalesce("EMP-Titl-CDE", F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    rank = lambda t: F.coalesce(*[F.when(F.contains(F.lower(t), F.lit(w)), k) for k, w in enumerate(TITLE_RANK)], F.lit(len(TITLE_RANK)))
    best = F.array_min(F.transform(titles, lambda t, i: F.struct(rank(t).alias("r"), i.alias("i"), t.alias("t"))))["t"]
    usable = rows.filter(C.blank(F.col("LIC-NO")).isNotNull() & (F.size(words) > 0))
    out = usable.select(F.trim("LIC-NO").alias("licence_number"), "pos", cased.alias("person"), best.alias("person_title"))
    return first_sighting(out, "licence_number").drop("pos")


def market_scope(companies: DataFrame, state: str | None = None, counties: list[str] = (), core_cities: list[str] = ()) -> DataFrame:
    """Rows of a market; an empty list accepts all, and a null city is outside a list."""
    keep = F.lit(True)
    if state:
        keep = keep & (F.upper(F.trim("state")) == state)
    if counties:
        keep = keep & F.upper(F.trim("county")).isin([c.upper() for c in counties])
    if core_cities:
        keep = keep & F.upper(F.trim("city")).isin([c.upper() for c in core_cities])
    return companies.filter(keep)


ELEMENT = "type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>"


def element_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The map elements of files that hold a response of the map service each (an object with ``elements``), with pos.

    Tags are free and come as a map; ways and relations have a center in place of
    coordinates. What is no such object has no elements. Without ``multi_line`` each
    line of a file is a response, and large files are split.
    """
    whole = spark.read.schema(f"elements array<struct<{ELEMENT}>>").option("multiLine", multi_line).json(path)
    return numbered(_tagged(whole.select("elements", "_metadata")).drop("_metadata").select("_file", "_block", "_read", F.posexplode("elements").alias("_k", "e"))
                    .select("_file", "_block", F.struct("_read", "_k").alias("_read"), "e.*")).drop("_file")


def map_elements(elements: DataFrame, as_of_year: int, state: str | None = None) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) as companies; nameless ones are dropped."""
    tag = lambda *ks: F.coalesce(*[C.blank(F.col("tags")[k]) for k in ks])
    trade = F.coalesce(*[F.when(F.col("tags")[k.split("=")[0]] == k.split("=")[1], v) for k, v in TRADE_TAGS.items()])
    site = tag("website", "contact:website", "url")
    site = F.when(site.rlike("(?i)^https?://"), site).otherwise(F.concat(F.lit("https://"), site))
    email, phone = tag("email", "contact:email"), tag("phone", "contact:phone")
    out = elements.select(
        F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), "pos", tag("name", "operator").alias("name"), trade.alias("industry"), site.alias("website"),
        tag("addr:city").alias("city"), F.coalesce(tag("addr:state"), F.lit(state)).alias("state"), tag("addr:postcode").alias("postcode"),
        F.coalesce("lat", "center.lat").alias("latitude"), F.coalesce("lon", "center.lon").alias("longitude"),
        C.year_between(F.col("tags")["start_date"], 1800, F.lit(as_of_year)).alias("founded_year"), one_contact(contact(email=email, phone=phone), email.isNotNull() | phone.isNotNull()).alias("contacts"),
    )
    return out.filter("name IS NOT NULL")


def header_mapping(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """{field: header} by alias, the first header winning a field; and the headers left over."""
    by_alias = {a: f for f, names in ALIASES.items() for a in names}
    found: dict[str, str] = {}
    for h in headers:
        field = by_alias.get(re.sub(r"[^a-z0-9]", "", h.lower()))
        if field and field not in found:
            found[field] = h
    return found, [h for h in headers if h not in found.values()]


def _lead(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Rows with a text column for each field of a lead as companies; a contact is there if it has a name, an address or a number, and decides if it has a name."""
    col = lambda f: C.blank(F.col(f))
    name, title, email, phone, site = (col(f) for f in ("contact_name", "contact_title", "email", "phone", "website"))
    return rows.select(
        F.concat(F.lit("import:"), F.col("pos").cast("string")).alias("id"), "pos", col("name").alias("name"),
        F.when(F.contains(site, F.lit("://")), site).otherwise(F.concat(F.lit("https://"), site)).alias("website"), col("industry").alias("industry"), col("city").alias("city"),
        col("state").alias("state"), col("postcode").alias("postcode"), C.whole_number(col("employee_count")).alias("employee_count"),
        C.money(col("revenue_usd")).alias("revenue_usd"), C.founding_year(col("founded_year"), 1800, F.lit(as_of_year)).alias("founded_year"), col("business_type").alias("business_type"),
        one_contact(contact(name, title, email, phone, name.isNotNull()), F.coalesce(name, email, phone).isNotNull()).alias("contacts"), F.lit("import").alias("source"),
        *[c for c in rows.columns if c.startswith("_")],
    )


def _fields(rows: DataFrame, headers: dict[str, str]) -> list[Column]:
    """The column of each field of a lead, null where no header stands for it. ``headers`` names the columns that the headers are in."""
    found, _ = header_mapping(list(headers))
    return [(F.col(f"`{headers[found[f]]}`") if f in found else F.lit(None)).cast("string").alias(f) for f in ALIASES]


def lead_list(rows: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """A lead list with any headers as companies, and a one-row report (kept, skipped, unmapped). Needs pos."""
    headers = [c for c in rows.columns if c != "pos"]
    out = _lead(rows.select("pos", *_fields(rows, {h: h for h in headers})), as_of_year)
    report = out.agg(F.count_if(F.col("name").isNotNull()).alias("kept"), F.count_if(F.col("name").isNull()).alias("skipped"))
    return out.filter("name IS NOT NULL"), report.withColumn("unmapped", F.lit(", ".join(header_mapping(headers)[1])))


def lead_files(spark: SparkSession, path: str, as_of_year: int, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The CSV files of lead lists in ``path``, each with headers of its own, as companies; and a report with a row for each file.

    Files with the same header line are read together, fields are found by their headers,
    and rows are numbered from 1 by file name and place. The report has file, kept,
    skipped (rows without a name), malformed (kept or skipped rows whose values don't
    match the headers in number: what is missing is null, what is over is left out) and
    unmapped headers. Files without a line have no row in it. With ``multi_line`` values in
    quotes may hold line breaks, and a file is one task; without, large files are split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_read"))
    heads = lines.filter("_block = 0").groupBy("_file").agg(F.min_by("value", "_read").alias("head")).collect()  # a row a file
    files: dict[str, list[str]] = {}
    for r in sorted(heads):
        files.setdefault(r["head"].removeprefix("\ufeff"), []).append(r["_file"])
    parts, unmapped = [], []
    for head, those in files.items():
        names = next(csv.reader([head]), [])
        columns = {h: f"c{k}" for k, h in reversed(list(enumerate(names))) if h.strip()}
        schema = "".join(f"c{k} string, " for k in range(len(names))) + "_broken string"
        rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False).csv(those)
        parts.append(_tagged(rows.select(*_fields(rows, dict(sorted(columns.items(), key=lambda x: int(x[1][1:])))), F.col("_broken").isNotNull().alias("_malformed"), F.col("c0").alias("_first"), "_metadata")).drop("_metadata"))
        rest = ", ".join(header_mapping([h for h in names if h.strip()])[1])
        unmapped += [(f, rest) for f in those]
    told = spark.createDataFrame(unmapped, "file string, unmapped string")
    if not parts:
        nothing = _lead(spark.createDataFrame([], "pos long" + "".join(f", {f} string" for f in ALIASES)), as_of_year)
        return nothing, told.select("file", F.lit(0).alias("kept"), F.lit(0).alias("skipped"), F.lit(0).alias("malformed"), "unmapped")
    rows = numbered(reduce(DataFrame.unionByName, parts)).drop("_first")  # read because no scan may be of broken rows alone
    out = cut(_lead(rows.withColumn("pos", F.col("pos") + 1), as_of_year), "leads")
    counts = out.groupBy(F.col("_file").alias("file")).agg(F.count_if(F.col("name").isNotNull()).alias("kept"), F.count_if(F.col("name").isNull()).alias("skipped"), F.count_if("_malformed").alias("malformed"))
    report = told.join(counts, "file", "left").na.fill(0).select("file", "kept", "skipped", "malformed", "unmapped")
    return out.filter("name IS NOT NULL").drop("_file", "_malformed"), report


def snapshot_load(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """The companies of nested snapshots: one a file, or one a line, which can be split and so suits many."""
    whole = spark.read.schema(f"market string, generated_at string, sources array<string>, companies array<struct<{schema}>>").json(path, multiLine=multi_line)
    return whole.select("market", "generated_at", F.inline("companies"))


def page_latest(fetches: DataFrame, as_of: Column) -> DataFrame:
    """The newest unexpired OK body per request key: url, fetched_at, expires_at, status, body."""
    url = F.regexp_replace(F.regexp_replace(F.trim("url"), "#.*$", ""), "^(?i)(https?://[^/]+)$", "$1/")
    host = F.regexp_extract(url, "^([^:]+://[^/?]*)", 1)
    url = F.concat(F.lower(host), F.expr("''"), F.regexp_replace(url, "^[^:]+://[^/?]*", ""))
    keyed = fetches.filter((F.col("expires_at") > as_of) & F.col("status").between(200, 299)).withColumn("cache_key", F.left(F.sha2(F.concat(F.lit("GET "), url), 256), F.lit(32)))
    return keyed.groupBy("cache_key").agg(F.max_by(F.struct("url", "body", "fetched_at"), F.struct("fetched_at", "body")).alias("p")).select("cache_key", "p.*")
