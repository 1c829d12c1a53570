"""Queries over source rows (register, map, lead list, snapshots, fetches) that are derived from the driver's tables.

The rows are derived in SQL that Spark and DuckDB read alike, so both start from the same sources.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizfit.operators import annotate, contacts, match, pages, sinks, store
from bizfit.operators.shared import fresh_path
from bizfit.plans import flows
from bizfit.plans.demo import AS_OF_YEAR, FLAT, PAGES, companies, flat
from bizfit.plans.demo import pages as demo_pages
from bizfit.plans.queries import QUALITY, SQL, TOTAL, WITH_SECONDARY, contact_sql, mail_facts, proof_sql, query, scored
from bizfit.sources import readers
from bizfit.streaming.refresh import stream_refreshes

REGISTER_SQL = """
SELECT o_orderkey AS pos,
  CASE WHEN o_orderkey % 17 <> 0 THEN ' ' || CAST(o_custkey AS STRING) || ' ' END AS licence,
  CASE WHEN o_custkey % 19 <> 0 THEN 'Trade ' || CAST(o_custkey AS STRING) END AS business,
  CASE o_custkey % 5 WHEN 0 THEN 'Sole Owner' WHEN 1 THEN 'Corporation' END AS form,
  CASE o_orderkey % 3 WHEN 0 THEN 'Los Angeles' WHEN 1 THEN ' PASADENA ' END AS city,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NV' ELSE 'CA' END AS state,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Los Angeles' ELSE 'Orange' END AS county,
  CASE WHEN o_orderkey % 23 = 0 THEN '901' ELSE CAST(90000 + o_custkey % 97 AS STRING) || '-1234' END AS zip,
  CASE WHEN o_custkey % 4 <> 0 THEN '213555' || CAST(1000 + o_custkey % 9000 AS STRING) END AS phone,
  CASE WHEN o_orderkey % 29 = 0 THEN 'soon' ELSE lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')
    || '/' || CAST(year(o_orderdate) AS STRING) END AS issued,
  CASE o_orderkey % 5 WHEN 0 THEN 'C-36 | B' WHEN 1 THEN 'B,C20' WHEN 2 THEN 'c10/C36' WHEN 3 THEN 'B' END AS classes,
  CASE o_orderkey % 4 WHEN 0 THEN 'Self-Insured' WHEN 1 THEN 'Exempt' WHEN 2 THEN 'Employee Leasing Firm' END AS cover,
  CASE o_orderkey % 6 WHEN 0 THEN 'SMITH  JOHN Q ' WHEN 1 THEN 'O' || chr(39) || 'NEIL MARY' WHEN 2 THEN 'CHER' WHEN 3 THEN '  ' WHEN 4 THEN 'DE-LA CRUZ ANA' END AS person,
  CASE o_orderkey % 7 WHEN 0 THEN 'Officer | President' WHEN 1 THEN 'Secretary' WHEN 2 THEN 'Responsible Managing Officer|Partner' WHEN 3 THEN ' | '
    WHEN 4 THEN 'Vice President|Owner' WHEN 5 THEN 'Caretaker|Porter' END AS titles
FROM {orders}
"""
REGISTER_HEADERS = {
    "licence": "LicenseNumber", "business": "BusinessName", "form": "BusinessType", "city": "City", "state": "State", "zip": "ZIP Code", "county": "County",
    "phone": "PhoneNumber", "issued": "IssueDate", "classes": "Classification(s)", "cover": "WorkersCompCoverageType",
}
ELEMENTS_SQL = """
SELECT c_custkey AS pos, c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type,
  CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS t_name, CASE WHEN c_custkey % 14 = 0 THEN 'Operator ' || CAST(c_custkey AS STRING) END AS t_operator,
  CASE c_custkey % 5 WHEN 0 THEN 'dentist' WHEN 1 THEN 'cafe' END AS t_amenity, CASE c_custkey % 4 WHEN 0 THEN 'hvac' WHEN 1 THEN 'laundry' END AS t_shop,
  CASE WHEN c_custkey % 3 = 0 THEN 'www.site' || CAST(c_custkey AS STRING) || '.com' END AS t_url,
  CASE c_custkey % 6 WHEN 0 THEN 'https://main.example' WHEN 3 THEN '' END AS t_website,
  CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS lat, CAST(c_custkey AS DOUBLE) AS center_lat,
  CASE c_custkey % 4 WHEN 0 THEN '1985-04' WHEN 1 THEN '1700' WHEN 2 THEN '2015' END AS t_start
FROM {customer}
"""
LEADS_SQL = """
SELECT c_custkey AS pos, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'www.x' || CAST(c_custkey AS STRING) || '.com' END AS site,
  CASE c_custkey % 4 WHEN 0 THEN '11-50' WHEN 1 THEN '1,200' WHEN 2 THEN 'n/a' END AS staff,
  CASE c_custkey % 5 WHEN 0 THEN '$5.2M' WHEN 1 THEN '1,250,000' WHEN 2 THEN '900K' WHEN 3 THEN '2B' END AS money,
  CASE c_custkey % 3 WHEN 0 THEN '1999' WHEN 1 THEN 'unknown' END AS founded, c_mktsegment AS sector, 'x' AS notes,
  CASE c_custkey % 4 WHEN 0 THEN 'Pat Doe' || CAST(c_custkey AS STRING) WHEN 1 THEN ' ' END AS person, CASE c_custkey % 3 WHEN 0 THEN 'Owner' WHEN 1 THEN 'Clerk' END AS job,
  CASE WHEN c_custkey % 3 <> 1 THEN 'Lead' || CAST(c_custkey AS STRING) || '@Mail' || CAST(c_custkey % 300 AS STRING) || '.com' END AS mail, CASE WHEN c_custkey % 5 < 3 THEN '(614) ' || CAST(150 + c_custkey % 700 AS STRING) || '-' || CAST(1000 + c_custkey % 9000 AS STRING) END AS phone
FROM {customer}
"""
LEAD_HEADERS = ["pos", "Company Name", "Web-Site", "Employees", "Estimated Revenue", "Year Founded", "Sector", "Notes", "Decision-Maker", "Job Title", "E-Mail", "Phone Number"]
FETCHES_SQL = """
SELECT 'HTTPS://Site' || CAST(user_id % 50 AS STRING) || '.Example.com/Page#' || CAST(event_id AS STRING) AS url, ts AS fetched_at,
  CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE TIMESTAMP '2030-01-01 00:00:00' END AS expires_at,
  CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS status, event_type || CAST(event_id AS STRING) AS body
FROM {events}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTER_SQL, orders=_table(spark, sf_dir, "orders")).withColumnsRenamed(REGISTER_HEADERS)


REGISTER = REGISTER_SQL.format(orders="orders")
FIRST = f"WITH r AS ({REGISTER}), w AS (SELECT *, trim(licence) AS lic FROM r WHERE licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(licence) ORDER BY pos) = 1)"
COMPANY = f"""{FIRST}, k AS (SELECT *, list_filter(list_transform(string_split_regex(classes, '[|,/]'), lambda x: replace(upper(trim(x)), '-', '')), lambda x: x IN ('C10', 'C20', 'C36'))[1] AS code FROM w),
s AS (SELECT 'cslb:' || lic AS id, business AS name, CASE code WHEN 'C10' THEN 'Electrical' WHEN 'C20' THEN 'HVAC' ELSE 'Plumbing' END AS industry, trim(city) AS city, state,
  CASE WHEN zip <> '901' THEN left(zip, 5) END AS postcode, CASE WHEN regexp_matches(lower(cover), 'self-insured|leasing firm') THEN TRUE WHEN lower(cover) = 'exempt' THEN FALSE END AS has_employees,
  CASE WHEN issued <> 'soon' THEN CAST(right(issued, 4) AS INT) END AS founded_year, phone FROM k WHERE code IS NOT NULL AND business IS NOT NULL)"""
COMPANY_COLUMNS = ["id", "name", "industry", "city", "state", "postcode", "has_employees", "founded_year"]


def _licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.licence_to_company(readers.licence_load(register(spark, sf_dir)))


query("S1_licence_load", f"{FIRST} SELECT lic AS licence, pos FROM w")(lambda s, d: readers.licence_load(register(s, d)).select(F.col("LicenseNumber").alias("licence"), "pos"))
query("S2_licence_to_company", f"{COMPANY} SELECT {', '.join(COMPANY_COLUMNS)}, phone FROM s")(lambda s, d: _licensed(s, d).select(*COMPANY_COLUMNS, F.get("contacts", F.lit(0))["phone"].alias("phone")))
query("S4_market_scope", f"{COMPANY} SELECT id, name, city FROM s WHERE state = 'CA' AND upper(city) = 'LOS ANGELES'")(
    lambda s, d: readers.market_scope(_licensed(s, d), "CA", core_cities=["Los Angeles"]).select("id", "name", "city")
)

_rank = " ".join(f"WHEN contains(lower(x), '{t}') THEN {k}" for k, t in enumerate(readers.TITLE_RANK))
PRINCIPALS = f"""WITH r AS ({REGISTER}), t AS (SELECT *, trim(licence) AS lic, list_filter(string_split(person, ' '), lambda x: x <> '') AS parts FROM r WHERE licence IS NOT NULL),
u AS (SELECT * FROM t WHERE len(parts) > 0 QUALIFY row_number() OVER (PARTITION BY lic ORDER BY pos) = 1),
v AS (SELECT lic, lower(array_to_string(CASE WHEN len(parts) > 1 THEN list_concat(parts[2:], parts[1:1]) ELSE parts END, ' ')) AS low,
  list_filter(list_transform(string_split(titles, '|'), lambda x: trim(x)), lambda x: x <> '') AS ts FROM u)
SELECT lic AS licence_number, array_to_string(list_transform(regexp_extract_all(low, '[^a-z]*[a-z]+'), lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x[1] || upper(x[2]) || x[3:] END), '') AS person,
  list_sort(list_transform(ts, lambda x, i: {{'r': CASE {_rank} ELSE 99 END, 'i': i, 't': x}}))[1].t AS person_title FROM v"""


@query("S3_principal_best", PRINCIPALS)
def principal_best(s: SparkSession, d: str) -> DataFrame:
    return readers.principal_best(_personnel(s, d)).select("licence_number", "person", "person_title")


@query("S5_map_elements", f"""SELECT 'osm:' || type || ':' || CAST(id AS STRING) AS id, coalesce(t_name, t_operator) AS name,
  CASE WHEN t_amenity = 'dentist' THEN 'Dental' WHEN t_shop = 'laundry' THEN 'Laundry' WHEN t_shop = 'hvac' THEN 'HVAC' END AS industry,
  CASE WHEN t_website <> '' THEN t_website ELSE 'https://' || t_url END AS website, 'OH' AS state, coalesce(lat, center_lat) AS latitude,
  CASE WHEN t_start <> '1700' THEN CAST(left(t_start, 4) AS INT) END AS founded_year FROM ({ELEMENTS_SQL.format(customer='customer')}) WHERE coalesce(t_name, t_operator) IS NOT NULL""")  # fmt: skip
def map_elements(s: SparkSession, d: str) -> DataFrame:
    return readers.map_elements(_elements(s, d), AS_OF_YEAR, "OH").select("id", "name", "industry", "website", "state", "latitude", "founded_year")


query("S5_element_files", SQL["S5_map_elements"])(lambda s, d: readers.map_elements(readers.element_files(s, _element_folder(s, d), multi_line=False), AS_OF_YEAR, "OH").select("id", "name", "industry", "website", "state", "latitude", "founded_year"))


def _element_folder(s: SparkSession, d: str) -> str:
    """The elements as responses of the map service, of at most 500 elements each, one a line."""
    path = fresh_path(s, "elements")
    element = F.struct("type", "id", "lat", "lon", "center", F.map_filter("tags", lambda _, v: v.isNotNull()).alias("tags"))
    _elements(s, d).groupBy(F.floor(F.col("pos") / 500).alias("_part")).agg(F.collect_list(element).alias("elements")).select(F.lit(0.6).alias("version"), "elements").write.json(path)
    return path


def _elements(s: SparkSession, d: str) -> DataFrame:
    rows = s.sql(ELEMENTS_SQL, customer=_table(s, d, "customer"))
    keys = {"name": "t_name", "operator": "t_operator", "amenity": "t_amenity", "shop": "t_shop", "url": "t_url", "website": "t_website", "start_date": "t_start"}
    tags = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.col(v))])
    center = F.struct(F.col("center_lat").alias("lat"), F.lit(0.0).alias("lon"))
    return rows.select("pos", "id", "type", "lat", F.lit(None).cast("double").alias("lon"), center.alias("center"), tags.alias("tags"))


def _leads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return readers.lead_list(s.sql(LEADS_SQL, customer=_table(s, d, "customer")).toDF(*LEAD_HEADERS), AS_OF_YEAR)


LEADS = LEADS_SQL.format(customer="customer")
LEAD_COLUMNS = """name, 'https://' || site AS website, sector AS industry,
  CASE staff WHEN '11-50' THEN 50 WHEN '1,200' THEN 1200 END AS employee_count, CASE money WHEN '$5.2M' THEN 5.2e6 WHEN '1,250,000' THEN 1.25e6 WHEN '900K' THEN 9e5 WHEN '2B' THEN 2e9 END AS revenue_usd,
  CASE founded WHEN '1999' THEN 1999 END AS founded_year, nullif(trim(person), '') AS contact_name, CASE WHEN coalesce(nullif(trim(person), ''), mail, phone) IS NOT NULL THEN job END AS contact_title, mail AS email, phone,
  CASE WHEN coalesce(nullif(trim(person), ''), mail, phone) IS NOT NULL THEN nullif(trim(person), '') IS NOT NULL END AS is_decision_maker"""


def _lead_columns(rows: DataFrame) -> DataFrame:
    first = F.get("contacts", F.lit(0))
    contact = [first[c].alias(f"contact_{c}" if c in ("name", "title") else c) for c in ("name", "title", "email", "phone", "is_decision_maker")]
    return rows.select("name", "website", "industry", "employee_count", "revenue_usd", "founded_year", *contact)


query("S6_lead_list", f"SELECT {LEAD_COLUMNS} FROM ({LEADS}) WHERE name IS NOT NULL")(lambda s, d: _lead_columns(_leads(s, d)[0]))


def _lead_folder(s: SparkSession, d: str) -> str:
    """The leads as CSV files of two kinds: the second has other headers in another order, and rows that end early."""
    rows, path = s.sql(LEADS_SQL, customer=_table(s, d, "customer")).toDF(*LEAD_HEADERS), fresh_path(s, "leads")
    rows.filter("pos % 2 = 0").drop("pos").write.option("header", True).csv(f"{path}/one")
    other = {"Company Name": "organization", "Web-Site": "URL", "Employees": "headcount", "Sector": "vertical", "Decision-Maker": "owner name", "E-Mail": "work_email", "Estimated Revenue": "sales", "Year Founded": "established"}
    second = rows.filter("pos % 2 = 1").drop("pos", "Notes").withColumnsRenamed(other)
    second.select(*reversed(second.columns)).write.option("header", True).csv(f"{path}/two")
    return f"{path}/*"


query("S6_lead_files", f"SELECT {LEAD_COLUMNS} FROM ({LEADS}) WHERE name IS NOT NULL")(lambda s, d: _lead_columns(readers.lead_files(s, _lead_folder(s, d), AS_OF_YEAR)[0]))


@query("A10_file_reports", f"SELECT count(name) AS kept, count(*) - count(name) AS skipped, 0 AS malformed, CASE WHEN pos % 2 = 0 THEN 'Notes' ELSE '' END AS unmapped FROM ({LEADS}) GROUP BY pos % 2")
def file_reports(s: SparkSession, d: str) -> DataFrame:
    report = readers.lead_files(s, _lead_folder(s, d), AS_OF_YEAR)[1]
    return report.groupBy("unmapped").agg(*[F.sum(c).alias(c) for c in ("kept", "skipped", "malformed")])


query("A10_ingest_report", f"SELECT count(name) AS kept, count(*) - count(name) AS skipped, 'Notes' AS unmapped FROM ({LEADS})")(lambda s, d: _leads(s, d)[1])


@query("S7_snapshot_load", f"SELECT state AS market, id, name, city FROM ({FLAT})")
def snapshot_load(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of at most 500 companies each, one a line, written and read back."""
    part = F.floor(F.col("pos") / 500)
    whole = flat(s, d).groupBy("state", part.alias("part")).agg(F.collect_list(F.struct("id", "name", "city")).alias("companies"))
    path = fresh_path(s, "snapshots")
    whole.select(F.col("state").alias("market"), F.lit("2026-09-01").alias("generated_at"), F.array(F.lit("demo")).alias("sources"), "companies").write.json(path)
    return readers.snapshot_load(s, path, "id:string,name:string,city:string", multi_line=False).select("market", "id", "name", "city")


FETCHES = FETCHES_SQL.format(events="events")
query("S9_page_latest", f"""SELECT left(sha256('GET ' || lower(regexp_extract(url, '^[^:]+://[^/]*')) || '/Page'), 32) AS cache_key, body FROM ({FETCHES})
WHERE expires_at > TIMESTAMP '2026-09-01 00:00:00' AND status = 200 QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY fetched_at DESC, body DESC) = 1""")(  # fmt: skip
    lambda s, d: readers.page_latest(s.sql(FETCHES_SQL, events=_table(s, d, "events")), F.lit("2026-09-01 00:00:00").cast("timestamp")).select("cache_key", "body")
)


PURGE_AT = "2024-02-10 07:30:00"
STORED_SQL = """SELECT 'https://s' || CAST(user_id AS STRING) || '.com/' || CAST(event_id AS STRING) AS url, ts AS fetched_at, ts + make_dt_interval(CAST(event_id % 60 AS INT)) AS expires_at, 200 AS status, event_type AS body FROM {events}"""


@query("S9_page_purge", f"SELECT 'https://s' || CAST(user_id AS STRING) || '.com/' || CAST(event_id AS STRING) AS url, event_type AS body, count(*) FILTER (WHERE gone) OVER () AS removed FROM (SELECT *, ts + to_days(CAST(event_id % 60 AS INT)) <= TIMESTAMP '{PURGE_AT}' AS gone FROM events) QUALIFY NOT gone")
def page_purge(s: SparkSession, d: str) -> DataFrame:
    """The pages that are left of a store after a purge."""
    fetches, path = s.sql(STORED_SQL, events=_table(s, d, "events")), fresh_path(s, "pages")
    store.write_pages(fetches, path)
    removed = store.purge_pages(s, path, fetches.schema, dt.datetime.fromisoformat(PURGE_AT))
    return s.read.schema(fetches.schema).parquet(path).select("url", "body", F.lit(removed).cast("long").alias("removed"))


@query("K2_market_upsert", f"SELECT state AS market, CASE WHEN starts_with(state, 'A') THEN 'new' ELSE 'old' END AS generated_at, count(*) AS companies FROM ({FLAT}) GROUP BY 1, 2")
def market_upsert(s: SparkSession, d: str) -> DataFrame:
    base = flat(s, d).groupBy(F.col("state").alias("market")).agg(F.lit("old").alias("generated_at"), F.count("*").alias("companies"))
    return store.keyed_table(base, fresh_path(s, "markets"), "market", buckets=8).upsert(base.filter("market LIKE 'A%'").withColumn("generated_at", F.lit("new")))


@query("K6_snapshot_write", f"{TOTAL} SELECT id, score_raw FROM r")
def snapshot_write(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "snapshot")
    sinks.write_snapshot(scored(s, d), path, "demo", ["demo"], "2026-09-01")
    return s.read.schema("id string, score_raw double").json(f"{path}/companies")


FOLDED = f"""WITH f AS ({FLAT}), c AS ({contact_sql(f"SELECT id, html FROM ({PAGES})")}), k AS (SELECT * FROM c WHERE coalesce(name, email, phone, linkedin_url) IS NOT NULL)
SELECT f.id, 0 AS place, coalesce(contact_name, k.name) AS name, coalesce(contact_title, k.title) AS title, coalesce(f.email, k.email) AS email, email_status, f.phone, phone_valid, f.linkedin_url,
  is_decision_maker OR k.name IS NOT NULL AS is_decision_maker FROM f LEFT JOIN k USING (id) WHERE has_contact
UNION ALL SELECT f.id, 0, k.name, k.title, k.email, 'unknown', k.phone, NULL, k.linkedin_url, k.name IS NOT NULL FROM f JOIN k USING (id) WHERE NOT has_contact"""


@query("P10_fold_contacts", FOLDED)
def fold_contacts(s: SparkSession, d: str) -> DataFrame:
    found = pages.page_contacts(pages.page_signals(demo_pages(s, d), AS_OF_YEAR))
    return contacts.flat_contacts(pages.fold_contacts(companies(s, d), found))


@query("P12_site_proof", f"SELECT f.id, page_id, {proof_sql('f.name', 'f.city', 'f.phone', 'g.html')} AS method FROM ({PAGES}) g JOIN ({FLAT}) f ON f.id = g.id")
def site_proof(s: SparkSession, d: str) -> DataFrame:
    facts = companies(s, d).select("id", "name", "city", F.get("contacts", F.lit(0))["phone"].alias("licence_phone"))
    return pages.site_proof(demo_pages(s, d).join(facts, "id")).select("id", "page_id", "method")


def _stores(s: SparkSession, rows: DataFrame) -> flows.Stores:
    return flows.Stores(store.keyed_table(rows, fresh_path(s, "refresh-companies"), "id"), fresh_path(s, "refresh-payloads"), fresh_path(s, "refresh-scores"))


@query("X3_refresh_batch")
def refreshed(s: SparkSession, d: str) -> DataFrame:
    """The batch's companies after all three writes, with what history and payloads hold of them."""
    rows = companies(s, d)
    scored_ = flows.refresh_batch(rows, demo_pages(s, d), mail_facts(s, d), AS_OF_YEAR, demo_pages(s, d))
    updated, payloads, history = flows.save_refresh(scored_, _stores(s, rows), "2026-09-01")
    kept = history.join(payloads.select("company_id"), "company_id").withColumnRenamed("company_id", "id")
    return updated.join(kept, "id").select("id", "website", "score", "confidence", F.size("contacts").alias("n_contacts"), "cache_key")


REFRESHED = f"""WITH f AS ({FLAT}), c AS ({contact_sql(f"SELECT id, html FROM ({WITH_SECONDARY})")}), g AS ({PAGES}),
m AS (SELECT f.id, website, has_contact, g.url, {proof_sql('f.name', 'f.city', 'f.phone', 'g.html')} AS method, coalesce(c.name, c.email, c.phone, c.linkedin_url) IS NOT NULL AS found FROM f JOIN g USING (id) JOIN c USING (id))
SELECT id, coalesce(website, CASE WHEN method IS NOT NULL THEN url END) AS website, CASE WHEN has_contact OR found AND (website IS NOT NULL OR method IS NOT NULL) THEN 1 ELSE 0 END AS n_contacts FROM m"""
query("X3_refresh_contacts", REFRESHED)(lambda s, d: refreshed(s, d).select("id", "website", "n_contacts"))


STREAMED = f"""WITH r AS ({REFRESHED}), e AS (SELECT DISTINCT 'cust:' || CAST(user_id AS STRING) AS id FROM events)
SELECT f.id, CASE WHEN e.id IS NOT NULL AND r.id IS NOT NULL THEN r.website ELSE f.website END AS website, CASE WHEN e.id IS NOT NULL AND r.id IS NOT NULL THEN n_contacts ELSE CAST(has_contact AS INT) END AS n_contacts,
  CAST(e.id IS NOT NULL AND r.id IS NOT NULL AS INT) AS n_scores FROM ({FLAT}) f LEFT JOIN r USING (id) LEFT JOIN e USING (id)"""


@query("X4_refresh_flow", STREAMED)
def refresh_flow(s: SparkSession, d: str) -> DataFrame:
    """The stream of refreshes runs X3 on each batch, over what the batches before it left; the companies and their history after it."""
    rows, fetched, facts = companies(s, d), demo_pages(s, d), mail_facts(s, d)
    stores = _stores(s, rows)

    def refresh(batch: DataFrame, epoch: int) -> None:
        ids = batch.select(F.concat(F.lit("cust:"), F.col("company_id").cast("string")).alias("id"))
        flows.refresh_stored(ids, stores, fetched, facts, AS_OF_YEAR, "2026-09-01", "stream", epoch, fetched)

    stream_refreshes(s, d, _table(s, d, "events").schema, refresh)
    times = s.read.parquet(stores.scores).groupBy(F.col("company_id").alias("id")).agg(F.count("*").cast("int").alias("n_scores"))
    return stores.companies.read().join(times, "id", "left").select("id", "website", F.size("contacts").alias("n_contacts"), F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


@query("X2_score_list", f"SELECT 'import:' || CAST(pos AS STRING) AS id, name, kept, skipped, unmapped FROM ({LEADS}), (SELECT count(name) AS kept, count(*) - count(name) AS skipped, 'Notes' AS unmapped FROM ({LEADS})) WHERE name IS NOT NULL")
def score_list(s: SparkSession, d: str) -> DataFrame:
    scored_, report = flows.score_list(s.sql(LEADS_SQL, customer=_table(s, d, "customer")).toDF(*LEAD_HEADERS), mail_facts(s, d), AS_OF_YEAR)
    return scored_.crossJoin(F.broadcast(report)).select("id", "name", "kept", "skipped", "unmapped")


#: A lead list's companies as the flat table that scores and quality are told from in SQL: nothing was crawled, contacts are checked.
LEAD_FLAT = rf"""SELECT pos, {LEAD_COLUMNS.replace("mail AS email, phone,", "lower(mail) AS email, CASE WHEN regexp_matches(g, '^1?[2-9][0-9]{2}[2-9][0-9]{6}$') THEN '+1' || right(g, 10) ELSE phone END AS phone,")},
  'import:' || CAST(pos AS STRING) AS id, CASE WHEN lower(split_part(mail, '@', 2)) IN (SELECT DISTINCT lower(split_part(email, '@', 2)) FROM ({FLAT}) WHERE email IS NOT NULL)
    THEN list_extract(['unknown', 'invalid', 'risky', 'verified', 'verified'], CAST(length(split_part(mail, '@', 2)) % 5 AS INT) + 1) ELSE 'unknown' END AS email_status,
  CASE WHEN phone IS NOT NULL THEN regexp_matches(g, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') END AS phone_valid, coalesce(nullif(trim(person), ''), mail, phone) IS NOT NULL AS has_contact,
  NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS postcode, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, NULL::VARCHAR AS business_type, NULL::BOOLEAN AS has_employees, NULL::VARCHAR AS linkedin_url, FALSE AS crawled, NULL::BOOLEAN AS https,
  NULL::BOOLEAN AS mobile_viewport, NULL::BOOLEAN AS has_analytics, NULL::INT AS latest_content_year, NULL::INT AS copyright_year, NULL::INT AS page_bytes, NULL::VARCHAR AS tech, FALSE AS has_careers_page, FALSE AS has_team_page, NULL::INT AS web_founded_year,
  NULL::VARCHAR AS raw_text_excerpt, NULL::BIGINT AS sibling_location_count, NULL::BIGINT AS peer_count_in_niche FROM (SELECT *, regexp_replace(phone, '\D', '', 'g') AS g FROM ({LEADS})) WHERE name IS NOT NULL"""
_LEAD_QUALITY = QUALITY.replace(FLAT, LEAD_FLAT).replace("WHEN TRUE THEN", "WHEN postcode IS NOT NULL OR latitude IS NOT NULL THEN").replace("NOT (TRUE)", "NOT (postcode IS NOT NULL OR latitude IS NOT NULL)")
LIST_SCORES = f"""WITH t AS ({TOTAL.replace(FLAT, LEAD_FLAT)} SELECT id, round(score_raw, 1) AS score, round(covered, 4) AS covered_weight, coalesce(is_decision_maker, FALSE) AS is_decision_maker FROM r), q AS ({_LEAD_QUALITY})
SELECT id, score, covered_weight, data_quality, is_decision_maker FROM t JOIN q USING (id)"""


@query("X2_list_scores", LIST_SCORES)
def list_scores(s: SparkSession, d: str) -> DataFrame:
    scored_, _ = flows.score_list(s.sql(LEADS_SQL, customer=_table(s, d, "customer")).toDF(*LEAD_HEADERS), mail_facts(s, d), AS_OF_YEAR)
    decides = F.coalesce(F.get("contacts", F.lit(0))["is_decision_maker"], F.lit(False)).alias("is_decision_maker")
    return scored_.select("id", "score", "covered_weight", "data_quality", decides)


def _personnel(s: SparkSession, d: str) -> DataFrame:
    return s.sql(REGISTER_SQL, orders=_table(s, d, "orders")).select("pos", F.col("licence").alias("LIC-NO"), F.col("person").alias("Name"), F.col("titles").alias("EMP-Titl-CDE"))


def _collected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mapped = readers.map_elements(_elements(s, d), AS_OF_YEAR, "CA").filter("industry IS NOT NULL")
    fetched = demo_pages(s, d).select("url", "html")
    return flows.collect(register(s, d), _personnel(s, d), mapped, fetched, mail_facts(s, d), AS_OF_YEAR, 250, "CA")


query("X1_collect")(lambda s, d: _collected(s, d)[0].select("id", "industry", "website", "score", "data_quality"))
query("X1_summary")(lambda s, d: _collected(s, d)[1])


LICENSED = f"""WITH c AS ({COMPANY} SELECT id, name, industry, postcode, phone FROM s), p AS ({PRINCIPALS}), k AS (SELECT name, count(DISTINCT id) AS premises FROM c GROUP BY 1)
SELECT id, name, industry, CASE WHEN postcode IS NOT NULL THEN count(*) OVER (PARTITION BY industry, postcode) - 1 END AS peer_count_in_niche, premises AS sibling_location_count,
  CASE WHEN phone IS NOT NULL THEN person END AS contact_name FROM c JOIN k USING (name) LEFT JOIN p ON id = 'cslb:' || licence_number"""


@query("X1_collect_licensed", LICENSED)
def collect_licensed(s: SparkSession, d: str) -> DataFrame:
    """The register's companies with their principals, peers and chains, as the collecting job starts."""
    rows = match.attach_principal(_licensed(s, d), principal_best(s, d))
    annotated = annotate.chain_locations(annotate.peer_density(rows))
    return annotated.select("id", "name", "industry", "peer_count_in_niche", "sibling_location_count", F.get("contacts", F.lit(0))["name"].alias("contact_name"))
