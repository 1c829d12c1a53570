"""A company table derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_YEAR = 2026

#: One row per customer; the flat columns of a company, its one contact and its website.
FLAT_SQL = """
SELECT
  'cust:' || CAST(c AS STRING) AS id, c AS pos,
  p_name || ' ' || CAST(c % 40 AS STRING) || CASE c7 % 4 WHEN 0 THEN '' WHEN 1 THEN ' Inc' WHEN 2 THEN ' LLC' ELSE ' & Co' END AS name,
  c_mktsegment AS industry, n_name AS city, r_name AS state, CAST(90000 + c % 97 AS STRING) AS postcode,
  CASE WHEN c % 3 <> 0 THEN 34.05e0 + CAST(c % 23 AS DOUBLE) * 0.03e0 END AS latitude,
  CASE WHEN c % 3 <> 0 THEN -118.40e0 + CAST(c % 35 AS DOUBLE) * 0.03e0 END AS longitude,
  CASE WHEN c % 11 <> 0 THEN CAST(1950 + c % 75 AS INT) END AS founded_year,
  CASE c % 6 WHEN 0 THEN 'Sole Owner' WHEN 1 THEN 'Partnership' WHEN 2 THEN 'Limited Liability' WHEN 3 THEN 'Corporation' WHEN 4 THEN 'JointVenture' END AS business_type,
  CASE c3 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS has_employees,
  CASE WHEN c % 5 <> 0 THEN CAST((c * 7) % 150 AS INT) END AS employee_count,
  CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000e0 END AS revenue_usd,
  CASE WHEN c % 4 <> 3 THEN 'https://www.Shop' || CAST(c % 400 AS STRING) || '.example' || CAST(c % 3 AS STRING) || '.com/home?x=1' END AS website,
  CASE WHEN c % 13 <> 0 THEN TRUE ELSE FALSE END AS has_contact,
  CASE WHEN c % 5 <> 4 AND c % 13 <> 0 THEN CASE WHEN c % 31 = 0 THEN 'not an address' WHEN c % 2 = 0 THEN 'info' ELSE 'owner' || CAST(c AS STRING) END
    || CASE WHEN c % 37 = 0 THEN '@yopmail.com' ELSE '@Mail' || CAST(c % 300 AS STRING) || '.com' END END AS email,
  CASE WHEN c % 13 <> 0 THEN CASE c % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'risky' WHEN 2 THEN 'invalid' ELSE 'unknown' END END AS email_status,
  CASE WHEN c % 7 <> 0 AND c % 13 <> 0 THEN '(614) 2' || CAST(10 + c % 90 AS STRING) || '-' || CAST(1000 + c % 900 AS STRING) END AS phone,
  CASE WHEN c % 13 <> 0 THEN c % 2 = 0 END AS phone_valid,
  CASE WHEN c % 4 = 0 AND c % 13 <> 0 THEN 'Pat Doe' || CAST(c AS STRING) END AS contact_name,
  CASE WHEN c % 4 = 0 AND c % 13 <> 0 THEN CASE WHEN c % 8 = 0 THEN 'Owner and Manager' ELSE 'Clerk' END END AS contact_title,
  CASE WHEN c % 9 = 0 AND c % 13 <> 0 THEN 'https://linkedin.com/in/p' || CAST(c AS STRING) END AS linkedin_url,
  c % 8 = 0 AND c % 13 <> 0 AS is_decision_maker,
  c % 2 <> 0 AS crawled,
  CASE WHEN c % 2 <> 0 THEN CASE c3 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END END AS https,
  CASE WHEN c % 2 <> 0 THEN CASE c7 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END END AS mobile_viewport,
  CASE WHEN c % 2 <> 0 THEN CASE c % 5 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END END AS has_analytics,
  CASE WHEN c % 2 <> 0 AND c % 5 <> 0 THEN CAST(2005 + c % 22 AS INT) END AS latest_content_year,
  CASE WHEN c % 2 <> 0 AND c % 3 <> 0 THEN CAST(2001 + c % 26 AS INT) END AS copyright_year,
  CASE WHEN c % 2 <> 0 THEN CAST((c * 37) % 60000 AS INT) END AS page_bytes,
  CASE WHEN c % 2 <> 0 THEN CASE c % 7 WHEN 0 THEN 'Next.js' WHEN 1 THEN 'FrontPage' WHEN 2 THEN 'Wordpress' WHEN 3 THEN 'Joomla' END END AS tech,
  CASE WHEN c % 2 <> 0 THEN c % 6 = 1 ELSE FALSE END AS has_careers_page,
  CASE WHEN c % 2 <> 0 THEN c % 5 = 1 ELSE FALSE END AS has_team_page,
  CASE WHEN c % 2 <> 0 AND c % 11 = 0 THEN CAST(1990 + c % 30 AS INT) END AS web_founded_year,
  CASE WHEN c % 2 <> 0 THEN CASE c % 10
    WHEN 1 THEN 'Welcome. We are a family-owned business serving central Ohio since 1979. Call us.'
    WHEN 3 THEN 'A portfolio company of Meridian Capital Partners.'
    WHEN 5 THEN 'Owner-operated shop. Founded in 1985 by our founder.'
    WHEN 7 THEN 'Quality work at fair prices.' END END AS raw_text_excerpt,
  CASE WHEN c % 17 = 0 THEN CAST(3 + c % 5 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS sibling_location_count,
  CASE WHEN c % 19 <> 0 THEN CAST((c * 3) % 140 AS BIGINT) END AS peer_count_in_niche
FROM (
  SELECT c_custkey AS c, CAST(floor(c_custkey / 3.0) AS BIGINT) AS c3, CAST(floor(c_custkey / 7.0) AS BIGINT) AS c7,
         c_acctbal, c_mktsegment, p_name, n_name, r_name
  FROM {customer} JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
) b
"""

#: A fetched page for each company whose number is a page's; some name the company and its city, some link its phone.
PAGES_SQL = """
SELECT p.page_id AS page_id, f.id AS id,
  CASE WHEN p.page_id % 4 = 0 THEN p.url ELSE 'https://' || lower(replace(replace(replace(replace(f.name, ' Inc', ''), ' LLC', ''), ' & Co', ''), ' ', '')) || '.com' END AS url,
  p.html || CASE p.page_id % 4 WHEN 1 THEN '<p>' || f.name || ' of ' || f.city || '.</p>' WHEN 2 THEN '<a href="tel:+1-' || coalesce(f.phone, '') || '">Call us</a>' ELSE '' END
    || CASE WHEN p.page_id % 3 = 0 THEN '<a href="about/us.html">Who</a> <a href="../team?x=1#top">About <b>us</b></a> <a href="mailto:a@b.co">mail</a>' ELSE '' END AS html
FROM {pages} p JOIN ({flat}) f ON f.pos = p.page_id
"""

#: The same for DuckDB, whose views have the tables' own names.
FLAT = FLAT_SQL.format(customer="customer", part="part", nation="nation", region="region")

PAGES = PAGES_SQL.format(pages="pages", flat=FLAT)

CONTACT = ["name", "title", "email", "email_status", "phone", "phone_valid", "linkedin_url", "is_decision_maker"]


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat company table."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part", "nation", "region")}
    return spark.sql(FLAT_SQL, **tables)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetched pages: page_id, id of the company, url, html."""
    tables = {"pages": spark.read.parquet(f"{sf_dir}/pages.parquet"), "flat": flat(spark, sf_dir)}
    return spark.sql(PAGES_SQL.format(pages="{pages}", flat="SELECT * FROM {flat}"), **tables)


def nest(rows: DataFrame) -> DataFrame:
    """Flat companies as the nested COMPANY record: contacts[] and web."""
    contact = F.struct(
        F.col("contact_name").alias("name"), F.col("contact_title").alias("title"), "email", "email_status", "phone", "phone_valid", "linkedin_url", "is_decision_maker"
    )
    none = F.array().cast("array<struct<name:string,title:string,email:string,email_status:string,phone:string,phone_valid:boolean,linkedin_url:string,is_decision_maker:boolean>>")
    web = F.struct(
        F.when(F.col("crawled"), F.lit("2026-08-01 00:00:00").cast("timestamp")).alias("fetched_at"), "https", "mobile_viewport", "has_analytics",
        F.lit(None).cast("string").alias("generator"), "copyright_year", "latest_content_year", "page_bytes",
        F.array_compact(F.array("tech")).alias("tech_hints"), "has_careers_page", "has_team_page", F.col("web_founded_year").alias("founded_year"),
        F.array().cast("array<string>").alias("owner_mentions"), F.array().cast("array<string>").alias("pe_backed_mentions"), "raw_text_excerpt",
    )
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return rows.select(
        "id", "pos", "name", null("string", "domain"), "website", "industry", "city", "state", F.lit("US").alias("country"), "postcode", "latitude", "longitude",
        "employee_count", F.lit(False).alias("employee_count_is_estimate"), "revenue_usd", F.lit(False).alias("revenue_is_estimate"), "founded_year", "business_type",
        "has_employees", null("string", "licence_number"), null("date", "licence_issued"), F.when(F.col("has_contact"), F.array(contact)).otherwise(none).alias("contacts"),
        web.alias("web"), "peer_count_in_niche", "sibling_location_count", F.lit("demo").alias("source"), null("string", "source_url"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(flat(spark, sf_dir))
