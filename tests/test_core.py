from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators import pages
from bizfit.operators.graph import connected_components
from bizfit.operators.match import token_sort_ratio
from bizfit.plans.demo import nest
from bizfit.plans.flows import refresh_batch


def test_components_of_a_path_and_a_star(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 120)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_token_sort_ratio():
    assert token_sort_ratio("a b", "b a") == 100.0
    assert token_sort_ratio("abc", "xyz") == 0.0


def test_keys(spark):
    row = spark.range(1).select(
        C.domain(F.lit("HTTPS://user@WWW.Shop.Example.co.uk:80/x")).alias("d"), C.registrable(F.lit("a.shop.example.co.uk")).alias("r"),
        C.name_core(F.lit("The Smith & Sons, Inc.")).alias("n"), C.name_core(F.lit("The Company Inc")).alias("e"), C.money(F.lit("$5.2M")).alias("m"),
        C.whole_number(F.lit("11-50")).alias("w"), C.parse_date(F.lit("05/23/87")).cast("string").alias("t"), C.postcode5(F.lit("910013754")).alias("p"),
    ).first()
    assert tuple(row) == ("shop.example.co.uk", "example.co.uk", "smith sons", "the company inc", 5200000.0, 50, "1987-05-23", "91001")


def test_mentions_keep_leading_digits(spark):
    text = "We sell pipes to all. 1979 saw us start as a family-owned shop in Ohio. 2 more shops are owner-operated today."
    got = spark.range(1).select(pages.mentions(F.lit(text), pages.OWNERSHIP).alias("m")).first()["m"]
    assert got == ["1979 saw us start as a family-owned shop in Ohio.", "2 more shops are owner-operated today."]


def test_refresh_batch_returns_only_companies_with_a_page(spark):
    page = "<html><body>" + "<p>Welcome to our shop.</p>" * 40 + "<p>Pat Smith, Owner</p><a href='mailto:pat@acme.com'>pat@acme.com</a></body></html>"
    flat_rows = spark.sql(
        "SELECT 'cust:' || id AS id, id AS pos, 'Acme ' || id AS name, 'https://acme.com' AS website, 'hvac' AS industry, 'Columbus' AS city, 'OH' AS state, '43004' AS postcode, 1.0D AS latitude, 1.0D AS longitude,"
        " 5 AS employee_count, 1e6D AS revenue_usd, 1990 AS founded_year, 'Corporation' AS business_type, true AS has_employees, id = 2 AS has_contact, '' AS contact_name, '' AS contact_title, '' AS email,"
        " 'unknown' AS email_status, '' AS phone, false AS phone_valid, '' AS linkedin_url, false AS is_decision_maker, false AS crawled, false AS https, false AS mobile_viewport, false AS has_analytics,"
        " 2000 AS copyright_year, 2000 AS latest_content_year, 10 AS page_bytes, 'x' AS tech, false AS has_careers_page, false AS has_team_page, 1990 AS web_founded_year, '' AS raw_text_excerpt,"
        " 1L AS peer_count_in_niche, 1L AS sibling_location_count FROM range(1, 4)"
    )
    fetched = spark.createDataFrame([("cust:1", "https://acme.com", page), ("cust:2", "https://acme.com", None)], "id string, url string, html string")
    facts = spark.createDataFrame([("acme.com", ["mx1"], True)], "domain string, mx array<string>, exists boolean")
    got = {r["id"]: r for r in refresh_batch(nest(flat_rows), fetched, facts, 2026).collect()}
    assert got.keys() == {"cust:1", "cust:2"}
    assert (got["cust:1"]["contacts"][0]["email"], got["cust:1"]["contacts"][0]["email_status"]) == ("pat@acme.com", "verified")
