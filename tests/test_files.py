"""Files as they come: lead lists with headers of their own, map responses, and number texts."""

import json

import pytest
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.sources import readers


def lists(spark, tmp_path, files, **more):
    for name, text in files.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    companies, report = readers.lead_files(spark, str(tmp_path), 2026, **more)
    return companies, {r["file"].rsplit("/", 1)[1]: (r["kept"], r["skipped"], r["malformed"], r["unmapped"]) for r in report.collect()}


def test_mixed_broken_and_marked_files(spark, tmp_path):
    files = {
        "a.csv": "﻿Company Name,Website,Employees,Estimated Revenue,City\nWhitaker HVAC,whitakerhvac.com,42,$5.2M,Glendale\n,x.com,1,1,Burbank\n",
        "b.csv": 'E-MAIL,company_name,Favourite Colour,Owner,Year Founded,Zip\n,"Acme, ""Best"" Co",red,Pat Doe,Est. 1985,91203-1\na@b.com,Second\nc@d.com,Third,blue,,x,1,too,many\n',
        "c.csv": "Company,Business Name,Revenue\nFirst,Other,\"1,250,000\"\n",
        "d.csv": "just,some,headers\n",
        "e.csv": "",
        "f.csv": 'Company Name,Website,Employees,Estimated Revenue,City\nLine Breaker,http://lb.com,11-50,900K,"Two\nLines"\n',
        "g.csv": b"Company,City\n\xff\xfe broken,Gl\xe9n\n",
    }
    companies, report = lists(spark, tmp_path, files)
    rows = {r["name"]: r for r in companies.collect()}
    assert report["a.csv"] == (1, 1, 0, "") and report["b.csv"] == (3, 0, 2, "Favourite Colour") and report["c.csv"] == (1, 0, 0, "Business Name")
    assert report["d.csv"] == (0, 0, 0, "just, some, headers") and "e.csv" not in report and report["f.csv"] == (1, 0, 0, "") and report["g.csv"][0] == 1
    first = rows["Whitaker HVAC"]
    assert (first["id"], first["website"], first["employee_count"], first["revenue_usd"], first["contacts"], first["source"]) == ("import:1", "https://whitakerhvac.com", 42, 5.2e6, [], "import")
    acme = rows['Acme, "Best" Co']
    assert acme["postcode"] == "91203-1" and acme["founded_year"] == 1985 and acme["contacts"][0]["name"] == "Pat Doe" and acme["contacts"][0]["is_decision_maker"]
    assert rows["Second"]["contacts"][0]["email"] == "a@b.com" and not rows["Second"]["contacts"][0]["is_decision_maker"] and rows["Second"]["postcode"] is None
    assert rows["Third"]["postcode"] == "1" and rows["First"]["revenue_usd"] == 1.25e6
    assert rows["Line Breaker"]["city"] == "Two\nLines" and rows["Line Breaker"]["employee_count"] == 50 and rows["Line Breaker"]["website"] == "http://lb.com"
    assert len({r["id"] for r in rows.values()}) == len(rows) == 7


def test_only_files_without_rows(spark, tmp_path):
    companies, report = lists(spark, tmp_path, {"a.csv": "", "b.csv": "Company,City\n"})
    assert companies.count() == 0 and report == {"b.csv": (0, 0, 0, "")}


def test_large_lists_are_split(spark, tmp_path):
    text = "Company,Employees\n" + "".join(f"Company {k},{k}\n" for k in range(5000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        companies, report = lists(spark, tmp_path, {"a.csv": text, "b.csv": "Company\nLast\n"}, multi_line=False)
        rows = companies.select("pos", "name").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == [(k + 1, f"Company {k}") for k in range(5000)] + [(5001, "Last")]
    assert report == {"a.csv": (5000, 0, 0, ""), "b.csv": (1, 0, 0, "")}


def test_map_responses(spark, tmp_path):
    answers = {
        "a.json": {"version": 0.6, "elements": [{"type": "node", "id": 1, "lat": 34.1, "lon": -118.2, "tags": {"name": "Pipes", "craft": "plumber", "odd:key": "x", "level": 2}}, {"type": "node", "id": 2, "lat": 1.0, "lon": 2.0}]},
        "b.json": {"elements": [{"type": "way", "id": 3, "center": {"lat": 34.2, "lon": -118.3}, "tags": {"operator": "Sparks", "craft": "electrician", "contact:email": "a@b.com", "website": "sparks.com"}}, {"type": "relation", "id": 4, "tags": {"name": "Bare"}}]},
        "c.json": {"remark": "timeout"},
        "d.json": {"elements": []},
    }
    for name, answer in answers.items():
        (tmp_path / name).write_text(json.dumps(answer, indent=1))
    (tmp_path / "e.json").write_text('{"elements": [{"type": "node"')
    elements = readers.element_files(spark, str(tmp_path))
    assert [(r["pos"], r["id"]) for r in elements.orderBy("pos").collect()][:4] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert elements.filter("id = 1").first()["tags"]["odd:key"] == "x"
    rows = {r["id"]: r for r in readers.map_elements(elements, 2026, "CA").collect()}
    assert set(rows) == {"osm:node:1", "osm:way:3", "osm:relation:4"}
    assert (rows["osm:way:3"]["latitude"], rows["osm:way:3"]["name"], rows["osm:way:3"]["website"], rows["osm:way:3"]["industry"]) == (34.2, "Sparks", "https://sparks.com", "Electrical")
    assert rows["osm:node:1"]["industry"] == "Plumbing" and rows["osm:relation:4"]["latitude"] is None and rows["osm:way:3"]["contacts"][0]["email"] == "a@b.com"


@pytest.mark.parametrize(("text", "number"), [("42", 42), ("1,250", 1250), ("11-50", 50), ("11 - 50", 50), ("12.9", 12), ("50+", None), ("n/a", None), ("", None), ("1e3", 1000), ("5d", None), ("NaN", None), ("-7", 7), ("99999999999", None)])
def test_whole_numbers(spark, text, number):
    assert spark.range(1).select(C.whole_number(F.lit(text))).first()[0] == number


@pytest.mark.parametrize(("text", "value"), [("$5.2M", 5.2e6), ("1,250,000", 1.25e6), ("900K", 9e5), ("2b", 2e9), ("€ 3 m", 3e6), ("K", None), ("5 million", None), ("1.5.2", None), ("-4k", -4e3)])
def test_money(spark, text, value):
    assert spark.range(1).select(C.money(F.lit(text))).first()[0] == (pytest.approx(value) if value else None)


@pytest.mark.parametrize(("text", "year"), [("1985", 1985), ("Est. 19-85", 1985), ("19856", 1985), ("'99", None), ("12 May 1999", None), ("1799", None), ("2027", None), ("", None)])
def test_founding_years(spark, text, year):
    assert spark.range(1).select(C.founding_year(F.lit(text), 1800, F.lit(2026))).first()[0] == year
