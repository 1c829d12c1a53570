"""The flows as a whole: collecting from sources, scoring a list, refreshing a batch and a stream, with their writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizfit.operators import store
from bizfit.plans import flows
from bizfit.sources import readers
from bizfit.streaming import refresh as R

REGISTER = (
    "pos long, LicenseNumber string, BusinessName string, BusinessType string, City string, State string, `ZIP Code` string, County string, PhoneNumber string, IssueDate string, "
    "`Classification(s)` string, WorkersCompCoverageType string"
)
FACTS = [("hickeyplumbing.com", ["mx"], True)]


def page(body):
    return f"<html><body>{body}<p>{'padding. ' * 80}</p></body></html>"


def licence(pos, number, name, phone=None, code="91203"):
    return (pos, number, name, "Sole Owner", "GLENDALE", "CA", code, "Los Angeles", phone, "05/23/1987", "C36", None)


def test_collect(spark):
    register = spark.createDataFrame(
        [licence(1, "10", "HICKEY PLUMBING", "6267153902"), licence(2, "11", "HICKEY PLUMBING INC", "6267153902"), licence(3, "12", "MAPPED PIPES"), licence(4, "10", "LATER ROW"), licence(5, "13", "FAR PIPES", code="90001")], REGISTER
    )
    personnel = spark.createDataFrame([(1, "10", "HICKEY DALE", "Owner"), (2, "10", "OTHER ONE", "Secretary")], "pos long, `LIC-NO` string, Name string, `EMP-Titl-CDE` string")
    mapped = spark.createDataFrame([(100, "osm:node:1", "Mapped Pipes", "Plumbing", "https://mapped.example", "Glendale", "CA", 34.1, -118.2)], "pos long, id string, name string, industry string, website string, city string, state string, latitude double, longitude double")
    fetched = spark.createDataFrame([("https://hickeyplumbing.com", page("<a href='tel:+1-626-715-3902'>Call</a><p>Dale Hickey, Owner. Write to dale@hickeyplumbing.com</p>")), ("https://unrelated.com", page("x"))], "url string, html string")
    facts = spark.createDataFrame(FACTS, "domain string, mx array<string>, exists boolean")
    scored, summary = flows.collect(register, personnel, mapped, fetched, facts, 2026, 50, "CA")
    rows = {r["id"]: r for r in scored.collect()}
    assert set(rows) == {"cslb:10", "cslb:12", "cslb:13"}  # the second spelling was merged, the map's row joined its licence
    first = rows["cslb:10"]
    assert first["website"] == "https://hickeyplumbing.com" and first["contacts"][0]["email"] == "dale@hickeyplumbing.com" and first["contacts"][0]["email_status"] == "verified"
    assert first["contacts"][0]["name"] == "Dale Hickey" and first["contacts"][0]["phone_valid"] and first["web"]["page_bytes"] > 600
    assert rows["cslb:12"]["website"] == "https://mapped.example" and rows["cslb:12"]["latitude"] == 34.1
    assert first["peer_count_in_niche"] is not None and 0 <= first["score"] <= 100
    told = {r["what"]: r["value"] for r in summary.collect()}
    assert told["website phone"] == 1 and told["industry Plumbing"] == 3 and told["score low"] <= told["score median"] <= told["score high"]


def test_score_a_list(spark):
    lists = spark.createDataFrame([(1, "Acme Heating", "www.acme.com", "11-50", "$5.2M", "Pat", "pat@hickeyplumbing.com", "x"), (2, None, "www.b.com", "1", "1", None, None, "y")], "pos long, `Company Name` string, Website string, Employees string, `Estimated Revenue` string, Owner string, Email string, Notes string")
    scored, report = flows.score_list(lists, spark.createDataFrame(FACTS, "domain string, mx array<string>, exists boolean"), 2026)
    row = scored.collect()
    assert [(r["id"], r["employee_count"], r["revenue_usd"], r["contacts"][0]["email_status"], r["f_buy_box"]["score"]) for r in row] == [("import:1", 50, 5.2e6, "verified", 100.0)]
    assert tuple(report.first()) == (1, 1, "Notes")


def companies(spark):
    rows = [("a", 1, "Hickey Plumbing", "Glendale", None, "6267153902"), ("b", 2, "Other Pipes", "Glendale", "https://other.com", "6261112222"), ("c", 3, "No Page", "Glendale", None, None)]
    base = spark.createDataFrame(rows, "id string, pos long, name string, city string, website string, phone string")
    contact = readers.contact(phone=F.col("phone"))
    return readers.complete(base.withColumn("contacts", readers.one_contact(contact, F.col("phone").isNotNull())).drop("phone"))


FETCHED = [("a", "https://hickeyplumbing.com", page("<p>(626) 715-3902 dale@hickeyplumbing.com</p>")), ("b", "https://other.com", page("<p>since 1990</p>"))]


def test_a_refresh_is_kept_with_its_evidence_and_its_score_once(spark, tmp_path):
    rows, facts = companies(spark), spark.createDataFrame(FACTS, "domain string, mx array<string>, exists boolean")
    fetched = spark.createDataFrame(FETCHED, "id string, url string, html string")
    stores = flows.Stores(store.keyed_table(rows, f"{tmp_path}/companies", "id"), f"{tmp_path}/payloads", f"{tmp_path}/scores")
    for turn in (1, 2):
        updated, payloads, history = flows.save_refresh(flows.refresh_batch(rows, fetched, facts, 2026), stores, "2026-10-01")
        got = {r["id"]: r for r in updated.collect()}
        assert set(got) == {"a", "b", "c"} and got["a"]["website"] == "https://hickeyplumbing.com" and got["c"]["website"] is None
        assert payloads.count() == 2 * turn and "hickeyplumbing" in payloads.filter("company_id = 'a'").first()["payload"]
        assert sorted(r["company_id"] for r in history.collect()) == ["a", "b"]  # an identical result is recorded once


def test_a_stream_of_refreshes(spark, tmp_path):
    rows, facts = companies(spark), spark.createDataFrame(FACTS, "domain string, mx array<string>, exists boolean")
    fetched = spark.createDataFrame(FETCHED, "id string, url string, html string")
    schema = "user_id string, ts timestamp, event_type string, value double"
    at = lambda h: dt.datetime(2026, 9, 1) + dt.timedelta(hours=h)
    parts = [[("a", at(0), "visit", 1.0), ("a", at(0), "visit", 1.0), ("c", at(1), "visit", 1.0)], [("b", at(50), "visit", 2.0), ("a", at(90), "visit", 1.0)], [("a", at(91), "visit", 1.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet/part{k}")
    source = f"{tmp_path}/in/events.parquet/*"
    files = spark.read.schema(schema).parquet(source)
    stores = flows.Stores(store.keyed_table(rows, f"{tmp_path}/companies", "id"), f"{tmp_path}/payloads", f"{tmp_path}/scores")
    seen = []

    def refresh(batch, epoch):
        if epoch == 1 and seen.count(1) == 0:  # breaks off after payloads and scores, before the companies' version
            seen.append(epoch)
            ids = batch.select(F.col("company_id").alias("id"))
            scored = flows.refresh_batch(stores.companies.read().join(ids, "id", "left_semi"), fetched, facts, 2026)
            store.append_payloads(scored.select("id", "web"), "id", stores.payloads, "x", "stream-1")
            raise RuntimeError("lost")
        seen.append(epoch)
        flows.refresh_stored(batch.select(F.col("company_id").alias("id")), stores, fetched, facts, 2026, "2026-09-01", "stream", epoch)

    run = lambda: R.stream_refreshes(spark, source, files.schema, refresh, name="*.parquet", state=f"{tmp_path}/state")
    with pytest.raises(Exception, match="lost"):
        run()
    assert stores.companies.epoch("stream") == 0
    run()
    assert seen[:3] == [0, 1, 1] and stores.companies.epoch("stream") == max(seen)
    before = {r["id"]: r for r in stores.companies.read().collect()}
    flows.refresh_stored(spark.createDataFrame([("a",), ("c",)], "id string"), stores, fetched.filter("false"), facts, 2026, "later", "stream", 1)  # a replay of what is done
    got = {r["id"]: r for r in stores.companies.read().collect()}
    assert got == before and set(got) == {"a", "b", "c"}
    assert got["a"]["website"] == "https://hickeyplumbing.com" and got["b"]["web"]["founded_year"] == 1990 and got["c"]["website"] is None  # both batches are in it
    scores = spark.read.parquet(stores.scores)
    assert sorted(r["company_id"] for r in scores.collect()) == ["a", "b"]
    assert spark.read.parquet(stores.payloads).groupBy("company_id").count().filter("company_id = 'b'").first()["count"] == 1
    out = f"{tmp_path}/history"
    R.run_stream(spark, source, files.schema, lambda batch, _: store.append_scores(batch, out), name="*.parquet")
    assert spark.read.parquet(out).count() == 3  # a and c once each, though a's repeats come after the watermark, and b
