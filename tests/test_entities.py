"""Deduplication, chains, peers, quality, verdicts, proofs, links and search on small tables with known results."""

import math
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators import annotate, contacts, graph, match, pages, score, search, sinks, store
from bizfit.sources import readers

CONTACT = ("name", "title", "email", "email_status", "phone", "phone_valid", "linkedin_url", "is_decision_maker")


def table(spark, rows):
    """Companies from dictionaries; contacts as dictionaries."""
    kinds = {"contacts": readers.COMPANY["contacts"], **{k: v for k, v in readers.COMPANY.items() if k != "contacts"}}
    names = ["id", "pos", *sorted({k for r in rows for k in r} - {"id", "pos", "contacts"}), "contacts"]
    data = [(r["id"], p, *[r.get(c) for c in names[2:-1]], [tuple({"email_status": "unknown", "is_decision_maker": False, **c}.get(f) for f in CONTACT) for c in r.get("contacts", [])]) for p, r in enumerate(rows)]
    return readers.complete(spark.createDataFrame(data, ", ".join(f"{c} {kinds[c]}" for c in names)))


def co(id_, name, lat=None, lon=None, city="Columbus", **more):
    return {"id": id_, "name": name, "latitude": lat, "longitude": lon, "city": city, **more}


def run(spark, *rows):
    kept, audit = match.dedupe(table(spark, rows))
    return kept.collect(), audit.collect()


def test_two_spellings_at_one_place_merge(spark):
    kept, audit = run(spark, co("a", "Whitaker Heating & Cooling, Inc.", 39.9600, -83.0000), co("b", "WHITAKER HEATING AND COOLING LLC", 39.9601, -83.0001))
    assert len(kept) == 1 and audit[0]["reason"] == "near-identical name"


def test_branches_and_different_names_stay_and_nameless_places_merge(spark):
    rows = [co(k, "NTB", la, lo, city="A", website="https://ntb.com") for k, la, lo in (("n1", 39.96, -83.0), ("n2", 40.05, -82.95), ("n3", 39.9, -83.1))]
    rows += [co("care", "Columbus Dental Care", 39.96, -83.0, city="B"), co("group", "Columbus Dental Group", 39.9601, -83.0, city="B")]
    rows += [co("s1", "Shaw-Davis Funeral Home", city="C", postcode="43215"), co("s2", "Shaw Davis Funeral Home", city="C", postcode="43215")]
    rows += [co("h1", "Half Placed Shop", 39.0, None, city="D"), co("h2", "Half Placed Shop", 50.0, 10.0, city="D")]
    kept, audit = run(spark, *rows)
    assert {r["id"] for r in kept} == {"n1", "n2", "n3", "care", "group", "s1", "h1"}
    assert {(r["kept_id"], r["dropped_id"]) for r in audit} == {("s1", "s2"), ("h1", "h2")}


def test_the_fuller_record_stays_and_learns(spark):
    rows = [co("sparse", "Acme Dental LLC", 39.9601, -83.0, founded_year=1988), co("rich", "Acme Dental", 39.96, -83.0, postcode="43215", contacts=[{"email": "dale@acme.example", "phone": "+16142204000"}])]
    kept, audit = run(spark, *rows)
    assert [r["id"] for r in kept] == ["rich"] and kept[0]["founded_year"] == 1988 and kept[0]["contacts"][0]["email"] == "dale@acme.example"
    assert (audit[0]["kept_id"], audit[0]["dropped_id"]) == ("rich", "sparse")
    again, _ = run(spark, *[co(f"c{k}", f"Business {k}", 39.9 + k / 100, -83.0) for k in range(5)])
    assert sorted(r["id"] for r in again) == [f"c{k}" for k in range(5)]


def test_chains_count_premises(spark):
    rows = [co(f"v{k}", "Valvoline", la, lo) for k, (la, lo) in enumerate([(39.96, -83.0), (40.05, -82.95), (39.9, -83.1)])]
    rows += [co("h1", "Hutta Orthodontics", 39.96, -83.0), co("h2", "Hutta Orthodontics", 40.05, -82.95)]
    rows += [co(f"w{k}", "Corner Vets", 39.96 + k / 1e5, -83.0 - k / 1e5) for k in range(3)]
    out = annotate.chain_locations(table(spark, rows))
    assert {r["id"]: r["sibling_location_count"] for r in out.collect()} == {"v0": 3, "v1": 3, "v2": 3, "h1": 2, "h2": 2, "w0": 1, "w1": 1, "w2": 1}
    assert annotate.chain_flag_count(out).first()[0] == 3


def test_peers(spark):
    rows = [co(f"c{k}", "x", industry="HVAC", postcode="91203-1234" if k else "91203") for k in range(4)] + [co("far", "x", industry="HVAC", postcode="90210"), co("none", "x", industry="HVAC"), co("other", "x", industry="Plumbing", postcode="91203")]
    rows += [co("a", "x", 39.96, -83.0, industry="Vet", postcode="1"), co("b", "x", 39.97, -83.01, industry="Vet", postcode="1"), co("c", "x", 41.5, -81.69, industry="Vet", postcode="1")]
    out = annotate.peer_density(table(spark, rows))
    got = {r["id"]: r["peer_count_in_niche"] for r in out.collect()}
    assert got == {"c0": 3, "c1": 3, "c2": 3, "c3": 3, "far": 0, "none": None, "other": 0, "a": 1, "b": 1, "c": 0}
    assert annotate.peers_unmeasured(out).first()[0] == 1


@pytest.mark.parametrize("center", [(34.0, -118.2), (0.0, 179.99), (89.9, 10.0), (-60.0, -179.95), (79.0, 0.0)])
def test_radius_counts_match_all_pairs(spark, center):
    rng = random.Random(str(center))
    spread = 0.3 / max(0.01, math.cos(math.radians(center[0])))
    points = [(k % 2, max(-90.0, min(90.0, center[0] + rng.gauss(0, 0.15))), (center[1] + rng.gauss(0, spread) + 540) % 360 - 180) for k in range(300)]
    points += points[:20] + [(0, *center)] * 5

    def km(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))

    want = {p: sum(p[0] == q[0] and km(p, q) <= 15 for q in points) for p in points}
    out = annotate.radius_counts(spark.createDataFrame([*points, (0, None, 1.0)], "g int, latitude double, longitude double"), "g")
    assert {(r["g"], r["latitude"], r["longitude"]): r["within"] for r in out.collect()} == want


def test_quality_of_empty_and_complete_rows(spark):
    full = {"contacts": [{"name": "Dale", "title": "Owner", "email": "d@x.test", "email_status": "verified", "phone": "+16145550142", "phone_valid": True, "is_decision_maker": True}]}
    rows = table(spark, [co("empty", "x", city=None), co("full", "x", website="https://x.test", postcode="91203", business_type="Sole Owner", founded_year=1984, **full)])
    crawled = F.when(F.col("id") == "full", F.lit("2026-09-03").cast("timestamp"))
    rows = rows.withColumn("web", F.from_json(F.lit("{}"), readers.COMPANY["web"]).withField("fetched_at", crawled))
    got = {r["id"]: (r["data_quality"], r["quality_issues"]) for r in annotate.quality(rows).collect()}
    assert got["full"] == (100.0, []) and got["empty"][0] == 0.0 and len(got["empty"][1]) == 10 and got["empty"][1][0] == "no phone number"


def test_email_and_phone_verdicts(spark):
    facts = spark.createDataFrame([("w.com", ["mx"], True), ("gone.example", [], False), ("amx.example", [], True), ("slow.example", None, None), ("mailinator.com", [], True), ("gmail.com", ["mx"], True)], "domain string, mx array<string>, exists boolean")
    cases = {"not-an-email": "invalid", "dale@w.com": "verified", "x@gone.example": "invalid", "a@amx.example": "risky", "a@slow.example": "unknown", "x@mailinator.com": "risky", " INFO@W.com ": "verified", "d@gmail.com": "verified", "": "invalid"}
    out = {r["email"]: r for r in contacts.email_verdicts(spark.createDataFrame([(e,) for e in cases], "email string"), facts).collect()}
    assert {e: r["status"] for e, r in out.items()} == cases
    assert out[" INFO@W.com "]["is_role"] and out["d@gmail.com"]["is_free_mail"] and not out["dale@w.com"]["is_role"]
    numbers = {"(614) 555-0142": "+16145550142", "+1 614 220 4000": "+16142204000", "614.220.4000": "+16142204000", "not a phone": None, "12": None}
    got = contacts.phones(spark.createDataFrame([(n,) for n in numbers], "phone string")).collect()
    assert {r["phone"]: r["phone_e164"] for r in got} == numbers and all(r["phone_ok"] == (r["phone_e164"] is not None) for r in got)


def page(body):
    return f"<html><head><script>var id='6267153902';</script></head><body>{body}<p>{'padding. ' * 80}</p></body></html>"


PROOFS = [
    ("HICKEY PLUMBING", "GLENDALE", page("<p>Call us on (626) 715-3902 for a quote.</p>"), "phone"), ("HICKEY PLUMBING", "GLENDALE", page("<p>626.715.3902</p>"), "phone"),
    ("HICKEY PLUMBING", "GLENDALE", page("<a href='tel:+1-626-715-3902'>Call</a>"), "phone"), ("HICKEY PLUMBING", "GLENDALE", page("<p>Hickey has served Glendale since 1984.</p>"), "name"),
    ("ACCURATE ENERGY SERVICES INC", "GLENDALE", page("<p>Accurate Energy serves Glendale. Call (626) 358-8375.</p>"), "name"),
    ("A K INTERNATIONAL", "GLENDALE", page("<p>International shipping and logistics worldwide.</p>"), None), ("HICKEY PLUMBING", "GLENDALE", page("<p>Hickey Industries, a division of Hickey Global.</p>"), None),
    ("GABE KAPRELIAN ELECTRICAL CONTRACTOR", "GLENDALE", page("<p>Gabe's Diner, Glendale's favourite since 1990.</p>"), None), ("HICKEY PLUMBING", "GLENDALE", page("<h1>Buy this domain</h1><p>(626) 715-3902</p>"), None),
    ("HICKEY PLUMBING", "GLENDALE", page("<h1>Coming soon</h1><p>(626) 715-3902</p>"), None), ("HICKEY PLUMBING", "GLENDALE", page("<h1>HugeDomains</h1><p>(626) 715-3902</p>"), None),
    ("HICKEY PLUMBING", "GLENDALE", "<html><body>hi 6267153902</body></html>", None), ("HICKEY PLUMBING", "GLENDALE", page("<p>Westside Dental Group. Call (310) 555-0100.</p>"), None),
    ("HICKEY PLUMBING", None, page("<p>Hickey and sons, established 1984.</p>"), None), ("HICKEY PLUMBING", "GLENDALE", None, None), ("HICKEY PLUMBING", "GLENDALE", page("<style>.a{width:6267153902px}</style>"), None),
]


def test_site_proof(spark):
    rows = [(k, n, c, "+16267153902", h) for k, (n, c, h, _) in enumerate(PROOFS)]
    out = pages.site_proof(spark.createDataFrame(rows, "k int, name string, city string, licence_phone string, html string")).collect()
    assert {r["k"]: r["method"] for r in out} == {k: m for k, (*_, m) in enumerate(PROOFS)}


def test_candidate_domains(spark):
    names = ["HICKEY PLUMBING", "JOHNNY'S AIR CONDITIONING SERVICES", "GABE KAPRELIAN ELECTRICAL CONTRACTOR", "A K INTERNATIONAL"]
    urls = {}
    for r in pages.candidate_domains(table(spark, [co(n, n) for n in names])).collect():
        urls.setdefault(r["id"], []).append(r["url"])
    assert "https://hickeyplumbing.com" in urls[names[0]] and any("gabekaprelianelectric" in u for u in urls[names[2]])
    assert all(len(u) < 45 and "-s-" not in u for v in urls.values() for u in v)
    assert "https://akinternational.com" in urls[names[3]] and "https://kinternational.com" not in urls[names[3]]


def test_links_are_resolved_as_a_browser_does(spark):
    bases = ["https://a.com", "https://a.com/", "https://a.com/x/y.html?q=1", "http://A.com:80/d/e/f/"]
    hrefs = ["about.html", "../about", "/team", "./c", "?p=2", "#top", "a/../b/./c", "../../../z", "//b.com/x", "https://a.com/full#frag", "sub/", "..", "mailto:x@y.z", "x?y=../z", "/a/./b/../c?d#e"]
    rows = [(b, h) for b in bases for h in hrefs]
    out = spark.createDataFrame(rows, "b string, h string").select("b", "h", pages.absolute(F.col("b"), F.col("h")).alias("u")).collect()
    for r in out:
        want = urljoin(r["b"], r["h"]).split("#")[0]
        assert r["u"] == (None if r["h"].startswith("#") else want), r


def test_page_links(spark):
    html = """<a href="about.html">Who</a> <a class=x href='/p'>About <b>us</b></a><a href=/c>Contact</a><A HREF="https://b.com/about">About</A><a href="/p#x">again, contact</a><a href="tel:1">about</a><a href="#about">x</a><a href="/plain">plain"""
    got = {r["link"]: (r["place"], r["kind"]) for r in pages.page_links(spark.createDataFrame([("https://a.com/d/", html), ("https://e.com", None)], "url string, html string")).collect()}
    assert got == {"https://a.com/d/about.html": (0, 0), "https://a.com/p": (1, 0), "https://a.com/c": (2, 1), "https://a.com/plain": (7, None)}


def test_search_filters_match_a_plain_filter(spark):
    rng = random.Random(3)
    words = ["Plumbing", "Air", "100%", "a_b", "axb", "Burbank", "Electric"]
    rows = [co(f"c{k}", " ".join(rng.sample(words, 2)), city=rng.choice(["Burbank", "GLENDALE", None]), industry=rng.choice(["Plumbing", "HVAC", None]), business_type=rng.choice(["Sole Owner", None]), has_employees=rng.choice([True, False, None]), founded_year=rng.choice([1950, 1999, 2020, None])) for k in range(80)]
    df = table(spark, rows)
    for f in [search.Filters(), search.Filters(q="plumbing"), search.Filters(q="PLUMBING air"), search.Filters(q="100%"), search.Filters(q="a_b"), search.Filters(q="zzz"), search.Filters(industry="plumbing"), search.Filters(city="glendale"), search.Filters(business_type="Sole Owner"), search.Filters(has_employees=True), search.Filters(has_employees=False), search.Filters(min_age=0), search.Filters(min_age=20), search.Filters(industry="HVAC", has_employees=True, min_age=10), search.Filters(q="air", city="Burbank")]:
        def ok(r, f=f):
            text = [(r[c] or "").lower() for c in ("name", "city", "industry")]
            return (
                all(any(t in x for x in text) for t in (f.q or "").lower().split()) and all(not getattr(f, c) or (r[c] or "").lower() == getattr(f, c).lower() for c in ("industry", "city", "business_type"))
                and (f.has_employees is None or r["has_employees"] is f.has_employees) and (f.min_age is None or r["founded_year"] is not None and r["founded_year"] <= 2026 - f.min_age)
            )
        assert {r["id"] for r in search.search(df, f, 2026).select("id").collect()} == {r["id"] for r in rows if ok(r)}, f


def plain_sample(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.get("industry") or "Unknown", []).append(r)
    picked = []
    for _, group in sorted(by.items(), key=lambda x: -len(x[1])):
        quota = max(1, round(limit * len(group) / len(rows)))
        site = [r for r in group if r.get("website")]
        take, rest = site[:quota], [r for r in group if not r.get("website")]
        left = quota - len(take)
        if left > 0 and rest:
            take += rest[:: max(1, len(rest) // left)][:left]
        picked += take
    have = {r["id"] for r in picked}
    picked += [r for r in rows if r["id"] not in have]
    return {r["id"] for r in picked[:limit]}


def test_stratified_sample_matches_a_plain_one(spark):
    rng = random.Random(6)
    rows = [co(f"c{k}", "x", industry=rng.choice(["A"] * 6 + ["B"] * 3 + ["C", None]), website=rng.choice([None, None, "https://x.com"])) for k in range(400)]
    for limit in (1, 10, 57, 399, 500):
        assert {r["id"] for r in annotate.stratified_sample(table(spark, rows), limit).select("id").collect()} == plain_sample(rows, limit)


def test_components_by_either_way(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (graph.ONE_TASK_EDGES, 0):
        monkeypatch.setattr(graph, "ONE_TASK_EDGES", most)
        assert {r["node"]: r["component"] for r in graph.connected_components(df, "a", "b").collect()} == want


def test_places_match_a_plain_ranking(spark):
    rng = random.Random(9)
    rows = [(f"s{k % 3}", rng.choice([50.0, 50.0, 61.5, 70.1]), f"id{k:04}") for k in range(600)]
    out = score.places(spark.createDataFrame(rows, "scenario string, score double, id string")).collect()
    for s in ("s0", "s1", "s2"):
        order = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[2]))
        assert {r["id"]: r["place"] for r in out if r["scenario"] == s} == {r[2]: k + 1 for k, r in enumerate(order)}


def test_content_key_follows_what_a_score_is_made_from(spark):
    base = co("a", "Acme", website="https://a.com", state="OH", country="US", source_url="u", latitude_=None)
    base.pop("latitude_")
    rows = [base, {**base, "state": "CA"}, {**base, "source_url": "v"}, {**base, "latitude": 1.0}, {**base, "domain": "a.com"}, {**base, "licence_number": "1"}]
    df = table(spark, [{**r, "id": "a"} for r in rows])
    keys = [r["cache_key"] for r in score.content_key(df, 2026).collect()]
    assert len(set(keys)) == len(rows) and all(re.fullmatch("score:[0-9a-f]{32}", k) for k in keys)
    other = [r["cache_key"] for r in score.content_key(df, 2026, score.BuyBox(max_employees=50)).collect()]
    assert not set(keys) & set(other) and not set(keys) & {r["cache_key"] for r in score.content_key(df, 2027).collect()}
    moved = df.withColumn("pos", F.col("pos") + 7)
    assert keys == [r["cache_key"] for r in score.content_key(moved, 2026).collect()]


def test_upsert_history_and_export(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, at int")
    new = spark.createDataFrame([("b", 5, 3), ("b", 4, 9), ("c", 6, 1)], "id string, v int, at int")
    out = store.keyed_table(base, f"{tmp_path}/u", "id").upsert(new, order="at")
    assert {(r["id"], r["v"]) for r in out.collect()} == {("a", 1), ("b", 4), ("c", 6)}
    scores = spark.createDataFrame([("k1", 1.0), ("k2", 2.0), ("k2", 2.0)], "cache_key string, score double")
    for part in (scores.limit(1), scores, scores):
        history = store.append_scores(part, f"{tmp_path}/h")
    assert sorted(r["cache_key"] for r in history.collect()) == ["k1", "k2"]
    scored = score.score_table(table(spark, [co(f"c{k}", f"Näme {k}", founded_year=1950 + 30 * k, employee_count=20 * k) for k in range(3)]), 2026)
    export = sinks.crm_export(scored, ids=spark.createDataFrame([("c0",), ("c2",)], "id string"), weights={"succession": 1.0})
    assert [r["Company"] for r in export.collect()] == ["Näme 0", "Näme 2"] and len(export.columns) == 16
    assert export.first()["Acquisition Fit"] == f"{scored.filter('id = %r' % 'c0').first()['f_succession']['score']:.1f}"
    sinks.write_csv(export, f"{tmp_path}/csv", bom=True)
    text = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8")
    assert text.startswith("﻿Company,Acquisition Fit")


def test_positions_follow_files_and_rows(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [f"{f}-{k},name {k}" for k in range(200)]
        (tmp_path / f"part{f}.csv").write_text("LicenseNumber,BusinessName\n" + "\n".join(lines) + "\n")
        want += [x.split(",")[0] for x in lines]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.licence_scan(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["LicenseNumber"] for r in sorted(rows, key=lambda r: r["pos"])] == want and sorted(r["pos"] for r in rows) == list(range(600))


def test_display_names_are_not_cut(spark):
    long = "A" + "B" * 3000
    got = spark.createDataFrame([(long + " INC",), ("O'BRIEN-SMITH LLC",), ("j.r. plumbing of ohio",)], "n string").select(C.display_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["A" + "b" * 3000 + " Inc", "O'Brien-Smith LLC", "J.R. Plumbing of Ohio"]
