"""Stores: upserts by bucket and epoch, a history by tail, pages by expiry."""

import datetime as dt
import hashlib
from pathlib import Path

import pytest

from bizfit.operators import store
from bizfit.sources import readers

SCHEMA = "id string, name string, contacts array<struct<email:string>>"


def rows(spark, ids, name):
    return spark.createDataFrame([(f"c{k}", f"{name}{k}", [(f"{name}@x.com",)]) for k in ids], SCHEMA)


def parts(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def names(table):
    return {r["id"]: r["name"] for r in table.read().collect()}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = store.keyed_table(rows(spark, range(200), "old"), f"{tmp_path}/t", "id", buckets=16)
    before = parts(f"{tmp_path}/t")
    got = table.upsert(rows(spark, [3, 500], "new"))
    after = parts(f"{tmp_path}/t")
    assert all(after[f] == state for f, state in before.items())  # nothing is changed in place
    assert 1 <= len(set(after) - set(before)) <= 2
    assert sum("_bucket" in p and "data-" in p for p in got.inputFiles()) == len(before)
    assert len([p for p in got.inputFiles() if p.removeprefix("file://") in before]) >= len(before) - 2
    assert names(table) == {f"c{k}": f"old{k}" for k in range(200)} | {"c3": "new3", "c500": "new500"}
    assert got.filter("id = 'c3'").first()["contacts"][0]["email"] == "new@x.com"
    table.vacuum()
    assert names(table)["c500"] == "new500" and len(parts(f"{tmp_path}/t")) == len(before)


def test_several_new_rows_with_a_key(spark, tmp_path):
    table = store.keyed_table(rows(spark, range(3), "old"), f"{tmp_path}/t", "id")
    table.upsert(rows(spark, [1], "b").unionByName(rows(spark, [1], "a")))
    assert names(table) == {"c0": "old0", "c1": "b1", "c2": "old2"}
    table.upsert(rows(spark, [1], "b").unionByName(rows(spark, [1], "a")).selectExpr("*", "CASE WHEN name = 'a1' THEN 2 ELSE 1 END AS seen"), order="seen")
    assert names(table)["c1"] == "a1"
    assert table.upsert(rows(spark, [], "x")).count() == 3


def test_epochs_are_done_once_and_a_torn_version_does_not_count(spark, tmp_path):
    table = store.keyed_table(rows(spark, range(3), "old"), f"{tmp_path}/t", "id")
    table.upsert(rows(spark, [0], "first"), writer="s", epoch=0)
    table.upsert(rows(spark, [1], "second"), writer="s", epoch=1)
    table.upsert(rows(spark, [0, 1], "replayed"), writer="s", epoch=1)
    assert table.epoch("s") == 1 and table.epoch("other") == -1
    assert names(table) == {"c0": "first0", "c1": "second1", "c2": "old2"}
    versions = sorted(p for p in Path(f"{tmp_path}/t/_versions").iterdir() if not p.name.startswith("."))
    torn = versions[-1].with_name(f"{int(versions[-1].name) + 1:010d}")
    torn.write_text('{"folders": {"0": "data-nothing"')
    assert names(table)["c1"] == "second1"
    table.upsert(rows(spark, [2], "after"), writer="s", epoch=2)
    assert names(table) == {"c0": "first0", "c1": "second1", "c2": "after2"}


def test_a_writer_that_loses_a_version_merges_anew(spark, tmp_path, monkeypatch):
    table = store.keyed_table(rows(spark, range(3), "old"), f"{tmp_path}/t", "id", buckets=2)
    create, raced = store.Files.create, []

    def rival_first(self, path, text, still):
        if not raced:
            raced.append(1)
            table.upsert(rows(spark, [0], "rival"))
        return create(self, path, text, still)

    monkeypatch.setattr(store.Files, "create", rival_first)
    table.upsert(rows(spark, [1], "mine"))
    assert names(table) == {"c0": "rival0", "c1": "mine1", "c2": "old2"}


def test_of_a_slow_writer_and_one_that_passed_it_one_commits(spark, tmp_path, monkeypatch):
    """A writer's file is there but not whole when another takes the next version: whichever sees the other gives way and merges anew."""
    table = store.keyed_table(rows(spark, range(3), "old"), f"{tmp_path}/t", "id", buckets=2)
    create, turns = store.Files.create, []

    def slow(self, path, text, still):
        turns.append(path)
        if len(turns) > 1:
            return create(self, path, text, still)

        def passed():  # its name is taken, then the other writer goes by
            table.upsert(rows(spark, [0], "rival"))
            return still()

        return create(self, path, text, passed)

    monkeypatch.setattr(store.Files, "create", slow)
    table.upsert(rows(spark, [1], "mine"))
    assert names(table) == {"c0": "rival0", "c1": "mine1", "c2": "old2"} and len(turns) == 3


def scores(spark, ids):
    made = [(f"c{k}", "score:" + hashlib.sha256(str(k).encode()).hexdigest()[:32], float(k)) for k in ids]
    return spark.createDataFrame(made, "company_id string, cache_key string, score double")


def test_a_history_is_searched_by_tail(spark, tmp_path):
    path = f"{tmp_path}/scores"
    assert store.append_scores(scores(spark, range(300)), path).count() == 300
    assert store.append_scores(scores(spark, range(300)), path).count() == 300
    few = scores(spark, [5, 999])
    plan = store.unknown_scores(few, path)._jdf.queryExecution().executedPlan().toString()
    tails = {r["cache_key"][-2:] for r in few.collect()}
    assert "PartitionFilters: [" in plan and all(p in plan for p in tails) and "ReadSchema: struct<cache_key:string>" in plan
    files = parts(path)
    assert store.append_scores(few.unionByName(few), path).count() == 301
    assert len(set(parts(path)) - set(files)) == 1


def test_a_repeated_epoch_of_payloads_adds_nothing(spark, tmp_path):
    for _ in range(2):
        assert store.append_payloads(rows(spark, range(3), "p"), "id", f"{tmp_path}/p", "2026-10-01", "s-0").count() == 3
    got = store.append_payloads(rows(spark, [7], "p"), "id", f"{tmp_path}/p", "2026-10-02", "s-1")
    assert got.count() == 4 and '"name":"p7"' in got.filter("company_id = 'c7'").first()["payload"]


@pytest.mark.parametrize("hour", [0, 12, 23])
def test_a_purge_drops_days_and_rewrites_one(spark, tmp_path, hour):
    at = lambda h: dt.datetime(2026, 9, 1) + dt.timedelta(hours=h)
    made = [(f"https://s{k % 9}.com/{k}", at(0), at(k), 200, f"body{k}") for k in range(0, 120, 3)] + [("https://s.com/never", at(0), None, 200, "kept")]
    pages = spark.createDataFrame(made, "url string, fetched_at timestamp, expires_at timestamp, status int, body string")
    path, now = f"{tmp_path}/pages", at(48 + hour)
    stored = store.write_pages(pages, path)
    latest = lambda: sorted(tuple(r) for r in readers.page_latest(spark.read.schema(pages.schema).parquet(path), store.F.lit(now)).collect())
    before, files = latest(), parts(path)
    expired = sum(r[2] is not None and r[2] <= now for r in made)
    assert stored.count() == len(made) and len(before) > 0
    assert store.purge_pages(spark, path, pages.schema, now) == expired
    assert latest() == before
    left = spark.read.schema(pages.schema).parquet(path)
    assert left.count() == len(made) - expired and left.filter(store.F.col("expires_at") <= store.F.lit(now)).count() == 0
    assert all(parts(path)[f] == files[f] for f in files if any(f"_day={d}" in f for d in ("2026-09-04", "2026-09-05", "__HIVE")))
    assert store.purge_pages(spark, path, pages.schema, now) == 0
