"""The shard store: races, retention, levels and many runs."""

from collections import Counter

import pytest

from bizfit.llm import sharding as S
from bizfit.operators.shared import fresh_path


def rows_of(spark, first, n=40):
    return spark.createDataFrame([(first + k, f"text {first + k} " * 20) for k in range(n)], "doc_id long, text string").repartition(4)


def ids(spark, shards):
    return Counter(r["doc_id"] for r in spark.read.parquet(*[s.path for s in shards]).collect())


def test_of_two_writers_one_wins(spark):
    root = fresh_path(spark, "store")
    one, two = S.Store(spark, root), S.Store(spark, root)
    one.append(rows_of(spark, 0))
    base, shards = 1, one.manifest()
    assert two._claim(2)  # a writer is about to commit version 2
    with pytest.raises(RuntimeError):
        one.commit(shards, base)
    assert one.versions() == [1]
    one.unclaim(2)  # it died
    assert one.commit(shards, base) == 2
    one.unclaim(2)  # a committed version stays claimed
    with pytest.raises(RuntimeError):
        two.commit([], 1)
    assert one.manifest() == sorted(shards, key=lambda s: s.path)


def test_old_versions_stay_until_they_expire(spark):
    store = S.Store(spark, fresh_path(spark, "store"), target_bytes=1 << 20)
    for k in range(3):
        store.append(rows_of(spark, 100 * k))
    old = store.manifest()
    reader = store.read("doc_id")  # a lazy reader of the version before
    assert store.compact() == 4 and len(store.manifest()) < len(old)
    want = Counter(100 * k + j for k in range(3) for j in range(40))
    assert ids(spark, old) == ids(spark, store.manifest()) == want
    assert reader.count() == 120
    assert store.expire(keep=2) == 0 and store.versions() == [3, 4]
    assert store.expire(keep=1) == len(old) and store.versions() == [4]
    assert ids(spark, store.manifest()) == want


def test_many_runs_in_many_jobs(spark, monkeypatch):
    monkeypatch.setattr(S, "RUNS_PER_JOB", 2)
    store = S.Store(spark, fresh_path(spark, "store"), target_bytes=6000, fan=2)
    for k in range(4):
        store.append(rows_of(spark, 100 * k))
    before = store.manifest()
    runs = store.plan(before)
    assert len(runs) >= 4
    store.compact()
    after = store.manifest()
    assert ids(spark, after) == Counter(100 * k + j for k in range(4) for j in range(40))
    merged = [s for s in after if s.level == 1]
    assert len(merged) == len(runs) and len(after) == len(before) - sum(map(len, runs)) + len(runs)
    # a run's level follows from its own shards
    store.append(rows_of(spark, 900))
    mixed = [S.Shard(s.path, 10, s.level) for s in store.manifest()]
    monkeypatch.setattr(store, "plan", lambda shards: [[s for s in mixed if s.level == 0][:2], [s for s in mixed if s.level == 1][:2]])
    store.compact()
    assert Counter(s.level for s in store.manifest())[2] == 1
