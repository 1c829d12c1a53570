"""The extendible-hash index: chains of colliding keys, splits, hot keys and awkward rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bizfit.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, key string, body int, owner string, bucket int, slot string, row string, n long"


def plain(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[(t or "").encode().lower()].append(i)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((i, best[(t or "").encode().lower()], len(ids[(t or "").encode().lower()])) for i, t in rows), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "o", 2, "s", "r", 3) for i, t in rows], SCHEMA)


ROWS = [(k, f"text {k % 37}" if k % 3 else f"TEXT {k % 37}") for k in range(200)]
ROWS += [(300, None), (301, ""), (302, " "), (None, "alone"), (None, None), (303, "É"), (304, "é"), (305, "x" * 100_000), (306, "X" * 100_000), (306, "X" * 100_000)]
WEAK = {
    "one key for all": lambda b: F.lit(1).cast("long"),
    "three keys": lambda b: (F.char_length(b) % 3).cast("long"),
    "real": F.xxhash64,
}


@pytest.mark.parametrize("name", WEAK)
def test_equal_keys_are_told_apart_by_bytes(spark, name):
    docs = table(spark, ROWS)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in X.exact_dedup(docs, key=WEAK[name]).collect()), key=str)
    assert got == plain(ROWS)
    index, _ = X.build_index(docs, key=WEAK[name])
    texts = len({(t or "").encode().lower() for _, t in ROWS})
    entries = index.entries.collect()
    assert len(entries) == texts
    by = defaultdict(list)
    for r in entries:
        by[r["key"]].append(r["chain"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    if name == "one key for all":
        assert len(by) == 1 and max(by[1]) == texts


def test_buckets_split_and_owners_have_key_ranges(spark):
    docs = table(spark, [(k, f"t{k}") for k in range(2000)])
    index, _ = X.build_index(docs, capacity=30)
    counts, ranges = defaultdict(int), defaultdict(list)
    for r in index.entries.collect():
        counts[r["bucket"]] += 1
        ranges[r["owner"]].append(r["key"] & (1 << 64) - 1)
    assert max(counts.values()) <= 30 and len(counts) > 60 and len(ranges) > 1
    spans = sorted((min(v), max(v)) for v in ranges.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_hot_keys_and_many_repeated_keys(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, "hot" if k % 3 == 0 else f"t{rng.randrange(3000)}") for k in range(6000)]
    want = plain(rows)
    docs = table(spark, rows)
    for most in (X.BROADCAST_KEYS, 10):  # the second time all texts go to the owners
        monkeypatch.setattr(X, "BROADCAST_KEYS", most)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in X.exact_dedup(docs).collect()), key=str) == want
        kept = X.keep_exact(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, _ in want})


def test_keep_exact_on_awkward_rows(spark):
    docs = table(spark, ROWS)
    kept = X.keep_exact(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    best = {(t or "").encode().lower(): k for (_, t), k in ((x, None) for x in ROWS)}
    assert len(got) == len(best)
    assert X.keep_exact(docs.limit(0)).count() == 0 and X.exact_dedup(docs.limit(0)).count() == 0
