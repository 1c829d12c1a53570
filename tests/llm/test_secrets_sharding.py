"""Secret scans and sharding, with nulls, repeats, long texts, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import pytest

from bizfit.llm import chat, html_text
from bizfit.llm.secrets import candidates, scan
from bizfit.llm.sharding import Shard, Store, shard_documents
from bizfit.operators.shared import fresh_path

DOCS = "doc_id long, text string, source string, candidate string, shard string, length int"


def key(rng, n=32):
    return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n))


@pytest.fixture(scope="module")
def findings():
    rng = random.Random(3)
    rows = [(k, f'some prose here password = "{key(rng)}" and more', "src/app.py", "x", "y", 1) for k in range(40)]
    rows += [(100 + k, f"some prose here sha256: {hashlib.sha256(str(k).encode()).hexdigest()} and more", "src/app.py", "x", "y", 1) for k in range(40)]
    return rows


def test_secrets_are_told_from_digests(spark, findings):
    rows = [*findings, findings[0], (500, None, None, None, None, None), (501, "", "s", None, None, 0), (502, "word " * 30_000, "s", None, None, 0)]
    out = scan(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in out if r["is_secret"]} == set(range(40))
    assert {r["doc_id"] for r in out if not r["is_secret"]} == set(range(100, 140))
    assert {r["doc_id"]: r["n"] for r in out}[0] == 2  # the row that repeats


def test_secrets_of_an_empty_table_and_of_one_label(spark, findings):
    assert scan(spark.createDataFrame([], DOCS)).count() == 0
    out = scan(spark.createDataFrame(findings[:5], DOCS)).collect()
    assert len(out) == 5 and all(r["is_secret"] and r["probability"] == 1.0 for r in out)


def test_candidates_take_name_and_value_apart(spark):
    row = candidates(spark.createDataFrame([(1, "set API_TOKEN=abcDEF123456abcDEF now", None, None, None, None)], DOCS)).first()
    assert row["candidate"] == "abcDEF123456abcDEF" and row["before"].endswith("API_TOKEN=")


def test_every_row_is_in_one_shard(spark):
    rng = random.Random(4)
    rows = [(k % 300, key(rng, 2000), "s", None, "clash", k) for k in range(600)] + [(None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    root = fresh_path(spark, "shards-test")
    out = shard_documents(docs, root, arrivals=5, target_bytes=200_000).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    rows_in = Counter(r["shard"] for r in out)
    assert all(r["shard_rows"] == rows_in[r["shard"]] and r["shard_bytes"] > 0 for r in out)
    store = Store(spark, root, 200_000)
    assert not store.plan(store.manifest()) and {s.path.rsplit("/", 1)[-1] for s in store.manifest()} == set(rows_in)
    assert len(rows_in) < 40  # fewer than the 40 files that arrived
    back = Counter(map(tuple, spark.read.parquet(*[s.path for s in store.manifest()]).select(docs.columns).collect()))
    assert back == Counter(rows)


def test_a_version_is_committed_once(spark):
    store = Store(spark, fresh_path(spark, "shards-test"))
    assert store.manifest() == [] and store.compact() is None
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(RuntimeError):
        store.commit([], 0)
    assert store.versions() == [1] and len(store.manifest()) >= 1


def test_runs_are_of_one_tier_and_near_the_target(spark):
    store = Store(spark, fresh_path(spark, "shards-test"), target_bytes=1_000_000, fan=4)
    small = [Shard(f"a{k:02}", 50_000, 0) for k in range(30)]
    large = [Shard("big", 600_000, 1), Shard("mid", 200_000, 1)]
    runs = store.plan(small + large)
    assert [len(r) for r in runs] == [20, 10] and all(s.size == 50_000 for r in runs for s in r)


def test_shards_of_an_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], DOCS), fresh_path(spark, "shards-test")).count() == 0


def test_digests_are_those_of_the_source(spark):
    rows = [(1, 0, "user", "hi ### there"), (1, 1, "assistant", "a</turn>\\"), (1, 2, None, None), (2, 0, "assistant", None), (None, 0, "tool", "x"), (1, 1, "assistant", "a</turn>\\")]
    out = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest("user\nhi ### there\n" + "assistant\na</turn>\\\n" * 2 + "\n\n") and out[1]["n_turns"] == 4
    assert out[1]["loss_sha256"] == digest("a</turn>\\" * 2) and out[1]["loss_chars"] == 18
    assert out[2]["loss_chars"] == 0 and out[2]["loss_sha256"] == digest("") and out[None]["n_turns"] == 1
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pages_with_nulls_and_clashing_columns(spark):
    body = "".join(f"<p>Sentence number {k} of the long article goes here.</p>" for k in range(2000))
    rows = [(1, "u", f"<body><article>{body}</article><footer>no</footer></body>", "clash", 5), (2, None, None, None, None), (None, "v", "", "", 0), (3, "w", "<p>broken <b", "", 0)]
    rows.append(rows[0])
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 5 and got[1]["text"] == " ".join(f"Sentence number {k} of the long article goes here." for k in range(2000))
    assert got[2]["text"] == got[None]["text"] == "" and got[3]["text"].startswith("broken") and all(r["n_chars"] == len(r["text"]) for r in out)
