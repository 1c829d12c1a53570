import random

import numpy as np
import pytest

from bizfit.llm import chat, decontaminate, html_text, near_dedup, packing
from bizfit.llm.exact_dedup import exact_dedup, keep_exact, split_buckets
from bizfit.llm.language_id import Model, language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello There", "en", "s", 1, "x"), (2, "hello there", "en", "s", 1, "x"), (2, "hello there", "en", "s", 1, "x"), (3, None, None, None, None, None)]
    rows += [(4, "", "en", "s", 0, "x"), (None, "alone here", None, "s", 0, "x"), (5, "ÉTÉ", "fr", "s", 0, "x"), (6, "été", "fr", "s", 0, "x"), (7, "word " * 30_000, "en", "s", 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)}
    kept = keep_exact(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert exact_dedup(docs.limit(0)).count() == 0


def test_buckets_split_until_they_fit():
    leaves = split_buckets({0: 9, 1: 1, 5: 4}, 3, 5)
    assert sum(w for _, w, _ in leaves) == 8 and all(n <= 5 or w == 1 for _, w, n in leaves)


def test_golay_keys_meet_for_all_near_fingerprints():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(63) for _ in range(3000)], np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(63), 4):
            b[i] ^= np.int64(1 << bit)
    _, probes, rows = near_dedup.keys_of(a)
    index, _, _ = near_dedup.keys_of(b)
    asked = [set() for _ in a]
    for key, row in zip(probes.tolist(), rows.tolist(), strict=True):
        asked[row].add(key)
    assert all(asked[i] & set(index[i].tolist()) for i in range(len(a)))


def test_near(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(10, base), (11, base.replace("w299", "zz")), (12, base.upper()), (20, " ".join(f"v{k}" for k in range(200))), (30, None), (31, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in near_dedup.near_dedup(table).collect()}
    fps = {k: int(v["fingerprint"], 16) for k, v in out.items()}
    label = {k: k for k in fps}
    for _ in fps:
        for x in fps:
            for y in fps:
                if (fps[x] ^ fps[y]).bit_count() <= 4:
                    label[x] = label[y] = min(label[x], label[y])
    assert {k: v["component_id"] for k, v in out.items()} == label and fps[30] == 0
    assert near_dedup.near_dedup(table.limit(0)).count() == 0


def test_pieces_match_a_plain_parse():
    model = Model({"a": ["abracadabra abba"], "b": ["the quick brown fox"]})
    text = model.symbols(np.array([ord(c) if c != " " else 0 for c in "abba the fox"], np.int32))
    for n, sample in enumerate(("abracadabra abba ", "the quick brown fox ")):
        count, at, body = 0, 0, "abba the fox"
        while at < len(body):
            size = max([k for k in range(1, len(body) - at + 1) if body[at : at + k] in sample], default=1)
            at, count = at + size, count + 1
        assert model.pieces([text])[0, n] == count


def test_language(spark, docs):
    rows = [(k, "the cat and the dog ran to the house" if k % 2 else "le chat et le chien dans la maison", "en" if k % 2 else "fr") for k in range(60)]
    out = language_id(spark.createDataFrame([*rows, (99, None, None), (100, "12 ..", "en")], "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("und" if r["doc_id"] > 60 else "en" if r["doc_id"] % 2 else "fr") for r in out)
    assert language_id(docs.limit(0)).count() == 0


def test_leaks_tolerate_substitutions(spark):
    item = " ".join(f"term{k}" for k in range(40))
    spoilt = " ".join("other" if k % 7 == 3 else f"Term{k}," for k in range(40))
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, f"a b {spoilt}"), (3, "nothing of the kind"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x"), (9, "too short")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 7), (2, 7), (1, None)}
    assert decontaminate.keep_clean(docs, bench).count() == 2
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_packing(docs):
    place = packing.pack([5, 3, 4, 9, 1], (8, 16))
    used = {}
    for (b, _, cap), n in zip(place, [5, 3, 4, 9, 1], strict=True):
        used.setdefault(b, [cap, 0])[1] += n
    assert all(n <= cap for cap, n in used.values())
    out = packing.pack_documents(docs).toPandas()
    assert out.n_tokens[out.doc_id == 7].sum() == 30_001 and out.doc_id.isna().sum() == 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_chat_comes_back():
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "plain \\n"), ("odd\n\"role", "### </turn></turn>"), ("", "")]
    formatted, back = chat.format_conversation(turns)
    assert [t[:2] for t in back] == turns and formatted.count("</turn>") == 4


def test_html():
    page = "<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>take it</div><article><h1>T</h1><p>One &amp; two<b>bold</b> <p>x</p></article><div id=comments>me</div><footer>f</footer></body></html>"
    assert html_text.extract(page) == "T One & twobold x"
    assert html_text.extract(None) == "" and html_text.extract("") == ""
