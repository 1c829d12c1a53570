"""Labelled secrets, model scores against a plain sum, hot components and long conversations."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bizfit.llm import chat, language_model, near_dedup, secrets


def test_secrets_from_labelled_findings(spark):
    """Labels that the built-in rules would not give: here ids after "ref" are real and those after "token" are not."""
    rng = random.Random(7)
    code = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(40))
    made = [(k, f"note {'ref' if k % 2 else 'token'} = {code()} end", "src") for k in range(240)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    found = secrets.features(secrets.candidates(docs), secrets.dictionary(docs))
    marks = spark.createDataFrame([(k, float(k % 2)) for k in range(120)], "doc_id long, rule double")
    out = {r["doc_id"]: r["is_secret"] for r in secrets.scan(docs, labelled=found.join(marks, "doc_id")).collect()}
    held = range(120, 240)
    assert sum(out[k] == bool(k % 2) for k in held) / len(held) > 0.95
    plain = {r["doc_id"]: r["is_secret"] for r in secrets.scan(docs).collect()}
    assert plain != out and len(plain) == 240


def test_secrets_on_awkward_rows(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("Ab1+/" * 12 for _ in range(20)) + "\n-----END RSA PRIVATE KEY-----"
    rows = [(1, None, None), (2, "", "s"), (None, "password = \"hunter2!\"", None), (3, f"x {pem} y", "a/b"), (4, "word " * 50_000 + "token=" + "a1B2" * 10, "s")] + [(5, "secret: 'p@ss w0rd'", "s")] * 2
    docs = spark.createDataFrame([(*r, "c", 1.0, 2) for r in rows], "doc_id long, text string, source string, candidate string, probability double, length int")
    got = {(r["doc_id"], r["candidate"]): r["n"] for r in secrets.scan(docs).collect()}
    assert got[(None, "hunter2!")] == 1 and (3, pem) in got and got[(4, "a1B2" * 10)] == 1 and got[(5, "p@ss w0rd")] == 2
    assert secrets.scan(docs.limit(0)).count() == 0


def test_scores_match_a_plain_sum(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randrange(0, 80)))) for k in range(120)]
    rows += [(500, None), (501, "only new words here"), (None, "w1 w2"), (502, "W1 " * 30_000), (0, rows[0][1])]
    kept = {}
    train = language_model.train
    monkeypatch.setattr(language_model, "LEAST", 120_000)
    monkeypatch.setattr(language_model, "FREQUENT", 150)  # the others go by the count table
    monkeypatch.setattr(language_model, "train", lambda *a: kept.setdefault("table", train(*a)))
    docs = spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows], "doc_id long, text string, score double, n_tokens int")
    out = language_model.score_documents(docs).collect()
    assert len(out) == len(rows)

    split = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*split(t), b""])
    total, types = sum(counts.values()), len(counts)
    heads = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w][: language_model.HEADS - 1]
    cls = {w: k + 1 for k, w in enumerate(heads)} | {b"": 0}
    of = lambda w: cls[w] if w in cls else language_model.HEADS + language_model.tail_class(w)
    k = language_model.HEADS + language_model.TAILS
    in_class = np.zeros(k)
    for w, c in counts.items():
        in_class[of(w)] += c
    unknown = 0.5 / (total + 0.5 * (types + 1))
    want = {}
    for i, t in rows:
        a = b = 0
        base = score = 0.0
        for w in [*split(t), b""]:
            c, x = counts.get(w, 0), of(w)
            base += math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
            score += float(kept["table"][a * k + b, x]) + math.log10((1 - unknown) * c / in_class[x]) if c else math.log10(unknown)
            a, b = b, x
        want[i] = (base, score, len(split(t)) + 1, sum(w in counts for w in [*split(t), b""]))
    for r in out:
        base, score, n, known = want[r["doc_id"]]
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))


@pytest.mark.parametrize("which", ["none", "no training part"])
def test_scores_without_training(spark, which):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = spark.createDataFrame([] if which == "none" else [(held, "a b")], "doc_id long, text string")
    out = language_model.score_documents(docs).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in out] == ([] if which == "none" else [(0, 0)])


def test_fingerprint_links_on_awkward_rows(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join([*base[:1500], f"x{k}", *base[1500:]])) for k in range(150)]  # a component of most rows
    rows += [(200 + k, " ".join(rng.sample(base, 60))) for k in range(40)] + [(300, None), (301, ""), (None, " "), (302, "q " * 100_000), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, "p", 3) for i, t in rows], "doc_id long, text string, fp int, key int, part string, component_id int")
    out = near_dedup.near_dedup(docs).collect()
    fps = {i: near_dedup.fingerprint((t or "").encode()) & (1 << 64) - 1 for i, t in rows}
    label = {i: i for i in fps if i is not None}
    for _ in range(6):
        for a in label:
            for b in label:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    assert len(out) == len(rows)
    assert all(r["fingerprint"] == f"{fps[r['doc_id']]:016x}" for r in out)
    assert all(r["component_id"] == (300 if r["doc_id"] is None else label[r["doc_id"]]) for r in out)


def test_long_conversations_and_clashing_names(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} ### </turn> \\" * (k % 5)) for k in range(3000)] + [(2, 0, "assistant", "x" * 300_000), (3, 0, "odd role\n", "")]
    docs = spark.createDataFrame([(*r, "f", "l") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_sha256 string")
    out = {r["conv_id"]: r for r in chat.chat_digests(docs).collect()}
    for c in (1, 2, 3):
        mine = [r for r in rows if r[0] == c]
        assert out[c]["n_turns"] == len(mine)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest()
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
