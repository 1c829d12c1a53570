import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bizfit.llm import language_model


def test_counts_and_base_score_match_a_plain_version(spark):
    rows = [(k, f"The cat {k % 7} saw THE dog x and word{k}\tagain") for k in range(60)] + [(60, None), (61, ""), (62, " \n "), (3, "twice"), (None, "no id")]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, word string, n double")
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    counts = Counter(w for k, t in rows if not held(k) for w in words(t))
    total, room = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(k), held(k), len(words(t)), sum(w in counts for w in words(t)), total, round(sum(math.log10((counts[w] + 0.5) / room) for w in words(t)), 6)) for k, t in rows)
    got = language_model.score_documents(table).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_samples_cover_all_counts_evenly():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 200, 500)
    got = np.bincount(language_model.samples(np.arange(500), counts, int(counts.sum()) // 10, rng), minlength=500)
    assert (abs(got - counts / 10) <= 1.01).all() and got.sum() == counts.sum() // 10


def test_training_in_several_tasks_learns_the_counts(spark, monkeypatch):
    """Each class is followed by one of its own two classes; the averaged model finds them."""
    monkeypatch.setattr(language_model, "LEAST", 80_000)
    monkeypatch.setattr(language_model, "TASKS", 3)
    k = language_model.HEADS + language_model.TAILS
    rows = [(((a * k) + b) * k + (b * 7 + d) % 40, 50 + (a + b + d) % 9) for a in range(40) for b in range(40) for d in (0, 1)]
    grams = spark.createDataFrame(rows, "code long, n long").repartition(6)
    total = sum(n for _, n in rows)
    table = language_model.train(grams, total, draw=1)
    assert (10.0**table[:40]).sum(axis=1) == pytest.approx(np.ones(40), rel=1e-4)
    mass = [sum(10.0 ** table[a * k + b, (b * 7 + d) % 40] for d in (0, 1)) for a in range(0, 40, 7) for b in range(40)]
    assert np.mean(mass) > 0.8
    again = language_model.train(grams, total, draw=1)
    assert np.allclose(table, again, atol=1e-6)


def test_probabilities_of_a_context_sum_to_one():
    out = language_model.normalised(np.ones((2, 3, 2)), np.arange(6.0).reshape(3, 2), np.zeros(3))
    assert (10.0**out).sum(axis=1) == pytest.approx(np.ones(9))
