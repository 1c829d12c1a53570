"""Quality rules: counts against plain loops, the fitted accuracies against a plain EM, and which texts stay."""

import math
import random
import re
import string

import numpy as np
import pytest

from bizfit.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    if not words:
        return dict.fromkeys(quality.COUNTS, 0)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)),
        "n_repeat_words": len(covered), "n_upper": sum(c in string.ascii_uppercase for c in text), "n_lower": sum(c in string.ascii_lowercase for c in text), "n_exclamations": text.count("!"),
        "n_repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)), "n_commonest": max(map(words.count, words)), "n_lines": len(lines), "n_stops": sum(c in ".?!" for c in text),
        "n_letterless": sum(not any(c in string.ascii_letters or ord(c) > 127 for c in w) for w in words), "n_digits": sum(c in string.digits for c in text), "n_marks": sum(c in string.punctuation for c in text),
        "n_decorated": sum(not re.fullmatch(r"([0-9A-Za-z]|[^\x00-\x7f])+[.,;:!?]?", w) for w in words), "n_triples": sum(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False)),
    }


@pytest.mark.parametrize("seed", range(6))
def test_counts_match_plain_loops(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "The", "end.", "é€", "\U0001f600", "\xa0", "x***", "|", "12", "SHOUT!!", "\x1c", "日本"]
    for n in (0, 1, 7, 8, 9, 16, 60, 300):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(n))
        text += text[: len(text) // 3]
        assert dict(zip(quality.COUNTS, quality.count(text.encode()), strict=True)) == plain_counts(text)


def plain_fit(patterns):
    """{votes: log odds} of {votes: texts}, one text pattern, rule and vote at a time."""
    good = {v: 1 - 0.5 * ("b" in v) - 0.4 * (v.count("b") > v.count("g")) for v in patterns}
    for _ in range(quality.ROUNDS):
        share = []
        for favoured, of in ((quality.PRIOR, lambda v: 1 - good[v]), (0, lambda v: good[v])):
            share.append([])
            for r in range(len(quality.RULES)):
                bad = sum(n * of(v) for v, n in patterns.items() if v[r] == "b")
                cast = sum(n * of(v) for v, n in patterns.items() if v[r] != "-")
                share[-1].append(min(1 - quality.DOUBT, max(quality.DOUBT, (bad + favoured) / (cast + quality.PRIOR))))
        share[0] = [max(x) for x in zip(*share, strict=True)]
        p = (sum(n * good[v] for v, n in patterns.items()) + quality.PRIOR) / (sum(patterns.values()) + 2 * quality.PRIOR)
        p = min(1 - quality.DOUBT, max(quality.DOUBT, p))
        odds = {
            v: math.log(p / (1 - p)) + sum(math.log(share[1][r] / share[0][r]) if x == "b" else math.log((1 - share[1][r]) / (1 - share[0][r])) for r, x in enumerate(v) if x != "-")
            for v in patterns
        }
        good = {v: 1 / (1 + math.exp(-x)) for v, x in odds.items()}
    return odds


def make(rng):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("rin", "sol", "t", "mal")]
    prose = lambda n: " ".join(rng.choice(words) + ("." if k % 9 == 8 else "") + ("\n" if k % 40 == 39 else "") for k in range(n))
    spoil = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | "), lambda t: " ".join(f"{w} " * 12 for w in t.split()[:40])]
    rows = [(k, prose(rng.randrange(30, 400)), 1) for k in range(400)]
    return rows + [(1000 + k, spoil[k % 4](prose(rng.randrange(60, 300))), 0) for k in range(80)]


def test_verdicts_follow_a_plain_em_and_separate_spoilt_texts(spark):
    rows = [*make(random.Random(6)), (2000, None, 0), (2001, "", 0), (None, "one two", 0), (2002, "x y z " * 40_000, 0), (0, "again " * 30, 0)]
    docs = spark.createDataFrame([(i, t, "v", 9.9, True) for i, t, _ in rows], "doc_id long, text string, votes string, odds double, kept boolean").repartition(5)
    out = quality.filter_quality(docs).collect()
    assert len(out) == len(rows)
    patterns = {}
    for r in out:
        patterns[r["votes"]] = patterns.get(r["votes"], 0) + 1
    odds = plain_fit(patterns)
    label = {i: y for i, _, y in rows}
    for r in out:
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == base and r["kept"] == (not base and odds[r["votes"]] >= 0)
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-odds[r["votes"]])), abs=6e-5)
        assert r["kept"] == bool(label[r["doc_id"]]) or r["doc_id"] == 0
    assert next(r for r in out if r["doc_id"] == 2000)["votes"] == "-" * len(quality.RULES)


def test_no_texts(spark):
    assert quality.filter_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_rule_is_never_turned_round():
    """Where most texts break one rule, that rule's vote still never speaks for a text."""
    votes = np.array([[1, -1, -1], [-1, -1, -1], [-1, 1, 1]])
    _, adds = quality.fit(votes, np.array([900.0, 50.0, 50.0]))
    assert (adds[0] <= 1e-12).all() and (adds[1] >= -1e-12).all()
