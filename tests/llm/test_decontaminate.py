"""Decontamination against a comparison of every offset of every item with every document."""

import random

import numpy as np

from bizfit.llm import decontaminate as D


def plain(items, docs):
    """(doc, item) of every leak, by all diagonals; None stands for an unknown token."""
    out = set()
    for d, text in docs:
        words = D.tokens(text)
        for i, item in items:
            want = D.tokens(item)
            number = {w: k + 1 for k, w in enumerate(dict.fromkeys(want))}
            ids, own = np.array([number.get(w, 0) for w in words], np.uint64), np.array([number[w] for w in want], np.uint64)
            if any(D.overlap(own, ids, at) for at in range(-len(own) + 1, len(ids)) if min(len(own), len(ids) - at) > max(0, -at)):
                out.add((d, i))
    return out


def spoil(rng, words, share):
    hit = set(rng.sample(range(len(words)), round(len(words) * share)))
    return ["zz" if k in hit else w for k, w in enumerate(words)]


def make(rng):
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k, [word() for _ in range(rng.randrange(13, 60))]) for k in range(60)]
    docs = []
    for share in (0.0, 0.05, 0.1, 0.15, 0.2):
        for k, item in items:
            docs.append((len(docs), [*[word() for _ in range(30)], *spoil(rng, item, share), *[word() for _ in range(30)]]))
    docs += [(len(docs) + k, [word() for _ in range(200)]) for k in range(50)]
    return [(k, " ".join(w)) for k, w in items], [(k, " ".join(w)) for k, w in docs]


def test_recall_against_all_windows(spark):
    items, docs = make(random.Random(4))
    want = plain(items, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got <= want  # nothing that isn't a leak
    assert len(got) >= 0.98 * len(want) and len(want) >= 290
    exact = {(k, k) for k in range(120)}  # up to a twentieth of the tokens substituted
    assert exact & want <= got


def test_short_items_are_found_whatever_is_substituted():
    for n in range(1, D.PARTED):
        item = [f"a{k}" for k in range(n)]
        bench = D.Bench([(1, " ".join(item))])
        spare = int(n * (1 - D.MIN_SHARE) + 1e-9)
        import itertools

        for hit in itertools.islice(itertools.combinations(range(n), spare), 400):
            text = " ".join("zz" if k in hit else w for k, w in enumerate(item))
            assert bench.leaks(f"x y {text} z"), (n, hit)
        assert not bench.leaks("x y z") and not (n > 1 and bench.leaks(" ".join(item[: n // 2])))


def test_blocks_and_awkward_rows(spark, monkeypatch):
    items, docs = make(random.Random(5))
    bench = spark.createDataFrame([*items, items[0], (None, "an item with no id whatever here"), (901, None), (902, ""), (903, "...")], "item_id long, text string")
    long = " ".join(f"q{k}" for k in range(200_000))
    rows = [*docs[:80], docs[0], (700, None), (701, ""), (702, f"{long} {items[3][1]} {long}"), (None, items[2][1]), (703, "say: an item, with NO id whatever here")]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, item_id string, n_equal int, first_token int")
    one = sorted(map(str, D.find_leaks(table, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 1500)
    assert len(list(D.blocks(bench))) > 4
    assert sorted(map(str, D.find_leaks(table, bench).collect())) == one
    leaks = D.find_leaks(table, bench)
    found = {(r["doc_id"], r["item_id"]) for r in leaks.collect()}
    assert {(702, 3), (None, 2), (703, None)} <= found
    clean = D.keep_clean(table, bench)
    assert clean.columns == table.columns and clean.count() == len(rows) - sum((i, ) in {(x,) for x, _ in found} for i, _ in rows)
    assert D.leaking_documents(leaks).count() == len({d for d, _ in found})
    assert D.find_leaks(table.limit(0), bench).count() == 0 and D.keep_clean(table, bench.limit(0)).count() == len(rows)
