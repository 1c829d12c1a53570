"""Packing against the optimum of small cases and against plain best fit."""

import random
from bisect import bisect_left

from bizfit.llm import packing as P


def total(place):
    return sum(P.cost(c) for c in {b: c for b, _, c in place}.values())


def optimum(lengths, caps):
    """Least cost over all partitions into bins."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(P.cost(caps[bisect_left(caps, u)]) for u in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= caps[-1]:
                go(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def best_fit(lengths, capacity, caps):
    """Cost of plain best fit, longest first, with one capacity, downsized."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [j for j, u in enumerate(bins) if u + n <= capacity]
        if fits:
            bins[max(fits, key=lambda j: bins[j])] += n
        else:
            bins.append(n)
    return sum(P.cost(caps[bisect_left(caps, u)]) for u in bins)


def check(lengths, place, caps):
    bins = {}
    for (b, at, c), n in zip(place, lengths, strict=True):
        bins.setdefault(b, []).append((at, n, c))
    for content in bins.values():
        end = 0
        for at, n, c in sorted(content):
            assert at == end
            end += n
        assert {c for *_, c in content} == {min(x for x in caps if x >= end)}


def test_near_the_optimum_of_small_cases():
    rng, caps, ratio = random.Random(1), [512, 1024, 2048, 4096], []
    for _ in range(60):
        lengths = [rng.choice([rng.randrange(1, 300), rng.randrange(300, 1500), rng.randrange(1500, 4097)]) for _ in range(7)]
        place = P.pack(lengths)
        check(lengths, place, caps)
        ratio.append(total(place) / optimum(lengths, caps))
    assert max(ratio) < 1.6 and sum(ratio) / len(ratio) < 1.12


def test_joint_choice_beats_one_capacity():
    rng, caps = random.Random(2), [512, 1024, 2048, 4096]
    for kind in (lambda: int(min(4096, rng.lognormvariate(5.5, 1.2))) + 1, lambda: rng.choice([500, 1010, 2000, 30]), lambda: rng.randrange(1, 4097)):
        lengths = [min(4096, kind()) for _ in range(1500)]
        place = P.pack(lengths)
        check(lengths, place, caps)
        assert total(place) <= min(best_fit(lengths, c, caps) for c in caps if c >= max(lengths)) * 1.0001
        assert len({c for *_, c in place}) > 1
        assert sum(lengths) / sum(c for c in {b: c for b, _, c in place}.values()) > 0.9


def test_awkward_rows(spark):
    rows = [(k, "w " * n) for k, n in enumerate([0, 1, 4095, 4096, 9000, 200, 200])] + [(None, None), (7, ""), (5, "w " * 200)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n_tokens int, bin int, capacity int")
    out = P.pack_documents(docs).collect()
    held = {}
    for r in out:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["n_tokens"]
    assert held == {0: 1, 1: 2, 2: 4096, 3: 4097, 4: 9001, 5: 402, 6: 201, None: 1, 7: 1}
    assert P.pack_documents(docs.limit(0)).count() == 0
    assert P.pack([4096, 1]) == [(0, 0, 4096), (1, 0, 512)] and P.pack([]) == []
