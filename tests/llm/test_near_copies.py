"""Near copies against all pairs' exact similarity."""

import random

from bizfit.llm.near_copies import keep_near, near_copies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def make(rng):
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    rows = []
    for k in range(25):
        base = prose(rng.randrange(60, 500))
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.uniform(0.005, 0.035)))):
                copy[at] = f"new{k}"
            rows.append(copy)
    phrase = prose(40)
    rows += [phrase + prose(25) for _ in range(30)]  # a common passage makes no copies
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    return [*rows, (900, None), (901, " "), (902, "a b c"), (903, "A  b c"), (904, "a b d"), (None, "alone here")]


def test_components_match_all_pairs(spark):
    rows = make(random.Random(3))
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets if i is not None}
    near = [(a, b) for a in label for b in label if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 40
    for _ in label:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()} == label | {None: None}
    assert {r["doc_id"] for r in keep_near(docs).collect()} == {i for i in label if label[i] == i} | {None}
    assert keep_near(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Ids that repeat or are null, repeated rows, and texts that differ by case and spaces only."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    near = lambda k: " ".join([*base[:150], f"new{k}", *base[150:]])
    other = [" ".join(f"o{k}x{rng.randrange(900)}" for _ in range(50)) for k in range(4)]
    rows = [(0, near(0), "a"), (1, near(1), "b"), (1, other[0], "c"), (None, near(2), "d"), (None, other[1], "e")]
    rows += [(7, other[2], "g"), (7, other[2].upper().replace(" ", " \t\n"), "f"), (7, other[2], "g"), (None, other[3], "i"), (None, other[3], "h"), (8, "", "j"), (9, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    kept = sorted((str(r["doc_id"]), r["node"]) for r in keep_near(docs).collect())
    assert kept == [("0", "a"), ("1", "c"), ("7", "f"), ("8", "j"), ("None", "e"), ("None", "h")]
