"""The pipeline's rows against a plain version of its five stages."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

from bizfit.llm.packing import CAPACITIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def plain_survivors(rows, items):
    """Ids that the first four stages keep, and their texts."""
    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    largest = {}
    for i, t in kept.items():
        key = t.encode().lower()
        largest[key] = max(i, largest.get(key, i))
    kept = {i: kept[i] for i in largest.values()}
    sets, label = {i: shingle_set(t) for i, t in kept.items()}, {i: i for i in kept}
    moved = True
    while moved:
        moved = False
        for a in kept:
            for b in kept:
                if label[b] < label[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a], moved = label[b], True
    kept = {i: t for i, t in kept.items() if label[i] == i}
    return {i: t for i, t in kept.items() if not any(f" {item} " in f" {t.lower()} " for item in items)}


def make(rng):
    word = lambda k, tongue: f"{tongue}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}"
    prose = lambda n, tongue: " ".join(word(rng.randrange(600), tongue) for _ in range(n))
    items = [" ".join(f"item{k}word{j}" for j in range(25)) for k in range(3)]
    rows = [(k, prose(rng.randrange(1, 400), "e" if k % 2 else "o")) for k in range(40)]
    rows += [(100 + k, rows[k][1].upper()) for k in range(5)]  # exact copies, some of them of one another
    rows += [(110, rows[0][1]), (111, rows[0][1])]
    long = prose(2000, "e")
    words = prose(400, "o").split()
    for k in range(12):  # from near 1 down to under 0.8: at 4 bits of a fingerprint most of these are apart
        rows.append((500 + k, " ".join("oxx" if j % (400 // (3 * k + 1)) == 7 else w for j, w in enumerate(words))))
    rows += [(200, long), (201, long + " tail"), (202, "head " + long), (203, long.replace(" e", " o", 1))]
    rows += [(300 + k, f"{prose(60, 'o')} {items[k]} {prose(60, 'o')}") for k in range(3)]
    rows += [(400, None), (401, ""), (402, " 12 .. 34"), (403, prose(9000, "e"))]
    return rows, items


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    rows, items = make(random.Random(5))
    langs = [(i, t, None if i % 7 == 0 else "ee" if t and t[0] == "e" else "oo", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(langs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_survivors(rows, items)
    placed, bins = {}, {}
    for r in out:
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault((r["group"], r["bin"]), []).append((r["bin_start"], r["n_tokens"], r["capacity"]))
    assert placed == {i: len(t.split()) + 1 for i, t in want.items()}
    for content in bins.values():
        at = 0
        for start, n, _ in sorted(content):
            assert start == at
            at += n
        assert {c for *_, c in content} == {min(c for c in CAPACITIES if c >= at)}
    assert {300, 301, 302, 400, 401, 402}.isdisjoint(placed) and 403 in placed


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(1, "one text of words", "en", "s", 17), (2, "ONE text of words", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
