"""Pages of a kept ranking against offset and limit, and bounds of name similarities."""

import random

import pytest
from pyspark.sql import functions as F

from bizfit.operators import graph, match, score, search


def test_deep_pages_read_few_files(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).select(F.concat(F.lit("c"), "id").alias("id"), F.round(F.pmod(F.xxhash64("id"), F.lit(1000)) / 10, 1).alias("score"))
    ranked = score.ranked(rows)
    ranking = search.keep_ranking(ranked, f"{tmp_path}/r", slab=500)
    want = [tuple(r) for r in ranked.collect()]
    for offset, limit in ((0, 20), (490, 20), (50_000, 20), (59_990, 20), (60_500, 20), (3, 0)):
        page = ranking.page(offset, limit)
        assert [(r["id"], r["score"]) for r in page.collect()] == want[offset : offset + limit]
        scan = page._jdf.queryExecution().executedPlan().toString()
        assert not want[offset : offset + limit] or "_slab" in scan.split("PartitionFilters: [")[1].split("]")[0]
    slabs = {int(f.split("_slab=")[1].split("/")[0]) for f in ranking._read(50_001, 50_020).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert slabs == {100}
    first = ranking.page(0, 20).collect()
    assert [r["id"] for r in ranking.after(first[-1]["place"], 20).collect()] == [i for i, _ in want[20:40]]


def test_an_empty_ranking(spark, tmp_path):
    ranked = score.ranked(spark.createDataFrame([], "id string, score double"))
    assert search.in_order(ranked).count() == 0


def test_many_similarities_at_once_and_their_bound(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé日 x\U0001f600") for _ in range(rng.choice([0, 1, 3, 10, 30, 63, 64, 65, 90])))
    a = [" ".join(word().split()) for _ in range(3000)]
    b = [x[::-1] if rng.random() < 0.3 else " ".join(word().split()) for x in a]
    want = [match.token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert match.token_sort_ratios(a, b).tolist() == want
    pairs = spark.createDataFrame(list(zip(a, b, want, strict=True)), "a string, b string, similarity double")
    bound = match.most_similar(match.letter_counts(F.col("a")), match.letter_counts(F.col("b")))
    assert pairs.filter(bound < F.col("similarity")).count() == 0
    assert pairs.filter(match.name_similarity("a", "b") != F.col("similarity")).count() == 0


@pytest.mark.parametrize(("tasks", "within"), [(1, True), (7, True), (1, False)])
@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_of_paths_and_hubs(spark, shape, tasks, within, monkeypatch):
    n, rng = 3000, random.Random(3)
    edges = {"path": [(k, k + 1) for k in range(n)], "star": [(n, k) for k in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]}[shape]
    rounds = []
    monkeypatch.setattr(graph, "_star", lambda *a, f=graph._star: rounds.append(1) or f(*a))
    if tasks > 1:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame([*edges, (5, 5)], "a long, b long"), "a", "b", within_tasks=within).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    parent = dict(label)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            u, v = sorted((find(u), find(v)))
            parent[v] = u
    assert got == {x: find(x) for x in label}
    assert not rounds if tasks == 1 and within else rounds  # few edges come in one task and need no round


def test_components_of_text_nodes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), (None, "z"), ("q", "q")], "a string, b string")
    assert {(r["node"], r["component"]) for r in graph.connected_components(edges, "a", "b", within_tasks=True).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.connected_components(edges.limit(0), "a", "b", within_tasks=True).count() == 0
