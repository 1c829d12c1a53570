import numpy as np

from bizfit.llm import near_copies


def test_probes_find_pairs_beside_the_smallest_of_a_key(spark):
    """All texts within four bits are candidates where no link joins them yet, not only those near the smallest of a key, and without any help of the bands."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = list(rng.permutation(words)[:300])
        for _ in range(6):
            text = list(base)
            for at in rng.integers(0, 300, 1):
                text[at] = f"x{k}"
            rows.append((k, " ".join(text)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, node long, fp long, n int, halvings int, odd array<long>, keys array<long>"
    nodes = docs.mapInArrow(near_copies._sketches, schema).drop("doc_id").cache()
    parts = nodes.selectExpr("node", "node AS part").cache()
    got = {tuple(r) for r in near_copies.golay_pairs(nodes, parts).distinct().collect()}
    fps = {r["node"]: r["fp"] for r in nodes.collect()}
    near = {(a, b) for a in fps for b in fps if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 4}
    assert near and got <= near and len(got) >= 0.9 * len(near)
