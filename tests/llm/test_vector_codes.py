"""Product codes against a plain computation that compares everything."""

import hashlib

import numpy as np
import pytest

from bizfit.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _label int"


def plain(rows):
    """Codes, errors, label errors and hash of rows (vec_id, vector, label), with Python's own integers."""
    kept = [(i, x, y) for i, x, y in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(np.float64(np.float32(c)) * 1024)) for c in x] for _, x, _ in kept]
    d = len(ints[0]) // 4
    parts = [[x[p * d : p * d + d] for x in ints] for p in range(4)]
    codes, books = [], []
    for p in range(4):
        book = [list(x) for x in parts[p][:256]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))  # noqa: B023, E731
        for _ in range(4):
            groups = {}
            for x in parts[p]:
                groups.setdefault(near(x)[1], []).append(x)
            for k, g in groups.items():
                book[k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        codes.append([near(x) for x in parts[p]])
        books += [str(c) for entry in book for c in entry]
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    errors = [sum(codes[p][k][0] for p in range(4)) for k in range(len(kept))]
    by_label = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] = by_label.get(y, 0) + e
    return sorted((str(i), str(y), "".join(f"{codes[p][k][1]:02x}" for p in range(4)), errors[k], by_label[y], digest) for k, (i, _, y) in enumerate(kept))


def run(spark, rows):
    table = spark.createDataFrame([(i, x, y, "c", "e", 1) for i, x, y in rows], SCHEMA).repartition(3)
    return sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in v.compress(table).collect())


@pytest.mark.parametrize(("n", "clusters"), [(420, 5), (300, 300), (40, 3)])
def test_codes_match_a_plain_computation(spark, n, clusters):
    rng = np.random.default_rng(n)
    middles = rng.normal(0, 0.4, (clusters, 16))
    rows = [(int(k) * 3, [float(np.float32(c)) for c in middles[rng.integers(clusters)] + rng.normal(0, 0.01, 16)], int(rng.integers(4))) for k in rng.permutation(n)]
    rows += [(7, None, 1), (8, [], 1), (9, [0.5] * 15 + [None], 1), (10, [0.5] * 15 + [float("nan")], 1), (11, [float("-inf")] + [0.5] * 15, 1)]
    rows += [(12, rows[0][1], None), (None, rows[1][1], None), (None, rows[1][1], 2), *rows[:30]]  # null ids and labels, repeated rows
    assert run(spark, rows) == plain(rows)


def test_equal_entries_and_one_hot_label(spark):
    rows = [(k, [0.25, -0.25, 0.001, -0.001] * 2, 5) for k in range(600)] + [(1000 + k, [k / 512] * 8, None) for k in range(100)]
    assert run(spark, rows) == plain(rows)


def test_lengths_and_sizes_without_a_code(spark):
    rows = [(3, [1.0] * 8, 1), (4, [1.0] * 12, 1), (1, [1.0] * 6, 1)]  # 6 isn't divided by 4, 12 differs from the first one's 8
    assert [r[0] for r in run(spark, rows)] == ["3"]
    assert run(spark, []) == run(spark, [(1, None, 2)]) == []
    with pytest.raises(OverflowError):
        v.integers(np.full((1, 8), 1e30))


@pytest.mark.parametrize(("n", "entries", "width"), [(900, 256, 4), (2048, 12, 16), (33, 3, 1), (1, 1, 2), (700, 256, 1)])
def test_trees_give_every_points_nearest_entry(n, entries, width):
    rng = np.random.default_rng(width)
    middles = rng.integers(-900, 900, (6, width))
    x = middles[rng.integers(6, size=n)] + rng.integers(-9, 10, (n, width))
    c = x[rng.integers(n, size=entries)] + rng.integers(0, 2, (entries, width))
    points, book = v.build(x, v.LEAF), v.build(c, 1)
    whole, of = v.assign(points, book)
    want = ((x[:, None].astype(object) - c[None]) ** 2).sum(2).astype(np.int64).argmin(1)
    assert (of == want[points.order]).all()
    assert (n, entries) != (2048, 12) or len(whole) > 5  # clusters are assigned by their sums
    counts, sums = v.totals(points, book)
    assert (counts == np.bincount(want, minlength=entries)).all()
    assert all((sums[k] == x[want == k].sum(0)).all() for k in range(entries))
