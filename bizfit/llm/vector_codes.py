"""Vector code compression: product codes by dual-tree Lloyd rounds in integers.

A vector's components become floor(1024 x), and its PARTS equal consecutive parts get a
byte each: the nearest of the ENTRIES of that position's codebook, the lower index of
equally near ones. Codebooks start from the vectors with the smallest ids and go through
ROUNDS of assigning all parts and moving every entry to the floor of its parts' mean.

Method. In a task, blocks of vectors get a tree for each part position: halves along the
widest axis, with a box, a count and a sum for every node. The codebook has such a tree
too. Both are walked downward together. A pair of nodes whose boxes are farther apart
than another entry node's farthest corner is dropped, and once entries are single, an
entry that another beats at every corner of the points' box. A node of points left with
one entry is assigned whole, by its sum. In leaves with several entries left, integer
distances decide. Every bound is an exact integer and only strictly worse pairs are
dropped, so the result is that of comparing everything. Parts of the spread of random
noise leave little to prune; then most of the work is in the leaves.

Distribution. A round is one pass over the table: tasks add up sums and counts, at most
PARTS * ENTRIES * (dimension / PARTS) numbers each, and the totals, of the same number,
are the only thing the driver gets, besides the first ENTRIES vectors.

Awkward rows. Vectors that are null or empty, or hold a null, NaN or infinity, are
dropped; so are those of another length than the kept vector of the smallest id, or of a
length that PARTS doesn't divide. Null ids are the largest, equal ids are taken in order
of their vectors, repeated rows count as often as they occur. With fewer vectors than
ENTRIES the codebook is as large as they are. Null labels count as one label. An empty
table gives an empty result. Other columns are ignored. Components so large that an error
might not fit a long raise OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import join_groups
from bizfit.operators.shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, LEAF = 2048, 32


class Tree(NamedTuple):
    """Points in the order of the leaves, and of each level the nodes' bounds in that order, boxes and sums."""

    order: np.ndarray
    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def build(points: np.ndarray, leaf: int) -> Tree:
    """Halve along the widest axis until no node has over ``leaf`` points. No node is empty."""
    n = len(points)
    order, bounds = np.arange(n), [np.array([0, n])]
    while np.diff(bounds[-1]).max() > leaf:
        at = bounds[-1]
        middle = (at[:-1] + at[1:]) // 2
        for lo, mid, hi in zip(at[:-1].tolist(), middle.tolist(), at[1:].tolist(), strict=True):
            if mid > lo:
                own = points[order[lo:hi]]
                axis = int(np.argmax(own.max(0) - own.min(0)))
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid - lo)]
        bounds.append(np.unique(np.concatenate([at, middle])))
    points = points[order]
    over = [b[:-1] for b in bounds]
    low, high, sums = ([f.reduceat(points, at, axis=0) for at in over] for f in (np.minimum, np.maximum, np.add))
    return Tree(order, points, bounds, low, high, sums)


def _children(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes`` of the parent, node of the next level) of all children, in order."""
    ends = np.searchsorted(tree.bounds[level + 1], tree.bounds[level])
    first, many = ends[nodes], ends[nodes + 1] - ends[nodes]
    parent = np.repeat(np.arange(len(nodes)), many)
    return parent, first[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)


def _near(p: Tree, level: int, nodes: np.ndarray, e: Tree, e_level: int, entries: np.ndarray) -> np.ndarray:
    """Which pairs stay: those no farther apart than the farthest corners of the best pair of their point node. ``nodes`` is sorted."""
    p_low, p_high, e_low, e_high = p.low[level][nodes], p.high[level][nodes], e.low[e_level][entries], e.high[e_level][entries]
    apart = (np.maximum(np.maximum(p_low - e_high, e_low - p_high), 0) ** 2).sum(1)
    across = (np.maximum(p_high - e_low, e_high - p_low) ** 2).sum(1)
    starts = np.flatnonzero(np.diff(nodes, prepend=-1))
    runs = np.diff(starts, append=len(nodes))
    stay = apart <= np.repeat(np.minimum.reduceat(across, starts), runs)
    if e_level == len(e.bounds) - 1:  # single entries: compare all with the one nearest to the middle of the box
        middle = ((p_low + p_high - 2 * e_low) ** 2).sum(1)
        least = np.repeat(np.minimum.reduceat(middle, starts), runs)
        best = np.maximum.reduceat(np.where(middle == least, np.arange(len(nodes)), -1), starts)
        rival = np.repeat(best, runs)
        step = e_low - e_low[rival]
        lead = 2 * np.where(step > 0, p_high * step, p_low * step).sum(1) + (e_low[rival] ** 2).sum(1) - (e_low**2).sum(1)
        stay &= (lead >= 0) | (rival == np.arange(len(nodes)))
    return stay


def assign(p: Tree, e: Tree) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(level, node, entry) of nodes assigned whole, and the entry of every point in the tree's order."""
    whole, of = [], np.full(len(p.points), -1)
    nodes, entries, level, e_level = np.zeros(1, int), np.zeros(1, int), 0, 0
    last, e_last = len(p.bounds) - 1, len(e.bounds) - 1
    while len(nodes):
        stay = _near(p, level, nodes, e, e_level, entries)
        nodes, entries = nodes[stay], entries[stay]
        if e_level == e_last:
            alone = np.ones(len(nodes), bool)
            same = nodes[1:] == nodes[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            for node, entry in zip(nodes[alone].tolist(), e.order[entries[alone]].tolist(), strict=True):
                whole.append((level, node, entry))
                of[p.bounds[level][node] : p.bounds[level][node + 1]] = entry
            nodes, entries = nodes[~alone], entries[~alone]
        if level == last and e_level == e_last:
            break
        if e_level < e_last:
            parent, entries = _children(e, e_level, entries)
            nodes, e_level = nodes[parent], e_level + 1
        if level < last:
            starts = np.flatnonzero(np.diff(nodes, prepend=-1))
            many = np.diff(starts, append=len(nodes))
            of_run, below = _children(p, level, nodes[starts])  # a child takes all entries of its parent
            taken = many[of_run]
            entries = entries[np.repeat(starts[of_run] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())]
            nodes, level = np.repeat(below, taken), level + 1
    for run in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(nodes)) + 1) if len(nodes) else []:
        lo, hi = p.bounds[level][nodes[run[0]]], p.bounds[level][nodes[run[0]] + 1]
        some = np.sort(e.order[entries[run]])
        codes = e.points[np.argsort(e.order)[some]]
        of[lo:hi] = some[((codes**2).sum(1) - 2 * (p.points[lo:hi] @ codes.T)).argmin(1)]
    return whole, of


def totals(p: Tree, e: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points of each entry: cached sums of whole nodes, points of uncertain leaves one by one."""
    counts, sums = np.zeros(len(e.order), np.int64), np.zeros(e.points.shape, np.int64)
    whole, of = assign(p, e)
    single = np.ones(len(of), bool)
    for level, node, entry in whole:
        lo, hi = p.bounds[level][node], p.bounds[level][node + 1]
        counts[entry] += hi - lo
        sums[entry] += p.sums[level][node]
        single[lo:hi] = False
    np.add.at(counts, of[single], 1)
    np.add.at(sums, of[single], p.points[single])
    return counts, sums


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of (rows, dimension)."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if len(scaled) and vectors.shape[1] * (2 * np.abs(scaled).max() + 2) ** 2 >= 2.0**62:
        raise OverflowError("components so large that an error may not fit a long")
    return scaled.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, list[Tree]]]:
    for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
        x = integers(b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
        yield b, [build(part, LEAF) for part in np.split(x, PARTS, axis=1)]


def kept_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that are not dropped, whatever their length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", "embedding").filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & finite)


def one_round(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round over all vectors."""
    parts, entries, width = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [build(c, 1) for c in codebooks]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, trees in _blocks(batches, parts * width):
            for k, tree in enumerate(trees):
                count, total = totals(tree, books[k])
                counts[k] += count
                sums[k] += total
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part * entries + entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

    found = kept.select("embedding").mapInArrow(add_up, "cell long, n long, sums array<long>")
    found = found.select("cell", "n", F.posexplode("sums").alias("position", "x")).groupBy("cell", "position").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = codebooks.reshape(-1, width).copy()
    for r in found.toLocalIterator():
        out[r["cell"], r["position"]] = r["x"] // r["n"]
    return out.reshape(codebooks.shape)


def encode(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of all vectors."""
    parts, _, width = codebooks.shape
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select("vec_id", "label").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [build(c, 1) for c in codebooks]
        for b, trees in _blocks(batches, parts * width):
            codes, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for k, tree in enumerate(trees):
                of = assign(tree, books[k])[1]
                codes[tree.order, k] = of
                error[tree.order] += ((tree.points - codebooks[k][of]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"{kinds}, code string, error long")


def first_codebooks(kept: DataFrame) -> tuple[int, np.ndarray]:
    """(dimension, codebooks of the first vectors); dimension 0 if there is no vector."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).select(F.size("embedding").alias("n")).first()
    if first is None:
        return 0, np.zeros((PARTS, 0, 0), np.int64)
    rows = kept.filter(F.size("embedding") == first["n"]).orderBy(*order).limit(ENTRIES).select("embedding").collect()
    x = integers(np.array([r["embedding"] for r in rows]))
    return first["n"], x.reshape(len(x), PARTS, -1).transpose(1, 0, 2).copy()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark, kept = rows.sparkSession, kept_vectors(rows)
    dimension, codebooks = first_codebooks(kept)
    kept = kept.filter(F.size("embedding") == dimension)
    for _ in range(ROUNDS if dimension else 0):
        codebooks = one_round(kept, codebooks)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    if not dimension:
        return spark.createDataFrame([], kept.select("vec_id", "label").schema.add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string"))
    named = F.concat(F.when(F.col("label").isNull(), "-").otherwise("+"), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("_label")
    coded = cut(encode(kept, codebooks).select("*", named), "vector-codes")
    labels = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_size")), "vector-labels")
    return join_groups(coded, labels, ["_label"], "_size", coded.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
