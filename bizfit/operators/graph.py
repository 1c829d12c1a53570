"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bizfit.operators.shared import cut, discard


#: Up to so many edges all those of one node fit any task.
ONE_TASK_EDGES = 2_000_000
#: Edges that a task gathers before it reduces them.
CHUNK = 1 << 20


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (not large) neighbours on its smallest neighbour.

    Minima are counted with partial sums and joined back to the edges. In a table with
    ``many`` edges a hub may hold any share of them: there the minima are written first,
    so that the join is one of two shuffled sides, which is split where it is skewed.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = both.groupBy("src").agg(F.min("dst").alias("low"))
    seen = both.join(cut(low, "cc-low") if many else low, "src").withColumn("low", F.least("low", "src"))
    if large:
        out = seen.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = seen.select("dst", "low").unionByName(seen.select(F.col("src").alias("dst"), "low"))
        out = out.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return out.distinct()


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of these edges that aren't the smallest, by hooking and jumping over whole arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (src, dst) as stars, one a component: what it holds is an edge a node at most, besides CHUNK edges."""
    parts, size, schema = [], 0, None
    squeeze = lambda: contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    for b in batches:
        schema = b.schema
        parts.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        size += b.num_rows
        if size > CHUNK:
            parts, size = [squeeze()], 0
    if parts:
        src, dst = squeeze()
        for at in range(0, len(src), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + CHUNK], f.type) for x, f in zip((src, dst), schema, strict=True)], schema=schema)


def _result(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, within_tasks: bool = False) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    component is the smallest node reachable. Self edges and nulls are ignored;
    an empty table gives an empty result. Rounds stop once a round changes
    nothing; each round is written to the shared folder, so lineage stays short.
    With ``within_tasks`` each task first reduces its edges to stars: few edges,
    which come in one task, need no round then. It pays where edges are few, not
    where they are dealt to many tasks.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    now = both.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    if within_tasks:
        kind, tasks = now.schema["src"].dataType.simpleString(), Observation()
        now = now.mapInArrow(forest, f"src {kind}, dst {kind}").withColumn("_task", F.spark_partition_id())
        now = cut(now.observe(tasks, F.min("_task").alias("low"), F.max("_task").alias("high")).drop("_task"), "cc")
        if tasks.get["low"] == tasks.get["high"]:
            return _result(now)
    else:
        now = cut(now, "cc")
    mark, many = None, now.count() > ONE_TASK_EDGES
    for _ in range(max_rounds):
        stars = _star(now, True, many)
        stars = cut(stars, "cc-stars") if many else stars
        before, now = now, cut(_star(stars, False, many), "cc")
        discard(before)
        discard(stars)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(seen) == mark:
            return _result(now)
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
