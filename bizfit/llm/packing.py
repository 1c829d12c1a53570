"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are numbers of words ([^\\x20\\x09-\\x0D]+) plus one end mark. A document
longer than the largest permitted length is cut into pieces of that length and a
rest, so nothing is dropped. Pieces are placed longest first, each into the open
bin with the least room that still holds it. Where none does, a bin is opened. What a
bin costs grows faster than its length, as attention does: length * (1 + length /
SPAN) + FIXED. For each permitted length the bin is filled in trial from the pieces not
yet placed, the largest that fits next, and the length with the least cost per token
so held is opened. So one choice weighs all lengths against the pieces that are left.
At the end each bin is downsized to the smallest permitted length that holds its
contents.

Documents are dealt at random, by a hash of the id, into groups of about
GROUP_ROWS rows, and each group is packed by itself: groups are tasks of bounded
size and their number grows with the input; the loss to unfilled bins is a few
bins a group. Only ids and lengths are shuffled, not texts.

Nulls: a null text is empty and has length 1; null ids are packed like others.
Rows that repeat are packed each. Equal lengths are placed in the order of the ids, and
of lengths that cost the same the shorter is opened. Empty tables give empty results.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.operators.shared import cut

CAPACITIES = (512, 1024, 2048, 4096)
FIXED = 16
SPAN = 8192
GROUP_ROWS = 4096


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / SPAN) + FIXED


def trial(capacity: int, n: int, left: list[int], at: int) -> int:
    """Tokens a new bin would hold: a piece of ``n`` and, of the lengths from ``at`` on, the largest that fits, again and again.

    ``left`` has the lengths negated, in order, so the longest first.
    """
    held = n
    while at < len(left) and held < capacity:
        at = bisect_left(left, held - capacity, at)
        if at < len(left):
            held -= left[at]
            at += 1
    return held


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, start in the bin, final capacity) of each length, which none exceeds the largest capacity."""
    caps = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = [-lengths[i] for i in order]
    room: list[tuple[int, int]] = []  # (free, bin) of open bins, sorted
    used: list[int] = []
    place = [(0, 0)] * len(lengths)
    for turn, i in enumerate(order):
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = min((c for c in caps if c >= n), key=lambda c: (cost(c) / trial(c, n, left, turn + 1), c)), len(used)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    final = [caps[bisect_left(caps, u)] for u in used]
    return [(b, at, final[b]) for b, at in place]


def pieces(length: int, largest: int) -> list[tuple[int, int]]:
    """(first token, tokens) of each piece of a document."""
    return [(at, min(largest, length - at)) for at in range(0, length, largest)]


def lengths_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.as_buffer().to_pybytes().split()) + 1 if t.is_valid else 1 for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, group, bin, bin_start, capacity (of the bin, downsized)."""
    sizes = cut(lengths_of(docs, doc_id, text), "packing-lengths")
    groups = max(1, -(-sizes.count() // GROUP_ROWS))
    kind = dict(sizes.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, first_token long, n_tokens long, group int, bin int, bin_start long, capacity int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group, largest = int(rows["group"].iloc[0]), max(capacities)
        rows = rows.sort_values(["n_tokens", "doc_id"], kind="stable")
        owner, cuts = [], []
        for k, n in enumerate(rows["n_tokens"].tolist()):
            for p, (at, size) in enumerate(pieces(n, largest)):
                owner.append(k)
                cuts.append((p, at, size))
        at = pack([c[2] for c in cuts], capacities)
        parts, at = np.array(cuts).reshape(-1, 3), np.array(at).reshape(-1, 3)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy()[owner], "piece": parts[:, 0], "first_token": parts[:, 1], "n_tokens": parts[:, 2],
            "group": group, "bin": at[:, 0], "bin_start": at[:, 1], "capacity": at[:, 2],
        })

    spread = F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    return sizes.withColumn("group", spread).groupBy("group").applyInPandas(run, schema)
