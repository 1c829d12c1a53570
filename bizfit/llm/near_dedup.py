"""SimHash near-duplicates linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two
fingerprints at most 4 bits apart have two segments with at most one differing
bit each, or else the differences fall 2 and 2 and the third segment is equal.
The first case is found by the binary Golay code of length 23, in which each word
is within 3 bits of exactly one codeword: a word has its own codeword, and those that
its one-bit neighbours decode to, which are one to six. Keys of two segments are
combined into one. Of a pair, the lower fingerprint takes the neighbours' codewords in a
key's first segment and the higher one in its second, so that they meet: some 38 keys a
fingerprint, where all of one and the own of the other are 94. The second case is found
by the segment's value. Every match is verified by counting differing bits.

Equal fingerprints are combined first. Each key's members are first linked to
the smallest of them, where near enough; only pairs that these links leave in
different components are then compared, so a group of near copies doesn't yield
all its pairs, and no link between components is lost.

Nulls: a null text is empty, with fingerprint zero, linked like any other. A
null doc_id is never a component's smallest id unless all are null. Repeated rows
each get a row. Equal fingerprints are one node, whatever their texts, and a key or a
component may hold any share of the rows. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import join_groups, relabel
from bizfit.operators.graph import connected_components
from bizfit.operators.shared import cut

MAX_BITS = 4
SHINGLE = 4
BLOCK = 1 << 15
SCHEMA = "key long, fp long, part long"
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def set_bits(h: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def pack_bits(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text: a bit is 1 if it is set in over half the hashes."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        ones += set_bits(np.array([digest(x, 42) for x in joined], np.uint64))
    return pack_bits(ones * 2 > n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each 12 high bits, error pattern by syndrome, other codewords' messages by syndrome).

    The last has six columns: 0 for the word's own codeword, then the messages,
    relative to it, to which one-bit neighbours decode; unused ones repeat 0.
    """

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    bit = [rest(1 << i) for i in range(23)]
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[bit[i]] = 1 << i
        for j in range(i):
            error[bit[i] ^ bit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bit[i] ^ bit[j] ^ bit[k]] = 1 << i | 1 << j | 1 << k
    high = np.array([rest(x << 11) for x in range(4096)], np.int64)
    other = np.zeros((2048, 6), np.int64)
    for s in range(2048):
        e = int(error[s])
        near = {((e ^ 1 << i) ^ int(error[s ^ bit[i]])) >> 11 for i in range(23)} - {0}
        other[s, 1 : 1 + len(near)] = sorted(near)
    return high, error, other


def decode(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(message of the nearest codeword, messages that may be shared with a one-bit neighbour: six columns, some repeated)."""
    high, error, other = golay()
    s = high[word >> 11] ^ (word & 2047)
    own = (word ^ error[s]) >> 11
    return own, own[:, None] ^ other[s]


def keys_of(fps: np.ndarray, near: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys (n x 6), probe keys and the row each probe key belongs to.

    ``near`` says in which of a key's two segments the neighbours' codewords are taken, too.
    Where one of two near fingerprints takes them in the first and the other in the second,
    their probe keys meet, as those of both segments meet an index key.
    """
    u = fps.astype(np.int64).view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    msg = [decode(s) for s in seg]
    index, probes, rows = [], [], []
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        base = np.int64(kind) << 24
        index.append(base | msg[a][0] << 12 | msg[b][0])
        of_a, of_b = (msg[k][1] if wide else msg[k][1][:, :1] for k, wide in zip((a, b), near, strict=True))
        grid = (of_a << 12)[:, :, None] | of_b[:, None, :]
        first = lambda m: np.concatenate([np.ones((len(m), 1), bool), m[:, 1:] != m[:, :1]], axis=1)
        new = first(of_a)[:, :, None] & first(of_b)[:, None, :]
        probes.append(base | grid[new])
        rows.append(np.nonzero(new)[0])
    for kind, s in enumerate(seg, 3):
        index.append(np.int64(kind) << 24 | s)
        probes.append(index[-1])
        rows.append(np.arange(len(s)))
    return np.stack(index, axis=1), np.concatenate(probes), np.concatenate(rows)


def _emit(which: str):
    near = {"index": (False, False), "first": (True, False), "second": (False, True)}[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, part = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                f, p = fps[at : at + 4096], part[at : at + 4096]
                _, keys, rows = keys_of(f, near)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[rows]), pa.array(p[rows])], names=["key", "fp", "part"])

    return run


def _near(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def hub_links(fps: DataFrame, total: int) -> DataFrame:
    """(fp, hub) wherever a fingerprint is within MAX_BITS of the smallest that has one of its ``total`` x 6 index keys, itself excepted."""
    index = cut(fps.select("fp", F.col("fp").alias("part")).mapInArrow(_emit("index"), SCHEMA).select("key", "fp"), "near-index")
    hubs = cut(index.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("m")).filter("m > 1"), "near-hubs")
    return join_groups(index, hubs, ["key"], "m", 6 * total).filter((F.col("fp") != F.col("hub")) & _near("fp", "hub")).select("fp", "hub").distinct()


def probe_links(parts: DataFrame) -> DataFrame:
    """(fp, part, fp2, part2) of fingerprints fp < fp2 of different parts within MAX_BITS: they meet in a key, some pairs more than once."""
    left = parts.mapInArrow(_emit("first"), SCHEMA)
    right = parts.mapInArrow(_emit("second"), SCHEMA).toDF("key", "fp2", "part2")
    on = (left["key"] == right["key"]) & (left["fp"] < right["fp2"]) & (left["part"] != right["part2"]) & _near("fp", "fp2")
    return left.join(right, on).select("fp", "part", "fp2", "part2")


def link_fingerprints(fps: DataFrame, total: int) -> DataFrame:
    """(fp, part) for the ``total`` distinct fingerprints ``fps.fp``: part is the smallest fingerprint reachable by links.

    Members of a key meet its smallest first, then, by the probes, only those of other
    parts. Keys have 21 to 24 bits, so at N fingerprints some N^2 / 2^22 pairs are
    tested by the join's condition; none of them is a row before it has passed.
    """
    first = connected_components(hub_links(fps, total), "fp", "hub")
    parts = cut(fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part")), "near-parts")
    more = connected_components(probe_links(parts).select("part", "part2").distinct(), "part", "part2")
    return relabel(parts, more.withColumnRenamed("node", "part"), "part", "component", total)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), component_size for every row."""
    schema = f"doc_id {docs.select(doc_id).schema[0].dataType.simpleString()}, fp long"
    rows = cut(docs.select(doc_id, text).mapInArrow(_fingerprints, schema), "near-rows")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n")), "near-fps")
    linked = cut(link_fingerprints(fps, fps.count()), "near-linked").join(fps, "fp")
    ids = linked.groupBy("part").agg(F.min("low_id").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("fps"))
    groups = join_groups(linked.select("fp", "part", "n"), cut(ids, "near-ids"), ["part"], "fps", fps.count())
    groups = cut(groups.select("fp", "n", "component_id", "component_size"), "near-groups")
    total = fps.agg(F.sum("n")).first()[0] or 0
    out = join_groups(rows, groups, ["fp"], "n", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
