"""Benchmark decontamination by spaced-seed hashing.

A mask selects SEEDS' positions of a token window and ignores the others, so a
substituted token at an ignored position doesn't hide a match. All windows of all
benchmark items are hashed under each mask, and so are all windows of each
document; equal hashes give a diagonal (item, offset). Around each diagonal the
whole overlap of item and document is compared token by token, and the stretch
with the best sum of +1 for an equal and -2 for a different token is taken. It
counts as a leak if it has at least MIN_TOKENS tokens, or the whole item, of
which at least MIN_SHARE are equal.

An item of under PARTED tokens is found whatever is substituted: with a share of
MIN_SHARE equal, at least one of its parts, one more than there may be substitutions,
is intact, so each part is a seed as well. One that is too short to spare a token is
found word for word. Tokens are runs of letters, digits and non-ASCII bytes, with A-Z
lower-cased; an item without a token matches nothing.

The join of hashes is a hash table that each task holds, as in a broadcast join: the
benchmark is a stated query set that is compared with all documents, and a shuffle of
every window of every document would move some ten times the corpus. Its size is
checked: it is taken in blocks of BLOCK_CHARS characters, one at a time, and each
further block is another pass over the documents. Documents are never shuffled.

Nulls: null texts are empty and match nothing; null ids, of documents and items, are
carried through. Rows that repeat give repeated results; items that repeat are each
found. Of stretches with equally many equal tokens the first diagonal's is returned.
Empty tables give empty results. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import slices
from bizfit.operators.shared import cut

SEEDS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 6, 8, 9), (0, 1, 4, 6, 9, 10), (0, 3, 5, 6, 10, 11))
PARTED = 16
MIN_TOKENS = 13
MIN_SHARE = 0.8
PENALTY = 2
BLOCK_CHARS = 4_000_000
STEP = 1 << 17

_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_OTHER + string.ascii_uppercase.encode(), b" " * len(_OTHER) + string.ascii_lowercase.encode())
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def tokens(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_PLAIN).split()


def seed_hashes(ids: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Hash of each window of ``ids`` under a mask; 0 where a selected token is unknown (id 0)."""
    n = len(ids) - seed[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for at, f in zip(seed, _FACTORS, strict=False):
        part = ids[at : at + n]
        known &= part != 0
        h += part * f
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def parts_of(n: int) -> list[tuple[int, int]]:
    """(offset, tokens) of the parts of a short item, one of which is intact in any copy that counts."""
    many = int(n * (1 - MIN_SHARE) + 1e-9) + 1
    cuts = [n * k // many for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Bench:
    """Hash tables of a block of the benchmark: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = 1):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        found: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            words = tokens(text)
            if len(words) < max(1, least):
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            seeds = [(seed, np.arange(max(0, len(ids) - seed[-1]))) for seed in SEEDS]
            if len(ids) < PARTED:
                seeds += [(tuple(range(n)), np.array([at])) for at, n in parts_of(len(ids))]
            for seed, at in seeds:
                if len(at):
                    place = np.stack([np.full(len(at), len(self.item_ids)), at], axis=1).astype(np.int32)
                    found.setdefault(seed, []).append((seed_hashes(ids, seed)[at], place))
            self.item_ids.append(item_id)
            self.tokens.append(ids)
        self.tables = []
        for seed, parts in sorted(found.items()):
            h, p = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(h, kind="stable")
            self.tables.append((seed, h[order], p[order]))

    def leaks(self, text: str | bytes | None) -> list[tuple[int, int, int, int]]:
        """(item_id, first token in the text, tokens, equal tokens) of each leak in a text: the best of each item."""
        if not self.tables:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in sorted(self.diagonals(ids)):
            found = overlap(self.tokens[item], ids, diagonal)
            if found and (item not in best or found[2] > best[item][2]):
                best[item] = found
        return [(self.item_ids[k], *v) for k, v in sorted(best.items())]

    def diagonals(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item in the text) wherever a seed matches."""
        near: set[tuple[int, int]] = set()
        for seed, table, places in self.tables:
            for start in range(0, len(ids), STEP):
                h = seed_hashes(ids[start : start + STEP + seed[-1]], seed)
                at = np.nonzero(h)[0]
                low, high = (np.searchsorted(table, h[at], side) for side in ("left", "right"))
                for k in np.nonzero(low < high)[0].tolist():
                    for item, offset in places[low[k] : high[k]].tolist():
                        near.add((item, start + int(at[k]) - offset))
        return near


def overlap(item: np.ndarray, ids: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first token in the text, tokens, equal tokens) of the best stretch on a diagonal, if it is a leak."""
    low, high = max(0, -diagonal), min(len(item), len(ids) - diagonal)
    same = item[low:high] == ids[low + diagonal : high + diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    begin = int(np.argmin(total[: end + 1]))
    n, equal = end - begin, int(same[begin:end].sum())
    if n >= min(MIN_TOKENS, len(item)) and equal >= MIN_SHARE * n:
        return low + begin + diagonal, n, equal
    if high - low == len(item) and same.sum() >= MIN_SHARE * len(item):
        return low + diagonal, len(item), int(same.sum())
    return None


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", least: int = 1) -> Iterator[Bench]:
    """The benchmark in blocks of about BLOCK_CHARS characters, each fetched when it is asked for; rows without text are left out."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(4096))
    sums = rows.groupBy(slot.alias("slot")).agg(F.sum(F.length("text")).alias("n")).orderBy("slot").collect()
    group, size, slots = 0, 0, {}
    for r in sums:
        if size and size + r["n"] > BLOCK_CHARS:
            group, size = group + 1, 0
        size += r["n"]
        slots.setdefault(group, []).append(r["slot"])
    for part in slots.values():
        keep = slot.isin(part) if len(slots) > 1 else F.lit(True)
        yield Bench(sorted((tuple(r) for r in rows.filter(keep).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per leaking document and item: doc_id, item_id, first_token, n_tokens, n_equal."""
    spark, kind = docs.sparkSession, docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_token long, n_tokens long, n_equal long"

    def scan(bench: Bench) -> DataFrame:
        shared = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                    for leak in shared.value.leaks(t.as_buffer().to_pybytes()) if t.is_valid else ():
                        rows.append(i)
                        found.append(leak)
                ints = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *ints], names=["doc_id", "item_id", "first_token", "n_tokens", "n_equal"])

        return docs.select(doc_id, text).mapInArrow(run, schema)

    out = None
    for bench in blocks(benchmark):
        # a block that others follow is done with, and its table freed, before the next is fetched
        out = scan(bench) if out is None else cut(out, "leaks").unionByName(scan(bench))
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_tokens: int = 4) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns.

    A document isn't dropped for an item of under ``least_tokens`` tokens, such as
    a yes or a number, which any clean text may hold; find_leaks reports those too.
    """
    at, out = docs.columns.index(text), docs

    def without(rows: DataFrame, bench: Bench) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, n in slices(b.column(at)):  # else both sides hold a second copy of the whole batch
                    part = b.slice(first, n)
                    clean = [not (t.is_valid and shared.value.leaks(t.as_buffer().to_pybytes())) for t in part.column(at).cast(pa.large_binary())]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for k, bench in enumerate(blocks(benchmark, least=least_tokens)):
        out = without(cut(out, "clean") if k else out, bench)
    return out


def leaking_documents(leaks: DataFrame) -> DataFrame:
    """One row per leaking document: its longest overlap, of equals the first item's."""
    first = F.struct(-F.col("n_equal"), "item_id", "first_token")
    return leaks.groupBy("doc_id").agg(F.min_by(F.struct("item_id", "first_token", "n_tokens", "n_equal"), first).alias("x")).select("doc_id", "x.*")
