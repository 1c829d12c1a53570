"""Language identification by cross-parsing entropy.

Each language's sample becomes a suffix automaton, in which walking from the root
spells out exactly the sample's substrings. A text is parsed against it from left
to right into the longest pieces that occur in the sample; the more alien the
text, the more pieces. Pieces times log2(sample length), divided by the text's
length, estimates the bits a character costs in that language; the lowest wins,
and ties go to the language whose name sorts first.

Texts are lower-cased character by character; each run of non-letters is one
space. Every letter of the samples is a symbol; a letter of a text that no sample
has is a piece of its own. Texts are parsed whole. So that a very long text is many
lanes of one array rather than a long loop, it is parsed in blocks of BLOCK
characters, and then the piece that a block's end has cut is carried on into the
next block until both parses begin a piece at the same character, after which they
are the same: the count is that of one parse from the text's beginning. All lanes of
a batch advance together, one character a step; a batch has at most BATCH_CHARS
characters and one text more.

The sample is bounded: per language, SAMPLE_DOCS documents, chosen by a hash of
the id, shorter ones than LONG_DOC characters first, whole until SAMPLE_CHARS are
there; of a longer one LONG_DOC characters are taken. The bound is there for the
automata, whose transitions are packed into one row-displaced array of some 1 MB a
language; the driver builds them and every task holds them. All languages found are
learned; predictions cover all rows.

Nulls: a null text, or one without a letter, is `und` with score 0. A row without
lang, text or id isn't learned from. With no rows to learn from all are `und`.
Other columns are ignored; repeated rows each get a row. Languages of equal cost:
the name that sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import fold, slices

SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
LONG_DOC = 3_000
BLOCK = 2048
BATCH_CHARS = 1 << 21
UNKNOWN = "und"


@lru_cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower-case letter, or 0 if it isn't a letter."""
    lower = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, lower != 0


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, each run of others as one 0, none at the ends."""
    lower, _ = _unicode()
    x = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    x = x[keep]
    return x[:-1] if len(x) and x[-1] == 0 else x


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, a dictionary a state; the first state is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): state s goes on with symbol c to target[base[s] + c] where owner[base[s] + c] is s."""
    base = np.zeros(len(rows) + 1, np.int32)  # one state more, which has no transitions
    size = 2 * (sum(map(len, rows)) + 2 * width)
    taken, owner, target = np.arange(size) < width, np.full(size, -1, np.int32), np.zeros(size, np.int32)
    forks = sorted((s for s in range(len(rows)) if len(rows[s]) > 1), key=lambda s: -len(rows[s]))
    start = width
    for s in forks:  # first fit, from where the last fork of many free places was found
        at = np.array(sorted(rows[s]), np.int64)
        low = start
        while True:
            while low + 512 + width > len(taken):
                taken, owner, target = (np.append(x, np.full(len(x), f, x.dtype)) for x, f in ((taken, False), (owner, -1), (target, 0)))
            first = np.nonzero(~taken[low : low + 512])[0] + low
            fits = first[~taken[first[:, None] + (at - at[0])].any(axis=1)]
            if len(fits):
                break
            low += 512
        base[s] = fits[0] - at[0]
        place = base[s] + at
        taken[place], owner[place], target[place] = True, s, [rows[s][c] for c in at.tolist()]
        if len(first) < 64:
            start = low + 512
    # a state with one transition fits any place that is left
    lone = [s for s in range(len(rows)) if len(rows[s]) == 1]
    free = np.nonzero(~taken)[0][: len(lone)]
    if lone:
        c, goal = np.array([next(iter(rows[s].items())) for s in lone], np.int64).T
        base[lone], owner[free], target[free] = free - c, lone, goal
    end = max(int(base.max()), int(np.nonzero(owner >= 0)[0].max(initial=0))) + width
    pad = max(0, end - len(owner))
    owner, target = np.append(owner, np.full(pad, -1, np.int32))[:end], np.append(target, np.zeros(pad, np.int32))[:end]
    return tuple(x.astype(np.int64) for x in (base, owner, target))  # as wide as an index, so that none is converted in the loop


class Model:
    """Parsing tables of several languages, from {language: sample texts}."""

    def __init__(self, samples: dict[str, list[str]]):
        parts = {lang: np.concatenate([np.append(letters(t), 0) for t in texts]) for lang, texts in sorted(samples.items())}
        self.langs = [lang for lang, x in parts.items() if x.any()]
        #: The letters of all samples, in order; symbol 0 is a space and the last one any other letter.
        self.known = np.unique(np.concatenate([np.zeros(1, np.int32), *(parts[k] for k in self.langs)]))
        self.width = len(self.known) + 1
        self.tables, self.bits = [], []
        for lang in self.langs:
            rows = automaton(np.searchsorted(self.known, parts[lang]))
            self.tables.append((*displaced(rows, self.width), np.array([rows[0].get(c, len(rows)) for c in range(self.width)], np.int64)))
            self.bits.append(math.log2(len(parts[lang]) + 1))

    def symbols(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        return np.where(self.known[at] == x, at, len(self.known)).astype(np.int32)

    @staticmethod
    def step(table: tuple, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, where a piece begins with this character)."""
        base, owner, target, again = table
        at = base.take(state)
        at += c
        begins = owner.take(at) != state
        return np.where(begins, again.take(c), target.take(at)), begins

    def pieces(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of pieces per text and language."""
        out = np.zeros((len(texts), len(self.langs)))
        starts = [(i, at) for i, x in enumerate(texts) for at in range(0, len(x), BLOCK)]
        if not starts or not self.langs:
            return out
        size = np.array([min(BLOCK, len(texts[i]) - at) for i, at in starts])
        order = np.argsort(-size, kind="stable")
        lane_of = np.argsort(order)
        size = size[order]
        grid = np.zeros((len(starts), int(size[0])), np.int32)
        for lane, k in enumerate(order.tolist()):
            i, at = starts[k]
            grid[lane, : size[lane]] = texts[i][at : at + BLOCK]
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-size, -np.arange(len(grid)), side="left")
        owner = np.array([starts[k][0] for k in order.tolist()])  # text of each lane
        follows = np.array([k for k in range(1, len(starts)) if starts[k][0] == starts[k - 1][0]], np.int64)
        for n, table in enumerate(self.tables):
            none = len(table[0]) - 1  # the state without transitions, in which each text begins
            state, begun = np.full(len(starts), none, np.int64), np.zeros(grid.shape, bool)
            for row, flags, m in zip(grid, begun, active.tolist(), strict=True):
                state[:m], flags[:m] = self.step(table, state[:m], row[:m])
            counts = np.bincount(owner, begun.sum(axis=0), len(texts))
            more, open_ = self.carry(table, grid, begun, state[lane_of[follows - 1]], size, lane_of[follows])
            counts += np.bincount(owner[lane_of[follows]], more, len(texts))
            for i in {starts[k][0] for k in follows[open_].tolist() if k + 1 < len(starts) and starts[k + 1][0] == starts[k][0]}:
                counts[i] = self.walk(table, texts[i])
            out[:, n] = counts
        return out

    def carry(self, table: tuple, grid: np.ndarray, begun: np.ndarray, state: np.ndarray, size: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each lane that goes on a text in ``state``: pieces to add to its own count, and whether the two parses never met in it."""
        more, left, never = np.zeros(len(lane), np.int64), np.arange(len(lane)), np.zeros(len(lane), bool)
        for step in range(len(grid)):
            never[left[size[lane[left]] <= step]] = True
            left = left[size[lane[left]] > step]
            if not len(left):
                break
            here = lane[left]
            state[left], flags = self.step(table, state[left], grid[step, here])
            mine = begun[step, here]
            more[left] += flags.astype(np.int64) - mine
            left = left[~(flags & mine)]
        never[left] = True
        return more, never

    @staticmethod
    def walk(table: tuple, text: np.ndarray) -> int:
        """Pieces of a text parsed from its beginning, a character at a time: for texts so regular that two parses never meet."""
        base, owner, target, again = (memoryview(x) for x in table)
        state, count = len(base) - 1, 0
        for c in text.tolist():
            at = base[state] + c
            if owner[at] == state:
                state = target[at]
            else:
                state = again[c]
                count += 1
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the score is 1 - best / second best rate."""
        found = [self.symbols(letters(t)) if t else np.zeros(0, np.int32) for t in texts]
        rate = self.pieces(found) * np.array(self.bits)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = rate.argmin(axis=1)
        two = np.sort(rate, axis=1)[:, :2]
        score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        none = np.array([len(x) == 0 for x in found], bool)
        return [UNKNOWN if e else self.langs[k] for e, k in zip(none, best, strict=True)], np.where(none, 0.0, score)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 3, held: int = 1) -> Model:
    """The model of a bounded sample of the rows whose crc32(id) mod ``parts`` isn't ``held``."""
    rows = docs.filter((fold(F.col(doc_id), parts) != held) & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    mark = F.xxhash64(F.col(doc_id).cast("string"))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), mark.alias("mark"), (F.char_length(text) > LONG_DOC).alias("long"))
    picks = rows.groupBy("lang", F.pmod("mark", F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min(F.struct("long", "mark")).alias("x"))
    # SAMPLE_DOCS a language at most; as Arrow, since a list of rows would start a second set of Python workers in the executors
    few = docs.sparkSession.createDataFrame(picks.select("lang", "x.mark", "x.long").toArrow())
    found = rows.join(F.broadcast(few), ["lang", "mark", "long"]).select("lang", "long", "mark", F.substring("text", 1, LONG_DOC).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(found.groupBy("lang", "long", "mark").agg(F.min("text").alias("text")).collect()):
        if sum(map(len, out.setdefault(r["lang"], []))) < SAMPLE_CHARS:
            out[r["lang"]].append(r["text"])
    return Model(out)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1), BATCH_CHARS):
                part = b.slice(at, n)
                lang, score = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which a language was found, with all their columns."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in slices(b.column(at), BATCH_CHARS):
                part = b.slice(first, n)
                lang, _ = shared.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from two thirds of the ids, predicted for every row."""
    out = identify(docs, learn(docs, doc_id, text, lang), doc_id, text)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
