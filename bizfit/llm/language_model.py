"""Scoring with a class-based log-bilinear model trained by noise-contrastive estimation.

Counts. Words ([^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end a text) of all
training rows are counted, so what is gathered grows with the corpus. The base
score is the smoothed unigram score of these counts.

Model. The HEADS most frequent words are classes of their own; every other word
belongs to one of TAILS classes by the end of its spelling. The log-bilinear model
predicts a word's class from the classes of the two words before it: the
prediction vector is the sum of position-wise transformed context vectors, its
product with the output vectors plus a bias gives each class a score. It is trained
in numpy with noise-contrastive estimation on all class trigram counts of the whole
training part; none is left to a draw. A count is cut into equal pieces of at most
DRAW tokens (fewer where that gives under LEAST pieces of the corpus), a smaller count
is one piece, and a piece's gradient is weighed by its tokens, so that the rounds
together pass each training token exactly once and training grows with the corpus.
Tasks take the counts' parts, train on the round's share of their pieces from the same
parameters, and the parameters are averaged by tokens; ROUNDS rounds. There are as many
tasks as hold LEAST pieces each, up to TASKS, which bounds what the driver averages. Batched matrix products over all
contexts then give exactly normalised log-probabilities.

A known word has probability (1 - u) * P(class | context) * c / class total, where
u is the base's probability of an unknown word; an unknown word has u. These sum
to one over the known words and "unknown" in every context.

Work. A text is tokenised in the tasks. Words among the FREQUENT most frequent,
whose table is of bounded size, are scored there. The other words of a document
are sent out as distinct words with counts and joined with the count table by a
shuffle, and come back as two sums a document.

Nulls: a null text is empty and has one token, the end. Null ids are scored like
others and count as training or held-out by the empty text's crc32. Rows that
repeat are counted and scored each. An empty training part scores with N = V = 0.
Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import fold
from bizfit.operators.shared import cut

HEADS = 96
TAILS = 96
FREQUENT = 40_000
DIM = 32
NOISE = 8
BATCH = 4096
DRAW = 16
LEAST = 2_457_600
ROUNDS = 6
TASKS = 64
RATE = 0.3
FLUSH = 400_000
END = b""  # no word is empty


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def tail_class(word: bytes) -> int:
    """Class of a word that is not among the HEADS, from its last three letters' bytes."""
    n = 0
    for b in word.rstrip(b".,;:!?")[-3:]:
        n = (n * 131 + b) % 1_000_003
    return n % TAILS


def _bodies(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for b in batches:
        for raw in _bodies(b.column(0)):
            counts.update(words_of(raw))
            counts[END] += 1
            if len(counts) > FLUSH:
                yield flush(counts)
                counts.clear()
    if counts:
        yield flush(counts)


class Vocabulary:
    """The frequent words: number, class, and what else is the same in every task."""

    def __init__(self, top: tuple[tuple[bytes, int], ...]):
        heads = [w for w, _ in top if w != END][: HEADS - 1]
        own = {w: k + 1 for k, w in enumerate(heads)} | {END: 0}
        self.number = {w: k for k, (w, _) in enumerate(top)}
        self.count = np.array([c for _, c in top] or [0], np.float64)
        self.cls = np.array([own.get(w, -1) if w in own else HEADS + tail_class(w) for w, _ in top] or [0], np.int64)
        self.end = self.number.get(END, -1)

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, class) of each word."""
        get = self.number.get
        number = np.array([get(w, -1) for w in words], np.int64)
        cls = self.cls[number]
        rare = np.nonzero(number < 0)[0]
        cls[rare] = [HEADS + tail_class(words[k]) for k in rare.tolist()]
        return number, cls


@lru_cache(maxsize=2)
def _vocabulary(top: tuple[tuple[bytes, int], ...]) -> Vocabulary:
    return Vocabulary(top)


def trigrams(cls: np.ndarray) -> np.ndarray:
    """(context, class) codes of a text's classes and its end: each with the two before, ends in front."""
    k, x = HEADS + TAILS, np.concatenate([[0, 0], cls, [0]])
    return (x[:-2] * k + x[1:-1]) * k + x[2:]


class Parameters:
    """Context vectors after each position's transform, output vectors, biases, and the sums of squared gradients of each."""

    def __init__(self, values: list[np.ndarray], sums: list[np.ndarray]):
        self.values, self.sums = values, sums

    @staticmethod
    def fresh(noise: np.ndarray, seed: int = 7) -> Parameters:
        rng, k = np.random.default_rng(seed), len(noise)
        values = [rng.normal(0, 0.1, (k, DIM)), rng.normal(0, 0.1, (k, DIM)), rng.normal(0, 0.1, (k, DIM)), np.log(noise)]
        return Parameters(values, [np.full(x.shape, 1e-6) for x in values])

    def step(self, which: int, at: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad on the rows ``at``."""
        x, s = self.values[which], self.sums[which]
        total = np.zeros_like(x)
        if x.ndim == 1:
            total += np.bincount(at, grad, len(x))
        else:
            order = np.argsort(at, kind="stable")
            rows, starts = np.unique(at[order], return_index=True)
            total[rows] = np.add.reduceat(grad[order], starts)
        total /= BATCH
        s += total * total
        x += RATE * total / np.sqrt(s)

    def batch(self, gram: np.ndarray, weight: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on trigram codes with weights."""
        k = len(noise)
        left, right, q, bias = self.values
        a, b = gram // (k * k), gram // k % k
        other = samples(np.arange(k), noise, len(gram) * NOISE, rng).reshape(-1, NOISE)
        w = np.concatenate([(gram % k)[:, None], other], axis=1)
        h = left[a] + right[b]
        out = q[w]
        score = np.einsum("nd,nkd->nk", h, out) + bias[w]
        g = -1 / (1 + np.exp(-(score - np.log(NOISE * noise)[w])))  # label - P(data)
        g[:, 0] += 1
        g *= weight[:, None]
        dh = np.einsum("nk,nkd->nd", g, out)
        self.step(2, w.reshape(-1), (g[:, :, None] * h[:, None, :]).reshape(-1, DIM))
        self.step(3, w.reshape(-1), g.reshape(-1))
        self.step(0, a, dh)
        self.step(1, b, dh)

    @staticmethod
    def average(parts: list[tuple[float, Parameters]]) -> Parameters:
        total = sum(n for n, _ in parts)
        mean = lambda xs: [sum(n / total * x for (n, _), x in zip(parts, same, strict=True)) for same in zip(*xs, strict=True)]
        return Parameters(mean([p.values for _, p in parts]), mean([p.sums for _, p in parts]))


def samples(codes: np.ndarray, counts: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """``draws`` codes in random order, evenly spaced over the summed counts from a random start."""
    cum = np.cumsum(counts, dtype=np.float64)
    at = (np.arange(draws) + rng.random()) * (cum[-1] / draws)
    return rng.permutation(codes[np.minimum(np.searchsorted(cum, at, side="right"), len(codes) - 1)])


def pieces(codes: np.ndarray, counts: np.ndarray, unit: float, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the code, weight) of each piece that round ``number`` passes; over all ROUNDS rounds a code's weights sum to its count / unit."""
    times = np.ceil(counts / unit).astype(np.int64)
    first = (codes.astype(np.int64) * 2_654_435_761 >> 16) % ROUNDS
    here = times // ROUNDS + ((number - first) % ROUNDS < times % ROUNDS)
    at = np.repeat(np.arange(len(codes), dtype=np.int32), here)
    return at, (counts / (times * unit)).astype(np.float32)[at]


def train(grams: DataFrame, total: int, draw: int | None = None) -> np.ndarray:
    """log10 P(class | two classes before) as an array of contexts x classes, from a written table of trigram counts (code, n) of ``total`` tokens."""
    k, spark = HEADS + TAILS, grams.sparkSession
    unigram = np.full(k, 0.1)
    for r in grams.groupBy((F.col("code") % k).alias("cls")).agg(F.sum("n").alias("n")).collect():  # a row a class
        unigram[r["cls"]] += r["n"]
    noise = unigram / unigram.sum()
    draws = max(LEAST, total // (draw or DRAW))
    tasks = max(1, min(TASKS, draws // LEAST))
    now = Parameters.fresh(noise)
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], number=number, shared=shared) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if parts:
                codes, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                parts.clear()
                order = np.argsort(codes).astype(np.int32)  # the same whatever the order of the rows
                codes, counts = codes[order], counts[order]
                mine, rng = pickle.loads(pickle.dumps(shared.value)), np.random.default_rng([number, int(codes[0])])
                at, weight = pieces(codes, counts, total / draws, number)
                turn = rng.permutation(len(at)).astype(np.int32)
                for low in range(0, len(at), BATCH):
                    here = turn[low : low + BATCH]
                    mine.batch(codes[at[here]].astype(np.int64), weight[here], noise, rng)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([float(weight.sum(dtype=np.float64))]), pa.array([pickle.dumps(mine)], pa.binary())], names=["share", "parameters"])

        learned = grams.coalesce(tasks).mapInArrow(learn, "share double, parameters binary").collect()  # TASKS rows at most
        now = now if not learned else Parameters.average(sorted(((r["share"], pickle.loads(r["parameters"])) for r in learned), key=lambda x: (x[0], float(x[1].values[3][0]))))
        shared.unpersist()
    return normalised(np.stack(now.values[:2]), now.values[2], now.values[3])


def normalised(r: np.ndarray, q: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Batched products over all contexts, then a log-softmax, in units of log10."""
    k = len(bias)
    out = np.empty((k * k, k), np.float32)
    for a in range(k):  # a batch: one class followed by any
        s = (r[0][a] + r[1]) @ q.T + bias
        s -= s.max(axis=1, keepdims=True)
        out[a * k : (a + 1) * k] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / math.log(10)
    return out


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    k = HEADS + TAILS
    train_docs = docs.filter(fold(F.col(doc_id), parts) != held).select(F.col(text).alias("text"))
    vocabulary = cut(train_docs.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    total, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = tuple((bytes(r["word"]), r["c"]) for r in vocabulary.orderBy(F.desc("c"), "word").limit(FREQUENT).collect())  # FREQUENT rows at most
    shared = spark.sparkContext.broadcast(top)

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        waiting, held, seen, times = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settle() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.unique(np.concatenate([seen, *waiting]), return_inverse=True)
            weights = np.concatenate([times, np.ones(held, np.int64)])
            return codes, np.bincount(n, weights, len(codes)).astype(np.int64)

        for b in batches:
            for raw in _bodies(b.column(0)):
                waiting.append(trigrams(v.classes(words_of(raw))[1]))
                held += len(waiting[-1])
                if held > 500_000:
                    seen, times = settle()
                    waiting, held = [], 0
        seen, times = settle()
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["code", "n"])

    def class_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        tokens = np.zeros(k)
        for b in batches:
            words = [x.as_py() for x in b.column(0)]
            cls = np.array([v.cls[v.number[w]] if w in v.number else HEADS + tail_class(w) for w in words], np.int64)
            tokens += np.bincount(cls, b.column(1).to_numpy(zero_copy_only=False), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(tokens.astype(np.int64))], names=["cls", "n"])

    grams = train_docs.mapInArrow(count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).select(F.col("code").cast("int"), "n")
    table = train(cut(grams, "lm-grams"), total) if total else np.full((k * k, k), -math.log10(k), np.float32)
    totals = np.zeros(k)
    for r in vocabulary.mapInArrow(class_totals, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        totals[r["cls"]] = r["n"]
    model = spark.sparkContext.broadcast((table, totals))

    room = total + 0.5 * (types + 1)
    unknown = math.log10(0.5 / room)
    known_mass = math.log10(max(1e-300, 1 - 0.5 / room))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        table, totals = model.value
        flat = table.reshape(-1)
        log_total = np.log10(np.maximum(totals, 1))
        in_base = np.append(np.log10((v.count + 0.5) / room), 0.0)
        in_class = np.append(np.log10(np.maximum(v.count, 1)) - log_total[v.cls] + known_mass, 0.0)
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            n_tokens, n_known, base, score, rare_words, rare_n, rare_lm = [], [], [], [], [], [], []
            for raw in _bodies(b.column(1)):
                words = words_of(raw)
                number, cls = v.classes(words)
                number = np.append(number, v.end)
                lm = flat[trigrams(cls)].astype(np.float64)
                inside = number >= 0
                n_tokens.append(len(number))
                n_known.append(int(inside.sum()))
                base.append(float(in_base[number].sum()) + (unknown if v.end < 0 else 0.0))
                score.append(float(lm[inside].sum() + in_class[number].sum()) + (unknown if v.end < 0 else 0.0))
                seen: dict[bytes, list] = {}
                for at in np.nonzero(~inside[: len(words)])[0].tolist():
                    x = seen.setdefault(words[at], [0, 0.0, int(cls[at])])
                    x[0] += 1
                    x[1] += lm[at] - log_total[cls[at]] + known_mass
                rare_words.append(list(seen))
                rare_n.append([x[0] for x in seen.values()])
                rare_lm.append([x[1] for x in seen.values()])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64())), pa.array(rare_lm, pa.list_(pa.float64())),
            ], names=["doc_id", "n_tokens", "n_known", "base", "score", "words", "ns", "lms"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, score double, words array<binary>, ns array<long>, lms array<double>"
    rows = cut(docs.select(doc_id, text).mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "ns", "lms")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.ns").alias("n"), F.col("x.lms").alias("lm"))
    found = rare.join(vocabulary, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / room)).alias("more_base"),
        F.sum(F.when(c > 0, F.col("lm") + F.col("n") * F.log10(F.greatest(c, F.lit(1)))).otherwise(F.col("n") * unknown)).alias("more_score"),
    )
    out = rows.drop("words", "ns", "lms").join(sums, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        "doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "n_tokens", add("n_known", "known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), add("score", "more_score"),
    )
