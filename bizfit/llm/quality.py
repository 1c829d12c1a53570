"""Quality rules by weak supervision: rules vote, and how far each is to be trusted is estimated.

Every rule looks at one count of a text and votes "good", "bad" or not at all. A text's
quality is a hidden class. Given it the votes are taken as independent; of every rule
there are two accuracies, how often it votes "bad" on bad texts and on good ones,
of the times that it votes. Expectation-maximisation finds them and the share
of bad texts from the votes alone, without labels: it starts from the majority of the
votes, and an accuracy counts PRIOR votes more in the rule's favour, so that a rule is
never held to say the opposite of what it means, and no rule is held to err less often
than DOUBT, so that one vote rarely decides. A text stays if its posterior
probability of being good is a half or more, and none of the contract's base rules fails.

Distribution. Texts are counted where they are read, whole, and only their vote pattern
is kept. Patterns are counted over all texts; there are at most 3^14 of them, and only
their counts are seen by the driver, which fits the accuracies. What a vote then adds to
the log odds is a constant, so the verdicts are plain column expressions.

Awkward rows. A null text has no words, so no rule votes, its posterior is the share of
good texts, and it fails the base rules. Null and repeated ids are carried along. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.operators.shared import cut

WINDOW = 8
#: Rounds of EM, votes counted in a rule's favour beforehand, and how often any rule errs at least, so that one vote alone rarely decides.
ROUNDS, PRIOR, DOUBT = 25, 2.0, 0.005
LETTER, PLAIN = re.compile(rb"[A-Za-z\x80-\xff]"), re.compile(rb"[0-9A-Za-z\x80-\xff]+[.,;:!?]?")
SPACES, SYMBOLS, STOPS, MARKS = (np.frombuffer(x, np.uint8) for x in (b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".?!", string.punctuation.encode()))
#: Of each rule, when it votes "bad", and when "good" if it doesn't; SQL over the columns of counts(), which Spark and DuckDB read alike.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "n_words >= 5 AND 50 * n_symbols <= n_words"),
    "capitals": ("n_upper + n_lower >= 20 AND n_upper > n_lower", "n_upper + n_lower >= 20 AND 5 * n_upper <= n_lower"),
    "exclamations": ("10 * n_exclamations > n_words", "n_words >= 5 AND 50 * n_exclamations <= n_words"),
    "marks": ("6 * n_marks > word_chars", "word_chars >= 20 AND 12 * n_marks <= word_chars"),
    "decorations": ("4 * n_decorated > n_words", "n_words >= 5 AND 10 * n_decorated <= n_words"),
    "windows": ("2 * n_repeat_words > n_words", "n_words >= 50 AND n_repeat_words = 0"),
    "repeats": ("n_words >= 10 AND 5 * n_repeats > n_words", "n_words >= 10 AND 50 * n_repeats <= n_words"),
    "triples": ("n_words >= 10 AND 10 * n_triples > n_words", "n_words >= 10 AND n_triples = 0"),
    "commonest": ("n_words >= 30 AND 4 * n_commonest > n_words", "n_words >= 30 AND 7 * n_commonest <= n_words"),
    "lines": ("n_lines >= 3 AND 3 * n_dup_lines > n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    "sentences": ("n_words >= 50 AND 100 * n_stops < n_words", "n_words >= 50 AND 50 * n_stops >= n_words AND 3 * n_stops <= n_words"),
    "letterless": ("5 * n_letterless > n_words", "n_words >= 5 AND 20 * n_letterless <= n_words"),
    "lengths": ("word_chars > 20 * n_words OR word_chars < 2 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_words >= 5"),
    "digits": ("5 * n_digits > word_chars", "word_chars >= 20 AND 20 * n_digits <= word_chars"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_upper", "n_lower", "n_exclamations", "n_repeats", "n_commonest", "n_lines", "n_stops", "n_letterless", "n_digits", "n_marks", "n_decorated", "n_triples")


def pattern() -> str:
    """SQL of a text's votes: a character a rule, g, b or -."""
    return " || ".join(f"CASE WHEN n_words = 0 THEN '-' WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE '-' END" for bad, good in RULES.values())


def repeated_words(ids: np.ndarray) -> int:
    """Words in a window of WINDOW that occurs twice or more. Windows get exact names by pairing the names of their halves."""
    size, names = 1, ids
    while size < WINDOW:
        if len(names) <= size:
            return 0
        names = np.unique(names[:-size] * (len(ids) + 1) + names[size:], return_inverse=True)[1]
        size *= 2
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def count(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = text.split()
    if not words:
        return (0,) * len(COUNTS)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    times, same = np.bincount(ids), ids[1:] == ids[:-1]
    letterless, decorated = (np.array([not f(w) for w in known]) for f in (LETTER.search, PLAIN.fullmatch))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), int(bytes_[:128].sum() + bytes_[192:].sum() - bytes_[SPACES].sum()), int(bytes_[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(ids),
        int(bytes_[65:91].sum()), int(bytes_[97:123].sum()), int(bytes_[33]), int(same.sum()), int(times.max()), len(lines), int(bytes_[STOPS].sum()),
        int(times[letterless].sum()), int(bytes_[48:58].sum()), int(bytes_[MARKS].sum()), int(times[decorated].sum()), int((same[1:] & same[:-1]).sum()),
    )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            found = [count(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}")


def fit(votes: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray]:
    """Log odds of a good text without votes, and what a vote adds to them, by rule: if bad, if good. By expectation-maximisation.

    ``votes`` has a row a pattern, 1 for bad, -1 for good, 0 for none, ``times`` the texts with it.
    """
    bad, fine = votes > 0, votes < 0
    good = 1 - bad.any(1) * 0.5 - (bad.sum(1) > fine.sum(1)) * 0.4
    for _ in range(ROUNDS):
        weights = (times * (1 - good), PRIOR), (times * good, 0)  # of bad texts, then of good ones
        shares = np.array([(w @ bad + favoured) / (w @ (bad | fine) + PRIOR) for w, favoured in weights])
        shares = np.clip(shares, DOUBT, 1 - DOUBT)
        shares[0] = np.maximum(*shares)
        prior = np.clip((times @ good + PRIOR) / (times.sum() + 2 * PRIOR), DOUBT, 1 - DOUBT)
        base, adds = np.log(prior / (1 - prior)), np.log([shares[1] / shares[0], (1 - shares[1]) / (1 - shares[0])])
        good = 1 / (1 + np.exp(-(base + bad @ adds[0] + fine @ adds[1])))
    return float(base), adds


def filter_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior (four digits) and votes of every row."""
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    rows = cut(counts(docs).select("doc_id", *BASE, F.expr(failed).alias("base_failed"), F.expr(pattern()).alias("votes")), "quality-votes")
    seen = rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toArrow()
    votes = np.frombuffer("".join(seen["votes"].to_pylist()).encode(), np.uint8).reshape(-1, len(RULES))
    base, adds = fit((votes == ord("b")).astype(np.int8) - (votes == ord("g")), seen["n"].to_numpy().astype(float))
    odds = F.lit(base)
    for k, (bad, good) in enumerate(adds.T.tolist()):
        vote = F.substring("votes", k + 1, 1)
        odds = odds + F.when(vote == "b", bad).when(vote == "g", good).otherwise(0.0)
    posterior = F.round(1 / (1 + F.exp(-F.col("odds"))), 4).alias("posterior")
    return rows.withColumn("odds", odds).select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("odds") >= 0)).alias("kept"), posterior, "votes")
