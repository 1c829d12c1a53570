"""Conversation structure repair by Four-Russians block tables.

A conversation should be ``(s?(ua)+)?`` in the initials of its roles. Each row is
kept (free), given the role user or assistant (2) or deleted (3), and empty user or
assistant rows are inserted (2); blank and duplicate rows must be deleted, and a
truncated row that stays costs 1 more. The cheapest edits, the ASCII-least of equals,
are found over the four states of that grammar.

Method. The costs to go from a row on, one for each state, differ by a few units only,
so a cost vector less its smallest entry is one of sixteen. For every such vector
and every block of BLOCK row symbols a table holds the vector before the block and what
the smallest entry grew by. A conversation is walked from its end, one lookup a block.
Then it is traced from its start: a block is expanded backward from the vector at its
right end, and the least letter that keeps the cost is taken at every step, which makes
the edits the ASCII-least, as equal letters lead to equal states. What a block gives
for a vector and a state is kept, so it is expanded once.

Distribution. Rows are sorted by range, so the rows of one conversation may lie in any
number of tasks, and numbered in that order. Duplicates are found by pre-aggregated
minima of those numbers, symbols (a letter a row) gathered in pieces of 65,536 rows,
and the repaired text is hashed as a stream of sorted rows: no group's texts are held.
The hash of a conversation is one chain, so its rows do pass one after the other.

Awkward rows. Rows with null conv_id are one conversation. Rows of one turn are taken by
role, then text. Repeated rows are duplicates. Null role and text are one space, so such
a text is blank and such a role has no initial of the grammar. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizfit.operators.shared import cut

BLOCK = 4
PIECE_BITS = 16
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after one more row of the role that the grammar asks for: the assistant after a user, else the user.
NEXT = (USER, USER, ASSISTANT, USER)
#: A row's letter is its initial's place here (3 for others) times 4, plus 1 if truncated, 2 if blank, 3 if duplicate.
INITIALS = "sua"
TRUNCATED, BLANK, DUPLICATE = 1, 2, 3
LETTERS = "abcdefghijklmnop"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Of each letter, the symbol of its edits: initial and truncation, or 8 where only Delete is allowed.
SYMBOLS = [2 * (k // 4) + k % 4 if k % 4 < BLANK else 8 for k in range(16)]
KINDS = 9
LEGAL = ("su", "ua", "au")


def keeps(state: int, initial: int) -> int | None:
    """State after a kept row, None where the grammar has no such row."""
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial == NEXT[state] - 1 else None


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what can be done with a row, by letter."""
    if symbol == 8:
        return [("D", DELETE, state)]
    stays = symbol & 1
    kept = keeps(state, symbol >> 1)
    return [("D", DELETE, state), *([("K", KEEP + stays, kept)] if kept is not None else []), ("R", REROLE + stays, NEXT[state])]


def closed(costs: list[int]) -> list[int]:
    """Costs to go where rows may be inserted first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, and for one symbol and for a block of BLOCK: the vector before it, and by how much the smallest entry grew). Vector 0 is that of the end."""
    end = tuple(closed([0, 99, 99, 0]))
    known, order, after, grown = {end: 0}, [end], [], []
    for vector in order:  # grows while it is walked
        for symbol in range(KINDS):
            costs = closed([min(c + vector[to] for _, c, to in edits(state, symbol)) for state in range(4)])
            low = min(costs)
            before = tuple(c - low for c in costs)
            if before not in known:
                known[before] = len(order)
                order.append(before)
            after.append(known[before])
            grown.append(low)
    one = np.array(after, np.int16).reshape(-1, KINDS)
    one_grown = np.array(grown, np.int32).reshape(-1, KINDS)
    block, block_grown = one, one_grown
    for _ in range(BLOCK - 1):  # one more symbol on the left
        rest = block[:, None, :].repeat(KINDS, 1)
        first = np.arange(KINDS)[None, :, None]
        block, block_grown = one[rest, first].reshape(len(order), -1), (one_grown[rest, first] + block_grown[:, None, :]).reshape(len(order), -1)
    return np.array(order, np.int32), one, one_grown, block, block_grown


@cache
def expanded(right: int, symbols: tuple[int, ...], state: int) -> tuple[str, int]:
    """(edits, state after) of a few rows, given the vector behind them and the state before them."""
    vectors, one, one_grown, *_ = tables()
    ids, grown = [right], []
    for s in reversed(symbols):
        grown.append(int(one_grown[ids[-1], s]))
        ids.append(int(one[ids[-1], s]))
    ids.reverse()
    grown.reverse()
    out = []
    for k, s in enumerate(symbols):
        here, there = vectors[ids[k]], vectors[ids[k + 1]]
        while True:
            (letter, to) = next(
                (letter, to)
                for letter, left, to in sorted([*((e, c + int(there[to]) - grown[k], to) for e, c, to in edits(state, s)), ("I", INSERT + int(here[NEXT[state]]), NEXT[state])])
                if left == here[state]
            )
            out.append(letter)
            state = to
            if letter != "I":
                break
    return "".join(out), state


def repair(letters: str) -> tuple[int, str]:
    """(cost, audit) of a conversation whose rows have these letters."""
    vectors, one, one_grown, block, block_grown = tables()
    symbols = np.array(SYMBOLS)[np.frombuffer(letters.encode(), np.uint8) - ord("a")]
    whole = len(symbols) // BLOCK
    codes = symbols[: whole * BLOCK].reshape(-1, BLOCK) @ KINDS ** np.arange(BLOCK)[::-1]
    tail = tuple(symbols[whole * BLOCK :].tolist())
    at, total = 0, 0
    for s in reversed(tail):
        total += int(one_grown[at, s])
        at = int(one[at, s])
    bounds = [at]
    for code in codes[::-1].tolist():
        total += int(block_grown[at, code])
        at = int(block[at, code])
        bounds.append(at)
    total += int(vectors[at][START])
    bounds.reverse()
    out, state = [], START
    for k, row in enumerate(symbols[: whole * BLOCK].reshape(-1, BLOCK).tolist()):
        piece, state = expanded(bounds[k + 1], tuple(row), state)
        out.append(piece)
    piece, state = expanded(0, tail, state)
    out.append(piece)
    while state in (SYSTEM, USER):
        out.append("I")
        state = NEXT[state]
    return total, "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the contract's faults by crc32 of ``conv_id:turn``; dropped rows stay as ``gone``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") < 2, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("_time")).drop("_time")


def last_char(text: Column) -> Column:
    """The last character that is no space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def lettered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn, gone, letter) and (conv_id, pos, role, text, gone) of all rows; pos gives a conversation's order, a gone row has no letter."""
    spread = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = cut(spread.withColumn("pos", F.monotonically_increasing_id()).withColumn("last", last_char(F.col("text"))), "repair-rows")
    said = placed.filter("not gone and last <> ''")
    firsts = said.groupBy("conv_id", F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256).alias("said")).agg(F.min("pos").alias("pos"))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    fault = F.when(F.col("last") == "", BLANK).when(~F.col("first"), DUPLICATE).when(~F.col("last").isin(*".!?"), TRUNCATED).otherwise(0)
    place = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1) * 4 + fault
    facts = placed.select("conv_id", "pos", "turn", "role", "gone", "last").withColumn("role", F.substring("role", 1, 1))
    marked = facts.join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return marked.select("conv_id", "pos", "turn", "gone", F.when(F.col("gone"), "").otherwise(F.substring(F.lit(LETTERS), place + 1, F.lit(1))).alias("letter")), placed


def gathered(marked: DataFrame) -> DataFrame:
    """conv_id, letters in order, gaps; one row for every conversation."""
    turn = F.when(~F.col("gone"), F.col("turn"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "")
    pieces = marked.groupBy("conv_id", F.shiftright("pos", PIECE_BITS).alias("piece")).agg(
        F.min("pos").alias("pos"), in_order("letter").alias("letters"), F.min(turn).alias("lo"), F.max(turn).alias("hi"), F.size(F.collect_set(turn)).alias("turns")
    )
    bounds = F.array_sort(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("pos", "lo", "hi", "turns"))))
    whole = pieces.groupBy("conv_id").agg(in_order("letters").alias("letters"), bounds.alias("b"))
    # rows are in order of turn, so a turn in two pieces ends one and begins the next that has turns
    again = F.size(F.filter("b", lambda x, k: x["lo"] == F.get("b", k - 1)["hi"]))
    distinct = F.aggregate("b", F.lit(0), lambda n, x: n + x["turns"]) - again
    gaps = F.when(F.size("b") > 0, F.element_at("b", -1)["hi"] - F.element_at("b", 1)["lo"] + 1 - distinct).otherwise(0)
    return whole.select("conv_id", "letters", gaps.cast("long").alias("gaps"))


def audited(whole: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of gathered conversations."""
    kind = whole.select("conv_id").schema[0].dataType.simpleString()
    initials = dict(zip(LETTERS, (c for c in (*INITIALS, "-") for _ in range(4)), strict=True))
    of = {f: [LETTERS[4 * k + f] for k in range(4)] for f in (BLANK, DUPLICATE, TRUNCATED)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for letters in p["letters"]:
                names = "".join(initials[x] for x in letters)
                illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(names))
                out.append((*(sum(map(letters.count, of[f])) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *repair(letters)))
            yield pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit"]).assign(conv_id=p["conv_id"].array, gaps=p["gaps"].array)

    return whole.mapInPandas(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class Repaired:
    """The repaired rows of one conversation, as its rows come: ``role:text`` of each."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0

    def _role(self) -> str:
        self.out += 1
        return "user" if self.out % 2 else "assistant"

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield f"{self._role()}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield f"{self._role()}:{text}"
        elif edit == "K":
            if not (self.out == 0 and role[:1] == "s"):
                self._role()
            yield f"{role}:{text}"


def repaired_rows(audits: DataFrame, placed: DataFrame) -> DataFrame:
    """The audits' columns and repaired_sha256: rows follow their conversation's audit in one sorted stream."""
    facts = audits.columns[1:]
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *facts)
    body = placed.filter("not gone").select("conv_id", "pos", "role", "text")
    stream = head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in audits.schema)}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # [facts, repairer, hash, whether a row was hashed]
        done: list[dict] = []

        def add(lines: Iterator[str]) -> None:
            for line in lines:
                now[2].update((("\n" if now[3] else "") + line).encode())
                now[3] = True

        def finish() -> None:
            if now:
                add(now[1].inserted())
                done.append(now[0] | {"repaired_sha256": now[2].hexdigest()})

        out = None
        for b in batches:
            names = ["conv_id", *facts]
            out = out or pa.schema([*(b.schema.field(n) for n in names), pa.field("repaired_sha256", pa.string())])
            for pos, role, text, row in zip(b["pos"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), b.select(names).to_pylist(), strict=True):
                if pos < 0:
                    finish()
                    now = [row, Repaired(row["audit"]), hashlib.sha256(), False]
                else:
                    add(now[1].row(role, text))
            if done:
                yield pa.RecordBatch.from_pylist(done, out)
                done = []
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, out)

    return stream.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations (conv_id, turn, role, text, and gone where a row is missing)."""
    marked, placed = lettered(rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False)))
    return repaired_rows(audited(gathered(marked)), placed)
