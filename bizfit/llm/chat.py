"""Chat formatting with a grammar round trip.

Template, one turn after another::

    ### Role[level]: role\\n body </turn>\\n

where the header line is ``### User:``, ``### Assistant:`` or ``### System:`` for
the usual roles and ``### Role "<JSON string>":`` for any other, ``[n]`` follows
the name if the body was escaped at level n, and the body ends at the first
``</turn>``. The control strings ``### `` and ``</turn>`` never occur in a body.

Level 0 writes a text as it is. The rendered conversation is then reparsed by a
deterministic parser and compared with its source; turns that don't come back
equal are raised to level 1, which doubles each backslash and puts one inside
each control string, and then everything is reparsed. Texts without control strings
thus stay readable and every text comes back.

A conversation is one training sample and is formatted in one piece, so its turns
must fit a task; nothing wider than a conversation is gathered. Turns are ordered
by (turn, role, text), nulls first, which also places ties; repeated rows are
repeated turns. A null text is empty, a null role is the role "". Rows with null
conv_id form one conversation. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = {"user": "User", "assistant": "Assistant", "system": "System"}
CLOSE = "</turn>"
_ROLES = {v: k for k, v in NAMED.items()}
_HEADER = re.compile(r'### (?:(User|Assistant|System)|Role ("(?:[^"\\]|\\.)*"))(?:\[(\d)\])?:\n')
_CONTROL = re.compile(r"</turn>|### ")

Turn = tuple[str, str]


def escape(text: str) -> str:
    """Double backslashes, then break each control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(body: str) -> str:
    """A doubled backslash is one; a single one was put there by escape()."""
    return re.sub(r"\\(\\?)", r"\1", body)


def render_turn(role: str, text: str, level: int) -> str:
    name = NAMED.get(role) or f"Role {json.dumps(role)}"
    return f"### {name}{f'[{level}]' if level else ''}:\n{escape(text) if level else text}{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn; stops where the grammar is broken."""
    turns, at = [], 0
    while m := _HEADER.match(formatted, at):
        end = formatted.find(CLOSE, m.end())
        body = formatted[m.end() : end]
        if end < 0 or _CONTROL.search(body) or formatted[end + len(CLOSE) : end + len(CLOSE) + 1] != "\n":
            break
        role = _ROLES[m[1]] if m[1] else json.loads(m[2])
        turns.append((role, unescape(body) if m[3] == "1" else body, m.end(), end))
        at = end + len(CLOSE) + 1
    return turns if at == len(formatted) else [*turns, ("", "", at, len(formatted))]


def format_conversation(turns: list[Turn]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted text, and the turns read back from it, equal to ``turns``."""
    levels = [0] * len(turns)
    while True:
        parts = [render_turn(*t, level) for t, level in zip(turns, levels, strict=True)]
        formatted = "".join(parts)
        back = parse(formatted)
        if [t[:2] for t in back] == list(turns):
            return formatted, back
        wrong = [i for i, (t, p) in enumerate(zip(turns, parts, strict=True)) if not levels[i] and [x[:2] for x in parse(p)] != [t]]
        if not wrong:
            raise ValueError("an escaped conversation doesn't come back")
        for i in wrong:
            levels[i] = 1


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (turn, role, text)."""
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (start and end of each assistant body: the loss mask), roles and texts as read back."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, spans array<array<int>>, roles array<string>, texts array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [format_conversation([(t["role"], t["text"]) for t in turns]) for turns in p["turns"]]
            yield pd.DataFrame({
                "conv_id": p["conv_id"], "formatted": [f for f, _ in out], "spans": [[[s, e] for r, _, s, e in back if r == "assistant"] for _, back in out],
                "roles": [[b[0] for b in back] for _, back in out], "texts": [[b[1] for b in back] for _, back in out],
            })

    return conversations(rows).mapInPandas(run, schema)


def chat_digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all taken from the formatted text."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for conv, formatted, spans in zip(p["conv_id"], p["formatted"], p["spans"], strict=True):
                back = parse(formatted)
                inside = {tuple(s) for s in spans}
                loss = "".join(t for _, t, s, e in back if (s, e) in inside)
                out.append((conv, len(back), digest("".join(f"{r}\n{t}\n" for r, t, *_ in back)), len(loss), digest(loss), len(formatted)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": p["conv_id"].dtype})

    return format_chats(rows).select("conv_id", "formatted", "spans").mapInPandas(run, schema)
