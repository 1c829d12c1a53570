"""Conversation repair against a plain search over edit strings, on made-up and on awkward conversations."""

import hashlib
import itertools
import random
import re
import zlib

from bizfit.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    """Of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_audit(rows, faults):
    """(cost, audit, repaired) by the cheapest prefixes of every grammar state, kept whole."""
    best = {("", 0): (0, "", ())}  # (shape so far, number of rows) -> cost, audit, repaired rows
    step = lambda shape: "a" if shape.endswith("u") else "u"
    fold = lambda shape: shape if shape in ("", "s") else "..u" if shape.endswith("u") else "..a"
    name = {"u": "user", "a": "assistant"}

    def grow(options):
        least = {}
        for key, value in options:
            if key not in least or value[:2] < least[key][:2]:
                least[key] = value
        return least

    def inserted(states):
        for _ in range(2):
            states = grow([*states.items(), *(((fold(s + step(s)), n), (c + 2, a + "I", (*r, f"{name[step(s)]}:"))) for (s, n), (c, a, r) in states.items())])
        return states

    best = inserted(best)
    for k, ((_, role, text), fault) in enumerate(zip(rows, faults, strict=True)):
        options, extra = [], fault == "truncated"
        for (shape, _), (c, a, r) in best.items():
            options.append(((shape, k + 1), (c + 3, a + "D", r)))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] == step(shape) or (role[:1] == "s" and not shape):
                options.append(((fold(shape + role[0]), k + 1), (c + extra, a + "K", (*r, f"{role}:{text}"))))
            options.append(((fold(shape + step(shape)), k + 1), (c + 2 + extra, a + "R", (*r, f"{name[step(shape)]}:{text}"))))
        best = inserted(grow(options))
    return min(v for (shape, _), v in best.items() if shape in ("", "..a"))


def plain(rows):
    """What the operator returns, by conv_id, of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        now = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            now += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        now.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = plain_faults(now)
        turns = [r[0] for r in now if r[0] is not None]
        cost, audit, repaired = plain_audit(now, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(now)), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def check(spark, rows, schema="conv_id long, turn long, role string, text string"):
    docs = spark.createDataFrame([(*r, "x", -1) for r in rows], f"{schema}, letters string, pos int")
    got = repair.repair_conversations(repair.damaged(docs)).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], (r, want[r["conv_id"]])


def make(rng):
    text = lambda: rng.choice(["Yes.", "No", "Why?", "ok!\n", "", " ", f"Text {rng.randrange(9)}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
    rows = [(c, t, role(), text()) for c in range(300) for t in range(rng.randrange(1, 12))]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Row {t}.") for t in range(3000)]  # one long conversation
    rows += [(901, t % 3, None, None) for t in range(6)] + [(None, t, "user", f"{t}.") for t in range(5)] + [(902, None, "user", f"{t}?") for t in range(4)]
    return rows + [(903, 1, "user", "Same.")] * 40 + [(904, 1, "user", "long " * 60_000 + ".")] + [(905, k, "user", "x.") for k in (-5, 40, 7)]


def test_repairs_match_a_plain_search(spark):
    rows = make(random.Random(2))
    random.Random(3).shuffle(rows)
    check(spark, rows)


def test_no_rows_at_all_and_none_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Yes.")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(repair.damaged(empty)).count() == 0


def test_pieces_of_a_conversation_are_joined(spark, monkeypatch):
    """With pieces of four rows, a turn may lie in several of them, and whole pieces have no turn."""
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(6), 30]), rng.choice(["user", "assistant"]), rng.choice(["A.", "B", "C?"]) + str(k) + ".") for c in range(30) for k in range(25)]
    check(spark, rows)


def test_blocks_match_every_short_audit():
    """Strings of up to three letters, against the plain search."""
    for n in range(4):
        for letters in itertools.product(repair.LETTERS[::2] + "bd" if n == 3 else repair.LETTERS, repeat=n):
            cost, audit = repair.repair("".join(letters))
            rows = [(0, {"s": "system", "u": "user", "a": "assistant", "-": "tool"}["sua-"[(ord(x) - 97) // 4]], "t") for x in letters]
            faults = [("", "truncated", "blank", "duplicate")[(ord(x) - 97) % 4] for x in letters]
            want = plain_audit(rows, faults)
            assert (cost, audit) == want[:2]
            assert GOOD.match("".join(r[0] for r in want[2]))
