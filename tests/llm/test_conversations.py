"""Conversation repair against an exhaustive search, and odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from veilscan.llm import conversations as C
from veilscan.llm.conversations import damaged, repair

SHAPE = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
WHITE = " \t\n\x0b\x0c\r"


def broken(rows):
    """Rows after damage, by the rules as they are written."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if pick == 1:
            text = ""
        if pick == 2:
            text = "".join(c for c in text if c not in ".!?")
        if pick == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)


def cheapest(symbols):
    """Least (cost, audit, outputs) of rows (letter, fault), by trying every edit."""

    @cache
    def go(i, state, left=2):
        # state: '' nothing yet, else the letter read last; more than two insertions in a row only go round
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        options = [(0, "", ())] if i == len(symbols) and state in ("", "a") else []
        if i < len(symbols):
            letter, fault = symbols[i]
            more = 5 if fault == "truncated" else 0
            cost, audit, out = go(i + 1, state)
            options.append((2 + cost, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                cost, audit, out = go(i + 1, follow)
                options.append((1 + more + cost, "R" + audit, ((follow, i), *out)))
                if letter == follow or (letter == "s" and state == ""):
                    cost, audit, out = go(i + 1, letter)
                    options.append((more + cost, "K" + audit, ((None, i), *out)))
        if left:
            cost, audit, out = go(i, follow, left - 1)
            options.append((5 + cost, "I" + audit, ((follow, None), *out)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return go(0, "")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = list(broken([r for r in rows if r[0] == conv]))
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, symbols, illegal = set(), [], 0
        for k, (_, _, role, text) in enumerate(mine):
            stripped = text.rstrip(WHITE)
            if not stripped:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = "" if stripped[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1], fault))
            illegal += k > 0 and symbols[k - 1][0] + symbols[k][0] not in ("su", "ua", "au")
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, edits = cheapest(tuple(symbols)) if mine else (0, "", ())
        lines = []
        for follow, i in edits:
            role = mine[i][2] if follow is None else {"u": "user", "a": "assistant"}[follow]
            lines.append(f"{role}:{'' if i is None else mine[i][3]}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(f == kind for _, f in symbols) for kind in ("blank", "duplicate", "truncated")),
            illegal,
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def some_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, most)):
            rows.append(
                (
                    conv,
                    None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]),
                    rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "s"]),
                    rng.choice(["One.", "Two?", "Two?", "three", "four! \n", "", " \t", None, f"Text {rng.random()}.", "é 🙂."]),
                )
            )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_bytes", [C.RANGE_BYTES, 300])
def test_repair_equals_exhaustive_search(spark, range_bytes):
    """Also with ranges so small that nearly every conversation is cut in pieces."""
    rows = some_rows(7, 60, 14)
    found = result(repair(damaged(spark.createDataFrame(rows, SHAPE).repartition(5)), range_bytes))
    assert found == brute(rows)


def test_conversation_over_many_ranges(spark):
    """One conversation with most rows, dealt over many ranges, with a row that is a third of them."""
    rows = some_rows(3, 4, 5) + [(9, t, "user" if t % 2 else "assistant", f"Line {t % 211}" + ".?x"[t % 3]) for t in range(900)]
    rows += [(9, 450, "user", "The same.")] * 600
    found = result(repair(damaged(spark.createDataFrame(rows, SHAPE).repartition(7)), 2000))
    expected = brute([r for r in rows if r[0] != 9])
    assert {k: v for k, v in found.items() if k != 9} == expected
    mine = sorted(broken([r for r in rows if r[0] == 9]), key=lambda r: (r[1], r[2], r[3]))
    assert len(found[9][6].replace("I", "")) == len(mine)
    whole = C.Repair()
    seen, held = set(), []
    for (_, turn, role, text), group in groupby(mine):
        n = len(list(group))
        stripped = text.rstrip(WHITE)
        held.append((turn, n, (role, text) in seen, not stripped, stripped[-1:] not in (".", "!", "?"), role.encode(), text.encode()))
        seen.add((role, text))
    whole.piece(held, C.ENDING)
    assert tuple(whole.result().values()) == found[9]


@pytest.mark.parametrize("length", [1, 2, 5, 64, 1000])
def test_runs_equal_single_steps(length):
    for symbol in [("u", False, False), ("a", True, False), ("s", False, False), ("", True, False), C.GONE]:
        step = C.ENDING
        for _ in range(length):
            step = C.times_vector(C.power(symbol, 0), step)
        assert C.before_run(symbol, length, C.ENDING) == step
        assert C.times_vector(C.run_matrix(symbol, length), C.ENDING) == step


def test_odd_conversations(spark):
    """Empty tables, clashing and extra columns, long texts, extreme turns, and all rows dropped."""
    assert repair(damaged(spark.createDataFrame([], SHAPE))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(t for t in range(1000, 2000) if zlib.crc32(f"5:{t}".encode()) % 20 > 4)
    rows = [
        (dropped, 0, "user", "Gone."),
        (5, kept, "user", "long " * 100000 + "."),
        (6, -(2**63), "user", "First."),
        (6, 2**63 - 1, "assistant", "Last."),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    for name in ["n", "part", "seq", "later", "least", "digest", "copies", "pick", "c", "gaps", "ends"]:
        df = df.withColumn(name, F.lit(1))
    found = result(repair(damaged(df)))
    expected = brute(rows)
    assert expected[6][0] >= 2**63 - 2
    expected[6] = (min(expected[6][0], 2**63 - 1), *expected[6][1:])
    assert found == expected
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)
