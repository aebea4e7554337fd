"""Repairs against a plain search over costs and audits, and whole conversations against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, audit) by the least pair at every state of the grammar, row by row."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    inserts = [(q, to) for (q, role), to in moves.items() if role != "s"]

    def settle(v):
        for _ in range(4):
            for q, to in inserts:
                if q in v:
                    v[to] = min(v.get(to, (10**9, "")), (v[q][0] + 3, v[q][1] + "I"))
        return v

    v = settle({"": (0, "")})
    for s in symbols:
        fault, role, new = s // 4, "sua."[s % 4], {}
        for q, (c, a) in v.items():
            options = [(q, c + 4, a + "D")]
            if fault in (0, 3):
                options += [(to, c + fault, a + "K") for (x, r), to in moves.items() if x == q and r == role] + [(to, c + 3 + fault, a + "R") for x, to in inserts if x == q]
            for to, cost, audit in options:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        v = settle(new)
    return min(v[q] for q in ("", "a") if q in v)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=24).map(bytes))
def test_cost_and_audit_are_the_least(symbols):
    assert cr.Repairs().repaired(symbols) == cheapest(symbols)


def test_the_automaton_stays_small():
    r, repairs = random.Random(1), cr.Repairs()
    for _ in range(300):
        symbols = bytes(r.randrange(16) for _ in range(200))
        assert repairs.repaired(symbols) == cheapest(symbols)
    assert len(repairs.vectors) < 150
    cost, audit = repairs.repaired(bytes([1, 2]) * 150_000 + bytes([0]))
    assert cost == 4 and audit == "K" * 300_000 + "D"


def plain(rows):
    """The report of one conversation's rows (turn, role, text), by loops; rows of one turn in the operator's order."""
    mark = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1], x[2])))
    seen, symbols, faults = set(), [], [0] * 4
    for _, role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[fault] += 1
        symbols.append(4 * fault + ("sua".find(role[0]) if role and role[0] in "sua" else 3))
    cost, audit = cheapest(symbols)
    left, out, initials = iter(rows), [], ""
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (0, "", "")
        if letter in "RI":
            role = "assistant" if initials[-1:] == "u" else "user"
        if letter != "D":
            out.append(f"{role}:{text}")
            initials += role[0]
    assert LEGAL.fullmatch(initials)
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *faults[1:], sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            row = conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [row] * (2 if fate == 3 else 1)
    return out


@pytest.mark.parametrize("packed", [1 << 16, 5])
def test_report_equals_plain_loops(spark, monkeypatch, packed):
    monkeypatch.setattr(cr, "PACKED", packed)
    r = random.Random(7)
    rows = [(None if c == 5 else c, r.choice([None, *range(9)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(["Yes.", "No", " \n", None, "", "Ça!", "x" * 70_000, f"{c} ?\t"])) for c in range(40) for _ in range(r.randint(1, 12))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"line {t % 90}.") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {x["conv_id"]: tuple(x)[1:] for x in cr.repair_report(cr.damaged(df), df).collect()}
    after, want = damage(rows), {}
    for conv in {x[0] for x in rows}:
        want[conv] = plain([x[1:] for x in after if x[0] == conv])
    assert got == want


def test_empty_tables_and_dropped_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 9)], "conv_id long, turn long, role string, text string, mark int")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in cr.repair_report(df.limit(0), df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert cr.repair_report(df.limit(0)).collect() == []
    planned = cr.plans(df)
    assert [tuple(r) for r in cr.repaired_rows(df, planned).collect()] == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", "")]
