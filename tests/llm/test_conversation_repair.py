"""Conversation repair against an automaton that tries every edit, and against a row-by-row reading of the contract."""

import hashlib
import random
import re
import zlib

import pytest

from quillspark.llm import conversation_repair as C


def cheapest(turns):
    """(cost, audit) by an automaton over the last initial."""
    ways = {"": (0, "")}
    for t in [*turns, None]:
        after = {}

        def put(state, way, after=after):
            after[state] = min(after.get(state, way), way)

        for state, (cost, audit) in ways.items():
            for k in range(3):
                now = state
                for _ in range(k):
                    now = "a" if now == "u" else "u"
                c, a = cost + 3 * k, audit + "I" * k
                if t is None:
                    if now in ("", "a"):
                        put(now, (c, a))
                    continue
                put(now, (c + 4, a + "D"))
                if not t.must_go:
                    extra = 3 * t.truncated
                    if (t.initial, now) == ("s", "") or (t.initial == "u" and now != "u") or (t.initial == "a" and now == "u"):
                        put(t.initial, (c + extra, a + "K"))
                    put("a" if now == "u" else "u", (c + 3 + extra, a + "R"))
        ways = after
    return min(ways.values())


@pytest.mark.parametrize("block", [1, 2, 5, 24])
def test_cheapest_edits_and_least_audit(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(700):
        letters = rnd.choice(["suax", "ua", "uua", "s", "ssua", "aau"])
        turns = [C.Turn(rnd.choice(letters), "r", "t", rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randrange(0, 15))]
        own = C.Repair()
        for t in turns:
            own.add(t)
        assert own.finish()[:2] == cheapest(turns)


def test_a_long_conversation_goes_by_in_blocks():
    rnd = random.Random(1)
    turns = [C.Turn(rnd.choice("uasx") if rnd.random() < 0.3 else "ua"[k % 2], "r", "t", rnd.random() < 0.1, rnd.random() < 0.1) for k in range(6000)]
    own = C.Repair()
    for t in turns:
        own.add(t)
        assert len(own.block) <= C.BLOCK and sum(len(w[1]) for w in own.ways.values()) < 2000
    assert own.finish()[:2] == cheapest(turns)


def by_contract(rows):
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            one = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            own += [one, one] if h == 3 else [one]
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            mark = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append(C.Turn(role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = cheapest(turns)
        said, state, at = [], "", 0
        for e in audit:
            t = turns[at] if e != "I" else None
            at += e != "I"
            if e == "K":
                said.append(f"{t.role}:{t.text}")
                state = t.initial
            elif e != "D":
                state = "a" if state == "u" else "u"
                said.append(f"{ {'u': 'user', 'a': 'assistant'}[state]}:{t.text if t else ''}")
        out[conv] = (conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_whole_operator(spark):
    rnd = random.Random(8)
    texts = ["Yes.", "No", " ", "", None, "Why?\n", "So! ", "a.b", "é.", "..."]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rnd.randrange(1, 12)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, -turn, turn + 5]), rnd.choice(["user", "assistant", "system", None, "", "tool", "unknown"]), rnd.choice(texts)))
    rows += rows[:40] + [(777, k, "user" if k % 2 else "assistant", f"Line {k % 300}.") for k in range(1200)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, fault string").repartition(6)
    got = {r["conv_id"]: tuple(r) for r in C.repair(C.damaged(frame)).collect()}
    assert got == by_contract(rows)


def test_nothing_left_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.repair(C.damaged(frame)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damaged(frame.limit(0))).count() == 0
