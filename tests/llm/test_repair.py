"""Repair of conversations against exhaustive search over edits, long ones in spans, and the query's contract row by row."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tallychain.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, span string"
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if by == 1:
            text = ""
        if by == 2:
            text = re.sub("[.!?]", "", text)
        if by == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(by, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """Dijkstra over (row, what is written so far as a state), least cost first, then the least letters."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in step[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*lines, role + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[state][role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in step[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(plain_damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, turns = plain_faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, lines = plain_edits(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=3, conversations=140):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "what", "How? ", "", " \n", "é…", "Ü. ", ".", "a.b", None, "Yes.\x0b"]
    rows = []
    for c in range(conversations):
        turn = r.randrange(3)
        for i in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ["user", "assistant"][i % 2]
            rows.append((c, r.choice([turn, turn, turn, None]) if r.random() < 0.1 else turn, r.choice([None, "", "tool", "system", "S"]) if r.random() < 0.15 else role, r.choice(texts) if r.random() < 0.4 else f"t{i} {c}."))
            turn += r.choice([1, 1, 1, 1, 2, 0, 5])
    rows += [(None, i, "user", "x.") for i in range(4)] + [(-1, None, "user", "x."), (-1, None, "assistant", "y.")] + rows[:30]
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.repaired(df).collect()), key=str)


def test_equals_search_over_all_edits(spark):
    rows = made()
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("span", [1, 3])
def test_conversations_of_many_spans(spark, monkeypatch, span):
    monkeypatch.setattr(repair, "SPAN", span)
    rows = made(4, 60)
    assert found(spark, rows) == plain(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 512)
    r = random.Random(9)
    rows = [(7, i, r.choice(["user", "assistant", "system"]), r.choice(["a.", f"b{i}.", f"c{i}", " "])) for i in range(5000)]
    assert found(spark, rows) == plain(rows)


def test_edits_are_the_real_output(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There"), (2, 0, "assistant", "So."), (2, 1, "user", "So?")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "span", "nth", "slot").collect()
    assert [(r.conv_id, r.turn, r.edit, r.role, r.text, r.fault) for r in out] == [
        (1, 0, "K", "user", "Hi.", None), (1, 1, "R", "assistant", "There", "truncated"),
        (2, None, "I", "user", "", None), (2, 0, "K", "assistant", "So.", None), (2, 1, "K", "user", "So?", None), (2, None, "I", "assistant", "", None),
    ]


def test_empty_table_and_no_rows_left(spark):
    assert found(spark, []) == []
    dropped = next(i for i in range(100) if zlib.crc32(f"5:{i}".encode()) % 20 == 0)
    assert found(spark, [(5, dropped, "user", "x.")]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_costs_hold_for_every_start():
    r = np.random.default_rng(0)
    kinds = r.integers(0, 12, (9, 40))
    ends = np.tile(repair.ENDING, (40, 1))
    whole = repair.costs(kinds, ends)
    late = repair.costs(kinds[4:], ends)[0]
    assert (repair.costs(kinds[:4], late)[0] == whole[0]).all()
