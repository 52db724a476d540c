"""Conversation repair against a search with audits written out, edit by edit."""

import itertools
import random
import re
from hashlib import md5, sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from postquill.llm import conversations

ROW = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(lot, 1)):
            yield turn, role, text


def plain(rows):
    rows = sorted(hurt(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "dup" if (role, text) in seen else "cut" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # state: cost, audit, lines

    def better(found, state, cost, audit, lines):
        if state not in found or (cost, audit) < found[state][:2]:
            found[state] = (cost, audit, lines)

    def inserted(found):
        for _ in range(5):
            for state, (cost, audit, lines) in list(found.items()):
                better(found, NEXT[state], cost + 2, audit + "I", (*lines, ROLE[NEXT[state]] + ":"))

    for (_, role, text), fault in zip(rows, faults):
        inserted(best)
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, cost + 3, audit + "D", lines)
            if fault not in ("blank", "dup"):
                late = int(fault == "cut")
                better(after, NEXT[state], cost + 2 + late, audit + "R", (*lines, f"{ROLE[NEXT[state]]}:{text}"))
                if role[:1] == NEXT[state] or (state == "" and role[:1] == "s"):
                    better(after, role[:1], cost + late, audit + "K", (*lines, f"{role}:{text}"))
        best = after
    inserted(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps if gaps < 1 << 63 else None, *(faults.count(f) for f in ("blank", "dup", "cut")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def odd_rows():
    rng = random.Random(7)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "su", "é"])
            text = rng.choice(["Done.", "Why?", "cut off", "", " \n", None, "é!", "日。", "x. ", f"turn {turn}.", f"t{turn}"])
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 4]), role, text))
    for turn in range(400):  # a long one, with many copies of a turn
        rows.append((500, turn // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{turn % 150}" + rng.choice(["", "."])))
    rows += [(500, 33, "assistant", "again.")] * 40 + rows[:3] * 2
    rows += [(600, 2**63 - 1, "user", "a" * 200_000), (600, -(2**63), "assistant", "b?"), (601, 0, "system", "only.")]
    return rows


@pytest.mark.parametrize("range_rows", [250_000, 9])
def test_repair(spark, range_rows):
    rows = odd_rows()
    table = spark.createDataFrame(rows, ROW).withColumns({"times": F.lit("clash"), "code": F.lit(1), "kind": F.lit(2)})
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damaged(table), range_rows).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert got == {conv: plain(own) for conv, own in by_conv.items()}
    assert any("I" in r[6] for r in got.values()) and any("R" in r[6] for r in got.values())


def test_every_short_conversation(spark):
    """All sequences of up to four turns, whatever the damage does to them."""
    kinds = [("system", "s."), ("user", "u."), ("assistant", "a."), ("user", "u"), ("assistant", ""), ("tool", "t.")]
    rows, conv = [], 0
    for n in range(1, 5):
        for turns in itertools.product(kinds, repeat=n):
            rows += [(conv, i, *t) for i, t in enumerate(turns)]
            conv += 1
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damaged(spark.createDataFrame(rows, ROW)), 1000).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert got == {c: plain(own) for c, own in by_conv.items()}


def test_empty_table(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], ROW))).count() == 0
