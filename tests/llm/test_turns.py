"""Conversation repair against a search over all edits, in one block and in many."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from tapestream.llm import turns

from .data import SF

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {conv: sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, held in out.items()}


def cheapest(rows, faults):
    """Uniform-cost search over whole edit strings, the least string first among equal costs."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, state, text = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(text)
        if (i, state, audit) in seen:
            continue
        seen.add((i, state, audit))
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                if (state, role[0]) in MOVES:
                    heapq.heappush(heap, (cost + 2, audit + "I", i, MOVES[state, role[0]], (*text, f"{role}:")))
        if i < len(rows):
            _, role, said = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, text))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if (state, role[:1]) in MOVES:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, MOVES[state, role[:1]], (*text, f"{role}:{said}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in MOVES:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, MOVES[state, new[0]], (*text, f"{new}:{said}")))


def brute(rows):
    out = []
    for conv, held in damage(rows).items():
        faults, seen = [], set()
        for _, role, text in held:
            spoken = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else "")
            seen.add((role, text))
        numbered = [t for t, _, _ in held if t is not None]
        gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, text = cheapest(held, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


SCHEMA = "conv_id long, turn long, role string, text string, symbols string, block long, pos string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 3)


def test_awkward_conversations(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "Who? ", "", None, "é!\n", "fine…", " \t", "x" * 100 + "."]
    rows = [(rng.choice([*range(60), None]), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, None]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)) for _ in range(330)]
    found = turns.repaired(table(spark, rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, found.collect())) == brute(rows)
    assert turns.repaired(table(spark, [])).collect() == []


def test_blocks_agree_with_the_whole(spark, small_blocks):
    rng = random.Random(5)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 6)}{rng.choice(['.', '!', '', ' '])}") for conv in range(40) for turn in range(rng.randint(1, 11))]
    assert Counter(map(tuple, turns.repaired(table(spark, rows, 5)).collect())) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, turns.op13_turn_repair(spark, SF).collect())) == brute(rows)


def test_one_long_conversation_over_many_tasks(spark):
    """Its blocks agree with a plain recursion over all rows."""
    rng = random.Random(9)
    rows = [(7, turn, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{rng.randint(0, 900)}{rng.choice(['.', '!', ''])}") for turn in range(3000)]
    (found,) = turns.repaired(table(spark, rows, 8)).collect()
    symbols, seen = "", set()
    for _, role, text in damage(rows)[7]:
        symbols += "b" if not text.strip() else "d" if (role, text) in seen else role[0] if text[-1] in ".!?" else role[0].upper()
        seen.add((role, text))
    best = list(zip(turns.END_COSTS, turns.ENDING))
    for s in reversed(symbols):
        extra, after = int(s.isupper()), []
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if s not in "bd":
                k = turns.KEPT.get(s.lower(), (None,) * 4)[q]
                ways += [(best[k][0] + extra, "K" + best[k][1])] if k is not None else []
                r = best[turns.MADE[q]]
                ways.append((r[0] + 2 + extra, "R" + r[1]))
            after.append(min(ways))
        for _ in range(2):
            after = [min(after[q], (after[turns.MADE[q]][0] + 2, "I" + after[turns.MADE[q]][1])) for q in range(4)]
        best = after
    assert (found.cost, found.audit) == best[0]
    assert (found.blank, found.duplicate, found.truncated) == (symbols.count("b"), symbols.count("d"), sum(s.isupper() for s in symbols))


def test_auction_prices_are_distances():
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(rng.choice("suaoSUAObd") for _ in range(rng.randint(0, 12)))
        exits = tuple(rng.choice([0, 1, 2, 5, turns.NEVER]) for _ in range(4))
        far = list(exits)
        for s in reversed(symbols):
            after = []
            for q in range(4):
                ways = [far[q] + 3]
                if s not in "bd":
                    k = turns.KEPT.get(s.lower(), (None,) * 4)[q]
                    ways += [far[k] + int(s.isupper())] if k is not None else []
                    ways.append(far[turns.MADE[q]] + 2 + int(s.isupper()))
                after.append(min(ways))
            for _ in range(3):
                after = [min(after[q], after[turns.MADE[q]] + 2) for q in range(4)]
            far = after
        assert [min(c, turns.NEVER) for c in far] == list(turns.auction(symbols, exits)[0])
