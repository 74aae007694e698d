"""Conversation repair against a search over all edits by cost and string."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from limnos.llm.conversation_repair import START, apply_edits, damage, merge_tables, repair, search, segment_table

SCHEMA = "conv_id long, turn long, role string, text string, at long, seg string, fault double"


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return convs


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """Least (cost, edits) by Dijkstra over rows and states."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, edits, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(initials) and last in ("", "a"):
            return cost, edits
        given = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, edits + "I", i, given))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last))
            if faults[i] not in "bd":
                more = 3 * (faults[i] == "t")
                heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, given))
                if initials[i] == given or (initials[i] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, initials[i]))


def plain(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        faults, initials = faults_of(kept), [r[1][:1] for r in kept]
        turns = [r[0] for r in kept if r[0] is not None]
        cost, edits = cheapest(initials, faults)
        marks = "".join(c if c in "sua" and c else "-" for c in initials)
        text = apply_edits(edits, START, marks, [r[1] for r in kept], [r[2] for r in kept])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation(seed, rows, conv):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "agent", "User"]
    texts = ["Yes.", "No!", "why", None, "", " \t", "a much longer text. and more", "\x1c", "Yes.", "ends well?\n", "日本。"]
    return [(conv, draw.choice([None, *range(rows)]) if draw.random() < 0.1 else t, draw.choice(roles), draw.choice(texts) if draw.random() < 0.7 else f"text {t}.") for t in range(rows)]


def test_search_is_the_least_string_of_the_least_cost():
    draw = random.Random(5)
    for _ in range(400):
        n = draw.randrange(9)
        initials, faults = "".join(draw.choice("suauaua-") for _ in range(n)), "".join(draw.choice("....tbd") for _ in range(n))
        assert search(initials, faults, START, None) == cheapest(initials, faults), (initials, faults)


def test_merged_segments_are_the_whole():
    draw = random.Random(6)
    for _ in range(60):
        parts = [("".join(draw.choice("suauau-") for _ in range(n)), "".join(draw.choice("...tbd") for _ in range(n))) for n in (3, 0, 4, 2)]
        costs, _, back = merge_tables([segment_table(*p) for p in parts])
        whole = "".join(p[0] for p in parts), "".join(p[1] for p in parts)
        for entry in range(4):
            for target in range(4):
                alone = search(*whole, entry, target)
                assert costs[entry * 4 + target] == (alone[0] if alone else None)
                if alone:
                    state, edits = target, []
                    for part, step in zip(reversed(parts), reversed(back)):
                        edits.append(search(*part, step[entry, state], state)[1])
                        state = step[entry, state]
                    assert "".join(reversed(edits)) == alone[1]


@pytest.mark.parametrize("segment_rows, merge_bits", [(32, 6), (3, 2)])
def test_awkward_conversations(spark, segment_rows, merge_bits):
    rows = [r for i in range(60) for r in conversation(i, 1 + i % 9, None if i == 7 else i)]
    rows += conversation(99, 300, 1000) + [(2000, 5, "user", "Same.")] * 200 + [(3000, None, "user", "x" * 100_000 + ".")]
    # An id whose only turn is dropped.
    gone = next(i for i in range(4000, 5000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Gone.")]
    table = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA).repartition(5)
    result = repair(damage(table), segment_rows, merge_bits).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in result}
    assert len(result) == len(got)
    assert got == plain(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert repair(damage(spark.createDataFrame([], SCHEMA))).count() == 0
