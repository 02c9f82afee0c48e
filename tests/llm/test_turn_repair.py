"""Conversation repair against a search over whole edit sequences, and the awkward cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from framewise.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, k string, sig string"
NOTHING = hashlib.sha256(b"").hexdigest()


def letters(faults):
    return "".join(chr(ord("A") + 4 * "sua-".index(role) + fault) for role, fault in faults)


def cheapest(rows):
    """Cost, audit and roles of the best edits of (role initial, fault) rows, by uniform-cost search over whole edit strings."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        if len(roles) > len(rows) + 4 or not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault < tr.BLANK:
                late = 3 * (fault == tr.TRUNCATED)
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, roles + role))
                for to in "ua":
                    heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, roles + to))


def test_all_short_signatures():
    kinds = [("s", 0), ("u", 0), ("a", 0), ("-", 0), ("u", 1), ("a", 1), ("-", 1), ("u", 2)]
    words = {letters(rows): rows for n in range(4) for rows in itertools.product(kinds, repeat=n)}
    automaton = tr.Automaton()
    for word in sorted(w[::-1] for w in words):
        assert automaton.read(word) == cheapest(words[word[::-1]])[:2], words[word[::-1]]
    endings = {w[i:] for w in words for i in range(len(w))}
    assert automaton.made == len(endings)
    assert len(automaton.steps) < 16 * 40


def test_random_longer_signatures():
    r = random.Random(5)
    cases = [[(r.choice("suuaa-"), r.choice((0, 0, 0, 1, 2, 3))) for _ in range(r.randint(4, 8))] for _ in range(40)]
    for rows in cases:
        assert tr.Automaton().read(letters(rows)[::-1]) == cheapest(rows)[:2]


def plain(rows):
    """All result columns of one conversation, row by row; ``rows`` are (turn, role, text) in order."""
    seen, faults, out = set(), [], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = tr.BLANK if not bare else tr.DUPLICATE if (role, text) in seen else tr.TRUNCATED if bare[-1] not in ".!?" else tr.OK
        seen.add((role, text))
        faults.append((role[0] if role[:1] and role[0] in "sua" else "-", fault))
    cost, audit, _ = cheapest(faults)
    roles, at = "", 0
    for edit in audit:
        waits = "assistant" if roles.endswith("u") else "user"
        if edit == "I":
            out.append(f"{waits}:")
        elif edit != "D":
            role = rows[at][1] if edit == "K" else waits
            out.append(f"{role}:{rows[at][2]}")
        roles += out[-1][0] if edit != "D" else ""
        at += edit != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[0] for r in faults]
    illegal = sum(a + b not in tr.LEGAL for a, b in zip(initials, initials[1:]))
    kinds = [f for _, f in faults]
    return (gaps, *(kinds.count(f) for f in (tr.BLANK, tr.DUPLICATE, tr.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def awkward():
    r = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(r.randint(1, 7)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            rows.append((conv, turn * r.choice((1, 1, 2)), role, r.choice(["Yes.", "Yes.", "no end", "", " \n", None, "Ends!\n ", "Ü?"])))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (3, None, "user", "First?"), (3, None, "user", "First?")]
    rows += [(99, t, "user" if t % 2 else "assistant", f"{'long ' * 40000}{t}.") for t in range(3)]
    return rows + [(50, 0, "user", "Again.")] * 6


def test_rows_against_plain_code(spark):
    rows = awkward()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(6)
    out = {r.conv_id: tuple(r)[1:] for r in tr.repairs(tr.damage(df), df).collect()}
    groups = {}
    for r in damaged(rows):
        groups.setdefault(r[0], []).append(r[1:])
    assert set(out) == {r[0] for r in rows}
    for conv, got in out.items():
        assert got == (plain(groups[conv]) if conv in groups else (0, 0, 0, 0, 0, 0, "", NOTHING)), conv


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tr.repairs(tr.damage(df), df).collect() == [] and tr.repaired_turns(df).collect() == []


def test_one_conversation_over_many_pieces(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"Turn {t % 50}." if t % 5 else f"open {t}") for t in range(3000)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = sorted(tr.repaired_turns(df).collect(), key=lambda r: r.number)
        (whole,) = tr.repairs(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.number for r in turns] == list(range(len(turns))) and re.fullmatch("(ua)+", "".join(r.role[0] for r in turns))
    assert len(whole.audit) - whole.audit.count("I") == 3000 and whole.audit.count("D") >= whole.duplicate > 0
    assert whole.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest()
