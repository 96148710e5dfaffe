"""Conversation repair against exhaustive search of edits, and against a plain recursion for longer conversations."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import repair as rp

SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """The contract's damage in Python; rows by conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        text_or = lambda v: " " if v is None else str(v)
        role, text = text_or(role), text_or(text)
        kind = zlib.crc32(f"{text_or(conv)}:{text_or(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for c, own in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def exhaustive(rows):
    kinds, best = faults(rows), None
    gaps = ["", "u", "a", "ua", "au"]
    full = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*(["D"] if k in (1, 2) else ["K", "Ru", "Ra", "D"] for k in kinds)):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i, more in enumerate(inserts):
                cost, audit, turns = cost + 5 * len(more), audit + "I" * len(more), turns + [(full[c], "") for c in more]
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + 5 * (e != "D" and kinds[i] == 3)
                    turns += [] if e == "D" else [(role if e == "K" else full[e[1]], text)]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def recursion(rows):
    states = {0: (0, "", ())}
    step = lambda s, c: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(c, {}).get(s)

    def better(to, s, v):
        if s is not None and (s not in to or v[:2] < to[s][:2]):
            to[s] = v

    def inserted(states):
        out = dict(states)
        for s, (c, a, t) in states.items():
            for role in ("user", "assistant"):
                better(out, step(s, role[0]), (c + 5, a + "I", (*t, (role, ""))))
        return out

    for (_, role, text), kind in zip(rows, faults(rows), strict=True):
        new = {}
        for s, (c, a, t) in inserted(states).items():
            better(new, s, (c + 2, a + "D", t))
            if kind in (0, 3):
                late = 5 * (kind == 3)
                better(new, step(s, role[:1]), (c + late, a + "K", (*t, (role, text))))
                for r in ("user", "assistant"):
                    better(new, step(s, r[0]), (c + 1 + late, a + "R", (*t, (r, text))))
        states = new
    return min(v for s, v in inserted(states).items() if s in (0, 3))


def expected(rows, solve):
    out = []
    for conv, own in damaged(rows).items():
        kinds = faults(own)
        cost, audit, turns = solve(own)
        known = [t for t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 as copies", "'x' as digest", "2 as piece", "3 as salt", "true as blank")
    out = rp.digested(rp.repair(rp.damage(df)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def made(seed, conversations, turns, odd=True):
    r, out = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant"] + (["tool", "", None, "User", "u"] if odd else [])
    texts = ["Yes.", "No!", "Why?", "so", "Done. ", "a　", "é.\x0b", *(f"t{i}." for i in range(30))] + (["", " \n", None, "\x85", "x" * 3000] if odd else [])
    for conv in range(conversations):
        for t in range(r.randrange(1, turns + 1)):
            out.append((conv if conv % 17 or not odd else None, None if odd and r.random() < 0.05 else t + (r.random() < 0.1), r.choice(roles), r.choice(texts)))
    return out


def test_kernel_equals_exhaustive_search(spark):
    rows = [x for x in made(1, 120, 3) if x[0] is not None]
    assert got(spark, rows) == expected(rows, exhaustive) == expected(rows, recursion)


@pytest.mark.parametrize("piece", [3, 4096])
def test_repair_equals_recursion(spark, monkeypatch, piece):
    """Small pieces, and ranges dealt to several tasks: conversations cross borders."""
    monkeypatch.setattr(rp, "PIECE", piece)
    monkeypatch.setattr(rp, "CELLS", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(2, 60, 9) + [(1000, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 70}.") for t in range(150)] + [(1001, 3, "user", "same.")] * 40
        assert got(spark, rows) == expected(rows, recursion)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_held_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(rp, "PIECE_BYTES", 5000)
    rows = made(3, 12, 8) + [(500, t, ["user", "assistant"][t % 2], "long " * 1500 + f"{t}.") for t in range(12)]
    assert got(spark, rows, 1) == expected(rows, recursion)


def test_conversations_without_rows_after_damage(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert got(spark, [(c, 0, "user", "Hi.") for c in gone]) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone], key=str)
    assert got(spark, []) == []


def test_turns_of_the_output(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "user", "Hi."), (1, 2, "user", "Still there?"), (1, 3, "tool", "Yes."), (1, 4, "user", "Bye.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copies")
    turns = [(t.role, t.text) for r in sorted(rp.repair(df).collect(), key=lambda r: (r.part, r.piece)) for t in r.turns]
    assert turns == recursion([r[1:] for r in rows])[2] or turns == list(recursion([r[1:] for r in rows])[2])


def test_costs_of_pieces_compose():
    r = np.random.default_rng(4)
    initial, fault = r.integers(0, 4, 40), r.integers(0, 4, 40)
    whole = rp.matrices(initial, fault, np.array([0, 40]))[0]
    parts = rp.matrices(initial, fault, np.array([0, 7, 7, 31, 40]))
    total = parts[0]
    for m in parts[1:]:
        total = (total[:, :, None] + m[None]).min(1)
    assert (np.minimum(total, rp.FAR) == whole).all()
