"""Conversation repair against enumeration and a plain dynamic programme."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from brute import DATA
from pyspark.sql import functions as F

from tobflow.llm import conversation as C

COLUMNS = "conv_id long, turn long, role string, text string, block long, at long, code int, segment string, whole string"
STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(state, i, rows, found):
    """(initial, cost, next state, rows taken, line) of every edit."""
    free = "a" if state == "u" else "u"
    yield "I", 2, free, 0, f"{ROLE[free]}:"
    if i == len(rows):
        return
    role, text = rows[i][2:]
    yield "D", 3, state, 1, None
    if found[i] not in ("blank", "duplicate"):
        extra = found[i] == "truncated"
        if (to := STEP.get((state, role[:1]))) is not None:
            yield "K", extra, to, 1, f"{role}:{text}"
        yield "R", 2 + extra, free, 1, f"{ROLE[free]}:{text}"


def programme(rows):
    """(cost, audit, lines) by least cost, then least audit."""
    found = faults(rows)

    @cache
    def best(i, state, inserted):
        out = [(0, "", ())] if i == len(rows) and state in "0a" else []
        for initial, cost, to, taken, line in options(state, i, rows, found):
            if (initial != "I" or inserted < 3) and (rest := best(i + taken, to, 0 if taken else inserted + 1)):
                out.append((cost + rest[0], initial + rest[1], (() if line is None else (line,)) + rest[2]))
        return min(out) if out else None

    for i in range(len(rows), -1, -1):  # from the end, for a shallow recursion
        for state in "0sua":
            best(i, state, 0)
    return best(0, "0", 0)


def enumerate_all(rows):
    """As ``programme``, trying every sequence of edits."""
    found, out = faults(rows), []

    def walk(i, state, inserted, cost, audit, lines):
        if i == len(rows) and state in "0a":
            out.append((cost, audit, lines))
        for initial, extra, to, taken, line in options(state, i, rows, found):
            if initial != "I" or inserted < 2:
                walk(i + taken, to, 0 if taken else inserted + 1, cost + extra, audit + initial, lines + (() if line is None else (line,)))

    walk(0, "0", 0, 0, "", ())
    return min(out)


def brute(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()[:16]))
        found, turns = faults(own), {r[1] for r in own} - {None}
        cost, audit, lines = programme(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def ours(raw, **how):
    report, pieces = C.repair(C.damage(raw), **how)
    rows = report.join(C.digests(pieces), ["c0", "c1"]).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(((r.c1 if r.c0 else None, *(r[n] for n in names)) for r in rows), key=str)


def random_rows(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "What?", "again", "Fine!\n", "x" * 50]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, turns)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"own {rng.random()}."])))
    return rows


def test_programme_is_what_enumeration_gives():
    for rows in ([r for r in damaged(random_rows(s, 1, 4))] for s in range(60)):
        assert programme(rows) == enumerate_all(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "s", "w") for r in rows], COLUMNS)


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_against_the_programme(spark, block_rows):
    """Blocks of one and three rows part nearly every conversation."""
    rows = random_rows(5, 60, 12) + [(None, 1, "user", "Lost."), (None, None, None, None), (-4, 3, "assistant", "é" * 100_000 + "!"), (-4, 3, "assistant", "second")]
    alive = {r[0] for r in damaged(rows)}
    assert ours(frame(spark, rows), block_rows=block_rows) == [r for r in brute(rows) if r[0] in alive]


def test_a_hot_conversation_and_hot_rows(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"own {t}.", "cut"])) for t in range(3000)] + [(7, 5, "user", "copy!")] * 500 + [(7, None, "assistant", f"n {k}") for k in range(300)]
    assert ours(frame(spark, rows), block_rows=100) == brute(rows)


def test_empty_table_and_dropped_conversations(spark, tmp_path):
    assert ours(frame(spark, [])) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame(spark, [(gone, 0, "user", "Hi.")]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark):
    raw = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = C.op11_conversation_repair(spark, f"{DATA}/sf0.01")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in raw.collect()])
    assert got.where(F.col("cost") > 0).count() > 0
