"""Conversation repair against plain enumeration, in one piece and in many."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations as c

TYPE = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    """Turns in order with their faults, from (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, out = set(), []
    for t, r, x in rows:
        solid = x.strip(c.SPACES)
        fault = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def plain_repair(turns, most_inserts=3):
    """Every way to edit up to a few turns: (cost, audit, roles and texts) of the best."""
    best = None
    for edits in product(*[("D",) if f in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for *_, f in turns]):
        for inserts in product(("", "Iu", "Ia", "IuIa", "IaIu"), repeat=len(turns) + 1):
            if sum(len(i) // 2 for i in inserts) > most_inserts:
                continue
            cost, audit, roles, out = 0, "", "", []
            for k in range(len(turns) + 1):
                for who in inserts[k].split("I")[1:]:
                    cost, audit, roles = cost + 3, audit + "I", roles + who
                    out.append(({"u": "user", "a": "assistant"}[who], ""))
                if k < len(turns):
                    _, r, x, fault = turns[k]
                    e = edits[k]
                    cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if fault == "truncated" and e != "D" else 0)
                    audit += e[0]
                    if e != "D":
                        role = r if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                        roles += role[:1] or "-"
                        out.append((role, x))
            body = roles.removeprefix("s")
            if (not roles) or (body and body == "ua" * (len(body) // 2)):
                best = min(best or (10**9,), (cost, audit, out))
    return best


def sha(messages):
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in messages).encode()).hexdigest()


def some_turns(rng, n):
    return [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut off", " ", None, "Why?", "ends \n."])) for _ in range(n)]


def test_search_against_enumeration():
    rng = random.Random(5)
    for k in range(60):
        turns = plain_turns(some_turns(rng, k % 5))
        cost, audit, out = plain_repair(turns)
        mine = [c.Turn(r[:1], f, 1, None, r, x) for _, r, x, f in turns]
        assert c.search(mine, c.NONE, c.ENDS).popitem()[1] == (cost, audit)
        assert [(m["role"], m["text"]) for m in c.apply(mine, audit, c.NONE)] == out


def report_by_hand(rows):
    turns = plain_turns(rows)
    mine = [c.Turn(r[:1], f, 1, None, r, x) for _, r, x, f in turns]
    cost, audit = c.search(mine, c.NONE, c.ENDS).popitem()[1]
    numbers = [t for t, *_ in turns if t is not None]
    gap = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    faults = [f for *_, f in turns]
    out = c.apply(mine, audit, c.NONE)
    return (gap, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in c.LEGAL for p in pairs), cost, audit, sha((m["role"], m["text"]) for m in out))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def long_and_short():
    """One conversation with most of the rows, copies of one turn, nulls, ties, and many short ones."""
    rng = random.Random(8)
    rows = [(7, k // 2, rng.choice(["user", "assistant"]), f"line {k % 97}{rng.choice(['.', '', '?'])}") for k in range(900)]
    rows += [(7, 30, "user", "again.")] * 120 + [(None, *t) for t in some_turns(rng, 6)] + [(8, None, None, None)]
    for k in range(10, 60):
        rows += [(k, *t) for t in some_turns(rng, k % 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_pieces_give_what_the_whole_gives(spark, long_and_short, block):
    found = c.repair(spark.createDataFrame(long_and_short, TYPE).repartition(5), block=block, fan=3)
    got = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in c.digested(found).collect()}
    groups = defaultdict(list)
    for i, *rest in long_and_short:
        groups[i].append(tuple(rest))
    assert got == {i: report_by_hand(rows) for i, rows in groups.items()}


def test_messages_are_the_repaired_turns(spark, long_and_short):
    found = c.repair(spark.createDataFrame(long_and_short, TYPE), block=50)
    audits = {r["conv_id"]: r["audit"] for r in found.report.collect()}
    pieces = defaultdict(list)
    for r in sorted(found.messages.collect(), key=lambda r: r["piece"]):
        pieces[r["conv_id"]] += [(m["role"][:1], m["edit"], m["text"]) for m in r["messages"]]
    for i, out in pieces.items():
        roles = "".join(r for r, *_ in out).removeprefix("s")
        assert roles == "ua" * (len(roles) // 2) and "".join(e for _, e, _ in out) == audits[i].replace("D", "")
        assert all(x == "" for _, e, x in out if e == "I")


def test_damage_by_hand(spark):
    rows = [(k, t, "assistant", f"A! b. {k}?") for k in range(30) for t in (0, 1, None)] + [(None, None, None, None)]
    got = sorted(map(repr, (tuple(r) for r in c.damage(spark.createDataFrame(rows, TYPE)).collect())))
    expected = []
    for i, t, r, x in rows:
        r, x = r or " ", x or " "
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x
        expected.append((i, t, "user" if kind == 4 else r, text, kind == 0, 2 if kind == 3 else 1))
    assert got == sorted(map(repr, expected))


def test_conversations_without_turns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")], TYPE)
    got = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in c.digested(c.repair(rows, absent=F.col("conv_id") == 1)).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", sha([])), 2: (0, 0, 0, 0, 0, 0, "KK", sha([("user", "Hi."), ("assistant", "Yes.")]))}
    empty = c.digested(c.repair(spark.createDataFrame([], TYPE)))
    assert empty.count() == 0 and set(empty.columns) == {"conv_id", *COLUMNS}


def test_extra_columns_and_long_texts(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    extra = spark.createDataFrame(rows, TYPE).select("*", *[F.lit("x").alias(n) for n in ("key", "seq", "part", "ord", "copies", "absent", "block", "messages", "audit")])
    got = [tuple(r[k] for k in COLUMNS) for r in c.digested(c.repair(extra)).collect()]
    assert got == [report_by_hand([r[1:] for r in rows])] and got[0][6] == "KKD"
