"""Conversation structure repair: A* on the edit lattice.

A conversation is a list of turns; its roles' initials should read ``(s?(ua)+)?``.
Every turn has at most one fault, the first of *blank* (no character other than
space and ``\\t\\n\\v\\f\\r``), *duplicate* (role and text seen earlier) and
*truncated* (the last such character is none of ``.!?``).  A repair edits the turns
in order: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty
turn of user or assistant, anywhere) 3.  Blank and duplicate turns have to be
deleted, truncated ones that stay cost 3 more.  The cheapest repair is searched by
A*: a node is (turns consumed, role written last), the heuristic adds up what no
repair of the remaining turns can avoid (4 for each deletion that is due, 3 for each
truncated turn, which costs no less whatever becomes of it), and the queue is keyed
(cost plus heuristic, audit), the audit being the edits' initials.  The prefix of an
audit settles the node it leads to, so the first goal taken off the queue is the
cheapest repair with the ASCII-least audit.

Turns are counted by equal (conversation, turn, role, text) first, sorted by range
and walked partition by partition.  A conversation that lies within a partition and
has at most ``BLOCK`` turns is solved there.  Others (at most two in a partition, and
the long ones) are cut into pieces of ``BLOCK`` turns; each piece is searched from
each of the four roles that may stand before it, and the results, tables of (role
before, role after), are combined in a tree of fan-in ``FAN``, which gives exactly
the repair of the whole: pieces of a cheapest repair are cheapest themselves, and so
are their audits.  So no task holds a long conversation.

Defined results: conversation, turn, role and text may be null; a null role or text
counts as one space, null turns come first, a null id is a conversation of its own.
Turns of one number are ordered by role and text; equal rows are copies, of which
all but the first are duplicates.  An initial is the first character of the role,
empty for an empty one; roles are compared as they are.  Texts of any length are
looked at whole.  A conversation without turns (``absent`` rows only) gets zeros, an
empty audit and no messages.  An empty table gives empty results; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.llm.common import materialize, small_batches

BLOCK = 512
BLOCK_CHARS = 4 << 20
FAN = 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: The role written last, as a node has it: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: What a turn of a chosen role leads to, and what the initials of kept turns lead to.
WRITES = (USER, USER, ASSISTANT, USER)
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (NONE, ASSISTANT)
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MESSAGES = pa.list_(pa.struct([(c, pa.string()) for c in ("role", "text", "edit", "turn")]))


def _schema(text: str = "", number: str = "", **others: pa.DataType) -> pa.Schema:
    """Columns of text and of whole numbers, by name, then others."""
    return pa.schema([*((c, pa.string()) for c in text.split()), *((c, pa.int64()) for c in number.split()), *others.items()])


_COUNTED = "low high distinct blank duplicate truncated illegal"
WALKED = _schema("key turn role text audit", f"part ord copies {' '.join(COUNTS)}", open=pa.bool_(), messages=MESSAGES)
TABLE = _schema("key first last", f"seq {_COUNTED}", costs=pa.list_(pa.int64()), audits=pa.list_(pa.string()), ways=pa.list_(pa.string()))
REPORT = _schema("key audit ways", " ".join(COUNTS))
PIECES = _schema("key", "piece", messages=MESSAGES)
HASHES = _schema("key repaired_sha256")


@dataclass
class Turn:
    initial: str
    fault: str
    copies: int = 1
    turn: str | None = None
    role: str = ""
    text: str = ""


def fault(role: str, text: str, seen: bool) -> str:
    solid = text.rstrip(SPACES)
    if not solid:
        return "blank"
    return "duplicate" if seen else "" if solid[-1] in ".!?" else "truncated"


def search(turns: list[Turn], before: int, goals: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """A* from the role ``before``: {role after: (cost, audit)}, for all roles that can be reached, or for the best of ``goals`` alone."""
    rest = [0] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        due = DELETE if turns[i].fault in ("blank", "duplicate") else TRUNCATED if turns[i].fault == "truncated" else 0
        rest[i] = rest[i + 1] + due + DELETE * (turns[i].copies - 1)
    found: dict[int, tuple[int, str]] = {}
    done: set[tuple[int, int]] = set()
    queue = [(rest[0], "", 0, before)]
    while queue:
        total, audit, i, last = heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and (goals is None or last in goals):
            found[last] = (total, audit)
            if goals:
                return found
        spent = total - rest[i]
        heappush(queue, (total + INSERT, audit + "I", i, WRITES[last]))
        if i == len(turns):
            continue
        at = turns[i]
        # later copies have to go; deleted right away they give the least audit
        copies, ahead = "D" * (at.copies - 1), spent + DELETE * (at.copies - 1) + rest[i + 1]
        heappush(queue, (ahead + DELETE, audit + "D" + copies, i + 1, last))
        if at.fault in ("", "truncated"):
            charge = TRUNCATED if at.fault else 0
            if at.initial in KEEPS[last]:
                heappush(queue, (ahead + charge, audit + "K" + copies, i + 1, KEEPS[last][at.initial]))
            heappush(queue, (ahead + charge + REROLE, audit + "R" + copies, i + 1, WRITES[last]))
    return found


def apply(turns: list[Turn], audit: str, before: int) -> list[dict]:
    """The messages that an audit makes of ``turns``."""
    out, last, at = [], before, 0

    def written(text: str, edit: str, turn: str | None) -> None:
        nonlocal last
        last = WRITES[last]
        out.append({"role": NAMES[last], "text": text, "edit": edit, "turn": turn})

    for turn in turns:
        while audit[at] == "I":
            written("", "I", None)
            at += 1
        if audit[at] == "K":
            last = KEEPS[last][turn.initial]
            out.append({"role": turn.role, "text": turn.text, "edit": "K", "turn": turn.turn})
        elif audit[at] == "R":
            written(turn.text, "R", turn.turn)
        at += turn.copies
    for _ in audit[at:]:
        written("", "I", None)
    return out


def tally(turns: list[Turn]) -> dict:
    """Counts of faults and illegal neighbours, and the span of turn numbers."""
    numbers = [int(t.turn) for t in turns if t.turn is not None]
    out = {"low": min(numbers, default=None), "high": max(numbers, default=None), "distinct": len(set(numbers)), "first": None, "last": None}
    out |= {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for t in turns:
        if t.fault:
            out[t.fault] += 1
        out["blank" if t.fault == "blank" else "duplicate"] += t.copies - 1
        out["illegal"] += t.copies - 1 + (out["last"] is not None and out["last"] + t.initial not in LEGAL)
        out["first"] = t.initial if out["first"] is None else out["first"]
        out["last"] = t.initial
    return out


def join_tallies(a: dict, b: dict) -> dict:
    """The tally of two stretches in a row; turn numbers rise, so they share one at most."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in LEGAL
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    out["first"] = b["first"] if a["first"] is None else a["first"]
    out["last"] = a["last"] if b["last"] is None else b["last"]
    return out


def gaps(t: dict) -> int:
    return 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["distinct"]


# -- conversations within a partition ----------------------------------------


def _solved(key: str | None, rows: list[tuple]) -> dict:
    seen, turns = set(), []
    for turn, role, text, copies in rows:
        if copies:
            turns.append(Turn(role[:1], fault(role, text, (role, text) in seen), copies, turn, role, text))
            seen.add((role, text))
    (cost, audit) = next(iter(search(turns, NONE, ENDS).values()))
    t = tally(turns)
    counts = {c: t[c] for c in ("blank", "duplicate", "truncated", "illegal")}
    return {"key": key, "open": False, "gaps": gaps(t), "cost": cost, "audit": audit, "messages": apply(turns, audit, NONE)} | counts


def _walk(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: solved conversations, and the rows of those that go on elsewhere or are long."""
    part, out, chars = TaskContext.get().partitionId(), [], 0
    held: list[tuple] = []
    size = number = 0
    now: str | None = None
    first, begun, spread = True, False, False

    def emit(row: dict, weight: int) -> Iterator[pa.RecordBatch]:
        nonlocal out, chars
        out.append(row)
        chars += weight
        if len(out) >= 1000 or chars >= BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(out, WALKED)
            out, chars = [], 0

    def let_go() -> Iterator[pa.RecordBatch]:
        nonlocal number, held, size
        for turn, role, text, copies in held:
            yield from emit({"key": now, "open": True, "part": part, "ord": number, "turn": turn, "role": role, "text": text, "copies": copies}, len(text))
            number += 1
        held, size = [], 0

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if not begun or row[0] != now:
                if begun:
                    if spread or first:
                        yield from let_go()
                    else:
                        yield from emit(_solved(now, held), size)
                    first = False
                now, held, size, number, begun, spread = row[0], [], 0, 0, True, False
            held.append(row[1:])
            size += len(row[3])
            if len(held) > block or size > BLOCK_CHARS or row[4] > block:
                spread = True
                yield from let_go()
    if begun:
        yield from let_go()  # it may go on in the next partition
    if out:
        yield pa.RecordBatch.from_pylist(out, WALKED)


# -- long ones, in pieces -----------------------------------------------------


_TALLY = ("first", "last", *_COUNTED.split())


def _piece(table: pa.Table) -> pa.Table:
    """The table of one piece: its cheapest audits for each (role before, role after)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
    turns = [Turn(r["initial"], r["fault"], r["copies"], r["turn"]) for r in rows if r["copies"]]
    costs, audits, ways = [None] * 16, [None] * 16, [None] * 16
    for before in range(4):
        for after, (cost, audit) in search(turns, before).items():
            costs[4 * before + after], audits[4 * before + after], ways[4 * before + after] = cost, audit, str(after)
    made = {"key": rows[0]["key"], "seq": rows[0]["seq"], "costs": costs, "audits": audits, "ways": ways} | tally(turns)
    return pa.Table.from_pylist([made], TABLE)


def _combined(table: pa.Table, fan: int) -> pa.Table:
    """Neighbouring pieces as one: of all roles in between the cheapest, then the ASCII-least."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    total = rows[0]
    for row in rows[1:]:
        best: list = [None] * 16
        for before in range(4):
            for middle in range(4):
                left = 4 * before + middle
                if total["costs"][left] is None:
                    continue
                for after in range(4):
                    right = 4 * middle + after
                    if row["costs"][right] is None:
                        continue
                    way = (total["costs"][left] + row["costs"][right], total["audits"][left] + row["audits"][right], total["ways"][left] + row["ways"][right])
                    if best[4 * before + after] is None or way < best[4 * before + after]:
                        best[4 * before + after] = way
        joined = join_tallies({k: total[k] for k in _TALLY}, {k: row[k] for k in _TALLY})
        total = {"key": total["key"], "seq": total["seq"]} | joined | {name: [None if b is None else b[k] for b in best] for k, name in enumerate(("costs", "audits", "ways"))}
    return pa.Table.from_pylist([total | {"seq": total["seq"] // fan}], TABLE)


def _best(table: pa.RecordBatch) -> list[dict]:
    out = []
    for row in table.to_pylist():
        cost, audit, ways = min((row["costs"][e], row["audits"][e], row["ways"][e]) for e in ENDS if row["costs"][e] is not None)
        out.append({"key": row["key"], "gaps": gaps(row), "cost": cost, "audit": audit, "ways": ways} | {c: row[c] for c in COUNTS[1:5]})
    return out


def _messages(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
    turns = [Turn(r["role"][:1], "", r["copies"], r["turn"], r["role"], r["text"]) for r in rows if r["copies"]]
    made = {"key": rows[0]["key"], "piece": rows[0]["seq"], "messages": apply(turns, rows[0]["audit"], rows[0]["before"])}
    return pa.Table.from_pylist([made], PIECES)


@dataclass
class Repaired:
    """``report``: a row per conversation, (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    ``messages``: (conv_id, piece, messages), the repaired turns in order with the
    edit and the turn number behind each.  ``whole`` has report and messages of the
    conversations that are one piece; the others are in ``long_report`` and
    ``long_messages``.
    """

    whole: DataFrame
    long_report: DataFrame
    long_messages: DataFrame

    @property
    def report(self) -> DataFrame:
        return self.whole.drop("messages").unionByName(self.long_report)

    @property
    def messages(self) -> DataFrame:
        return self.whole.select("conv_id", F.lit(0).cast("long").alias("piece"), "messages").unionByName(self.long_messages)


def repair(rows: DataFrame, absent: Column | None = None, copies: Column | None = None, block: int = BLOCK, fan: int = FAN) -> Repaired:
    """Repair the conversations of ``rows`` (conv_id, turn, role, text).

    Rows for which ``absent`` holds name their conversation and are no turns;
    ``copies`` says how many equal turns a row stands for.
    """
    small_batches(rows.sparkSession)
    kept = F.lit(1) if absent is None else F.when(absent, 0).otherwise(1)
    blank_if_absent = lambda c: F.when(kept == 1, F.coalesce(F.col(c), F.lit(" "))).otherwise("")
    wanted = rows.select(
        "conv_id", F.when(kept == 1, F.col("turn")).alias("turn"), blank_if_absent("role").alias("role"), blank_if_absent("text").alias("text"),
        (kept * (F.lit(1) if copies is None else copies)).cast("long").alias("copies"),
    )
    # copies of a turn become a number before they meet in a task
    counted = wanted.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    columns = [F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text", "copies"]
    walked = materialize(dealt.select(*columns).mapInArrow(lambda batches: _walk(block, batches), from_arrow_schema(WALKED)), "turns")
    report, pieces = _long(walked.filter("open"), block, fan)
    back = F.col("key").cast(rows.schema["conv_id"].dataType).alias("conv_id")
    told = [*COUNTS, "audit"]
    return Repaired(walked.filter("NOT open").select(back, *told, "messages"), report.select(back, *told), pieces.select(back, "piece", "messages"))


def _long(rows: DataFrame, block: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Report and messages of the conversations that lie in several pieces."""
    place = F.struct("part", "ord")
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    plain = F.when(solid == "", "blank").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    facts = rows.select(
        "key", "part", "ord", F.floor(F.col("ord") / block).alias("block"), "turn", "copies", F.substring("role", 1, 1).alias("initial"), plain.alias("fault"), said.alias("said")
    )
    facts = materialize(facts, "facts")
    # numbers of the pieces, and of each saying that comes up again the first place
    numbered = facts.select("key", "part", "block").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("part", "block")).cast("long") - 1)
    numbered = materialize(numbered, "pieces")
    again = facts.filter("copies > 0").groupBy("key", "said").agg(F.min(place).alias("begun"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "said", "begun")
    same = (F.col("key").eqNullSafe(F.col("k"))) & (facts["said"] == again["said"])
    marked = facts.join(again, same, "left").select("key", "part", "block", "ord", "turn", "copies", "initial", F.when((F.col("fault") != "blank") & (place != F.col("begun")), "duplicate").otherwise(F.col("fault")).alias("fault"))
    at = lambda df: df.join(numbered.select(F.col("key").alias("k"), F.col("part").alias("p"), F.col("block").alias("b"), "seq"), (F.col("key").eqNullSafe(F.col("k"))) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).drop("k", "p", "b")
    tables = materialize(at(marked).groupBy("key", "seq").applyInArrow(_piece, from_arrow_schema(TABLE)), "tables")
    most = numbered.agg(F.max("seq")).first()[0]
    total = tables
    while most is not None and most > 0:
        total = materialize(total.groupBy("key", F.floor(F.col("seq") / fan).alias("group")).applyInArrow(lambda table: _combined(table, fan), from_arrow_schema(TABLE)), "tables")
        most //= fan
    report = materialize(total.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist(_best(b), REPORT) for b in batches), from_arrow_schema(REPORT)), "report")
    # the audit of each piece: the entry of its table for the roles that stand before and after it
    steps = report.select(F.col("key").alias("k"), F.posexplode(F.split("ways", "")).alias("s", "after"), "ways").filter("after != ''")
    steps = steps.withColumn("before", F.when(F.col("s") == 0, 0).otherwise(F.substring("ways", F.col("s"), F.lit(1)).cast("int"))).withColumn("after", F.col("after").cast("int"))
    audits = tables.join(steps, F.col("key").eqNullSafe(F.col("k")) & (F.col("seq") == F.col("s"))).select("key", "seq", "before", F.expr("audits[4 * before + after]").alias("audit"))
    cut = at(rows.withColumn("block", F.floor(F.col("ord") / block)))
    audits = audits.select(F.col("key").alias("k"), F.col("seq").alias("q"), "before", F.col("audit").alias("piece_audit"))
    joined = cut.select("key", "seq", "ord", "turn", "role", "text", "copies").join(audits, F.col("key").eqNullSafe(F.col("k")) & (F.col("seq") == F.col("q")))
    joined = joined.select("key", "seq", "ord", "turn", "role", "text", "copies", "before", F.col("piece_audit").alias("audit"))
    return report, joined.groupBy("key", "seq").applyInArrow(_messages, from_arrow_schema(PIECES))


# -- what the query asks for --------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults, dealt by crc32 of ``conv_id:turn`` modulo 20; adds ``absent`` and ``copies``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = text_of("role"), text_of("text")
    dealt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("kind"))
    return dealt.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("absent"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def lines(messages: Column) -> Column:
    """Messages as ``role:text`` lines."""
    return F.concat_ws("\n", F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])))


def digested(repaired: Repaired) -> DataFrame:
    """The report with ``repaired_sha256``, the SHA-256 of the repaired turns' lines.

    Each piece of a long conversation becomes one text first; they are hashed in
    order as they come, none is held.
    """
    whole = repaired.whole.withColumn("repaired_sha256", F.sha2(lines(F.col("messages")).cast("binary"), 256)).drop("messages")
    kind = whole.schema["conv_id"].dataType
    texts = repaired.long_messages.select(F.col("conv_id").cast("string").alias("key"), "piece", F.size("messages").alias("n"), lines(F.col("messages")).alias("lines"))
    hashed = texts.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_hashed, from_arrow_schema(HASHES))
    hashed = hashed.select(F.col("key").cast(kind).alias("k"), "repaired_sha256")
    return whole.unionByName(repaired.long_report.join(hashed, F.col("conv_id").eqNullSafe(F.col("k"))).drop("k"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, lines, begun = None, hashlib.sha256(), 0, False
    for batch in batches:
        out = []
        for key, _, n, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not begun or key != now:
                if begun:
                    out.append({"key": now, "repaired_sha256": state.hexdigest()})
                now, state, lines, begun = key, hashlib.sha256(), 0, True
            if n:
                state.update((("\n" if lines else "") + text).encode())
                lines += n
        yield pa.RecordBatch.from_pylist(out, HASHES)
    if begun:
        yield pa.RecordBatch.from_pylist([{"key": now, "repaired_sha256": state.hexdigest()}], HASHES)
