"""Conversation structure repair (operator 12): the cheapest edits that make role initials read `(s?(ua)+)?`, by divide and conquer.

Rows of a conversation go by turn (nulls first), those of one turn by role and digest of text. Each row's first fault counts:
blank, duplicate (role and text seen earlier in the conversation) or truncated. Keep costs 0, Rerole to user or assistant 2,
Delete 3 (blank and duplicate rows must go), Insert of an empty user or assistant turn 2; a truncated row that stays adds 1.
Of the cheapest edits the audit is the one whose initials D, I, K, R come first in ASCII.

Four states are enough: nothing yet, or the last turn is the system's, the user's or the assistant's. Within a block a forward
vector of costs meets a backward one at the middle row; of the states with the least sum the one whose prefix has the least
audit is crossed, and both halves recurse, so a block needs its own rows and a few vectors. Edits that consume the same rows
are never prefixes of each other, which is why a rank of the four prefixes is all that ties need.

Conversations of any length are cut into blocks: rows are dealt by ranges of (conversation, turn, role, digest), so one hot
conversation fills many tasks; each block gives a four by four table of costs and ranks, a fold over a conversation's tables
finds the states at block ends, and each block then recurses on its own. Equal rows of one turn are one row with a number, and
rows that repeat across turns are found by a grouped minimum and a join.

Null roles and texts are read as one space, null conversations are one of their own, null turns come first. Empty texts are
blank, long ones are read whole, and an empty table gives an empty result. A row may say how often it counts (`copies`);
with 0 it only names its conversation. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, with_path

SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters of a block at most (one long row may be more).
BLOCK_ROWS, BLOCK_CHARS = 1 << 14, 1 << 22
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = (USER, USER, ASSISTANT, USER)
#: What ends a conversation after each state: inserts only.
TAIL = ("", "II", "I", "")
INF = 1 << 60
GONE = 8  # code of rows that must be deleted; others are 2 * (x, s, u, a) + truncated
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _steps(code: int) -> list[list[tuple[int, str] | None]]:
    """[from][to] -> cheapest (cost, initials) that consume one row of this code, inserts before it included."""
    kind, cut = code // 2, code % 2
    best: list[list] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        at = s
        for k in range(3):
            moves = [(at, 3, "D"), (AFTER_INSERT[at], 2 + cut, "R")]
            if (kind == 1 and at == START) or (kind == 2 and at != USER) or (kind == 3 and at == USER):
                moves.append((kind, cut, "K"))
            for to, cost, letter in moves:
                made = (2 * k + cost, "I" * k + letter)
                if best[s][to] is None or made < best[s][to]:
                    best[s][to] = made
            at = AFTER_INSERT[at]
    return best


_TABLE = [_steps(c) for c in range(GONE)]
_BY_END = [[[(s, *t[s][e]) for s in range(4) if t[s][e]] for e in range(4)] for t in _TABLE]
_BY_START = [[[(e, t[s][e][0]) for e in range(4) if t[s][e]] for s in range(4)] for t in _TABLE]


def forward(items: list[tuple[int, int]], lo: int, hi: int, cost: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the four states after rows lo to hi, and the order of their least audits."""
    for code, times in items[lo:hi]:
        if code == GONE:
            cost = [c + 3 * times for c in cost]
            continue
        new, keys = [], []
        for e in range(4):
            c, r, w = min(((cost[s] + step, rank[s], letters) for s, step, letters in _BY_END[code][e]), default=(INF, 9, ""))
            new.append(min(c, INF))
            keys.append((r, w))
        order = sorted(range(4), key=keys.__getitem__)
        cost, rank = new, [order.index(e) for e in range(4)]
    return cost, rank


def backward(items: list[tuple[int, int]], lo: int, hi: int, cost: list[int]) -> list[int]:
    for code, times in reversed(items[lo:hi]):
        if code == GONE:
            cost = [c + 3 * times for c in cost]
        else:
            cost = [min(INF, min(cost[e] + step for e, step in moves)) for moves in _BY_START[code]]
    return cost


def only(state: int) -> list[int]:
    return [0 if s == state else INF for s in range(4)]


TO_END = [2 * len(t) for t in TAIL]


def reconstruct(items: list[tuple[int, int]], start: int, end: list[int]) -> list[str]:
    """Initials of the edits of each row (inserts before it included), from a state to the ends' costs, meeting in the middle."""
    out: list[str] = []

    def part(lo: int, hi: int, s: int, end: list[int]) -> int:
        if hi - lo == 1:
            code, times = items[lo]
            if code == GONE:
                out.append("D" * times)
                return s
            _, w, e = min((step[0] + end[e], step[1], e) for e, step in enumerate(_TABLE[code][s]) if step)
            out.append(w)
            return e
        mid = (lo + hi) // 2
        there, rank = forward(items, lo, mid, only(s), [0] * 4)
        back = backward(items, mid, hi, end)
        x = min(range(4), key=lambda t: (there[t] + back[t], rank[t]))
        part(lo, mid, s, only(x))
        return part(mid, hi, x, end)

    if items:
        part(0, len(items), start, end)
    return out


def repaired(edits: list[str], tail: str, start: int, codes: list[tuple[int, int]], roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that the edits leave."""
    out, state = [], start
    for w, (code, _), role, text in zip(edits, codes, roles, texts):
        for c in w:
            if c == "D":
                break
            to = code // 2 if c == "K" else AFTER_INSERT[state]
            out.append({"role": role if c == "K" else _NAMES[to], "text": "" if c == "I" else text})
            state = to
    for _ in tail:
        state = AFTER_INSERT[state]
        out.append({"role": _NAMES[state], "text": ""})
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ["rows", "min_turn", "max_turn", "distinct_turns", "blank", "duplicate", "truncated", "illegal"]


def _schema(id_kind: str) -> str:
    return f"conv {id_kind}, place long, whole boolean, {', '.join(c + ' long' for c in _COUNTS)}, first_turn long, last_turn long, first_initial string, last_initial string, codes binary, times binary, roles array<string>, texts array<string>, cost long, audit string, turns array<struct<role:string,text:string>>"


class _Block:
    """Rows of one conversation while they are read."""

    def __init__(self, conv):
        self.conv, self.items, self.roles, self.texts, self.chars = conv, [], [], [], 0
        self.n = {c: 0 for c in _COUNTS} | {"min_turn": None, "max_turn": None}
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, again: bool, cut: bool) -> None:
        if not copies:
            return
        n, initial = self.n, role[:1]
        n["rows"] += copies
        if turn is not None and turn != self.last_turn:
            n["distinct_turns"] += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
            n["min_turn"], n["max_turn"] = turn if n["min_turn"] is None else n["min_turn"], turn
        if self.last_initial is None:
            self.first_initial = initial
        else:
            n["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        n["illegal"] += copies - 1  # a row beside its like
        self.last_initial = initial
        if blank or again:
            n["blank" if blank else "duplicate"] += copies
            self._put(GONE, copies, "", "")
            return
        n["truncated"] += cut
        self._put(2 * (" sua".find(initial) if initial in ("s", "u", "a") else 0) + cut, 1, role, text)
        if copies > 1:
            n["duplicate"] += copies - 1
            self._put(GONE, copies - 1, "", "")

    def _put(self, code: int, times: int, role: str, text: str) -> None:
        self.items.append((code, times))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, place: int, whole: bool) -> dict:
        out = {"conv": self.conv, "place": place, "whole": whole, **self.n, "first_turn": self.first_turn, "last_turn": self.last_turn, "first_initial": self.first_initial, "last_initial": self.last_initial}
        if whole:
            return out | _solved(self.items, START, None, self.roles, self.texts)
        return out | {"codes": bytes(c for c, _ in self.items), "times": np.array([t for _, t in self.items], dtype=np.int64).tobytes(), "roles": self.roles, "texts": self.texts}


def _solved(items: list[tuple[int, int]], start: int, end: int | None, roles: list[str], texts: list[str]) -> dict:
    """Cost, audit and turns of a block; end is None where the conversation ends."""
    edits = reconstruct(items, start, TO_END if end is None else only(end))
    state, tail = start, ""
    if end is None:
        for w, (code, _) in zip(edits, items):
            for c in w:
                state = state if c == "D" else code // 2 if c == "K" else AFTER_INSERT[state]
        tail = TAIL[state]
    audit = "".join(edits) + tail
    cost = 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + sum(code % 2 for w, (code, _) in zip(edits, items) if code != GONE and w[-1] != "D")
    return {"cost": cost, "audit": audit, "turns": repaired(edits, tail, start, items, roles, texts)}


def _blocks(rows: DataFrame, id_kind: str) -> DataFrame:
    """Rows in order -> blocks; a conversation that lies within one is solved at once."""
    block_rows, block_chars = BLOCK_ROWS, BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        out, held, now, edge = [], 0, None, True

        def put(block: _Block, whole: bool) -> None:
            nonlocal place, held
            out.append(block.row(place, whole))
            place, held = place + 1, held + block.chars + 100

        for b in batches:
            kind = b.schema.field("conv").type
            for conv, turn, role, text, copies, blank, again, cut in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        put(now, not edge)
                        edge = False
                    now = _Block(conv)
                elif len(now.items) >= block_rows or now.chars >= block_chars:
                    put(now, False)
                    now, edge = _Block(conv), True  # the rest of it is not a whole conversation either
                now.add(turn, role, text, copies, blank, again, cut)
            if held > block_chars:
                yield _batch(out, kind)
                out, held = [], 0
        if now is not None:
            put(now, False)
        if out:
            yield _batch(out, kind)

    return with_path(rows).mapInArrow(run, _schema(id_kind))


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    text, num = pa.string(), pa.int64()
    kinds = [("conv", kind), ("place", num), ("whole", pa.bool_()), *[(c, num) for c in _COUNTS], ("first_turn", num), ("last_turn", num), ("first_initial", text), ("last_initial", text), ("codes", pa.binary()), ("times", pa.binary()), ("roles", pa.list_(text)), ("texts", pa.list_(text)), ("cost", num), ("audit", text), ("turns", _TURNS)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _items(codes: bytes, times: bytes) -> list[tuple[int, int]]:
    return list(zip(codes, np.frombuffer(times, dtype=np.int64).tolist()))


def _tables(blocks: DataFrame) -> DataFrame:
    """For each open block: costs from each state to each, and the order of the least audits from a state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            costs, ranks = [], []
            for codes, times in zip(b.pop("codes"), b.pop("times")):
                items = _items(codes, times)
                made = [forward(items, 0, len(items), only(s), [0] * 4) for s in range(4)]
                costs.append([c for cost, _ in made for c in cost])
                ranks.append([r for _, rank in made for r in rank])
            yield b.assign(costs=costs, ranks=ranks)

    small = blocks.select("conv", "place", "rows", "first_turn", "last_turn", "first_initial", "last_initial", "codes", "times")
    kinds = ", ".join(f"{n} {t}" for n, t in small.dtypes if n not in ("codes", "times"))
    return with_path(small).mapInPandas(run, f"{kinds}, costs array<long>, ranks array<long>")


def _fold(b: pd.DataFrame) -> pd.DataFrame:
    """The states at the ends of a conversation's blocks. An audit is one string, so there are at most 2**31 / BLOCK_ROWS full blocks."""
    b = b.sort_values("place").reset_index(drop=True)
    cost, rank, parents = only(START), [0] * 4, []
    for c, r in zip(b["costs"], b["ranks"]):
        keys = []
        for e in range(4):
            s = min(range(4), key=lambda s: (cost[s] + int(c[4 * s + e]), rank[s]))
            keys.append((min(INF, cost[s] + int(c[4 * s + e])), (rank[s], int(r[4 * s + e])), s))
        parents.append([k[2] for k in keys])
        order = sorted(range(4), key=lambda e: keys[e][1])
        cost, rank = [k[0] for k in keys], [order.index(e) for e in range(4)]
    state = min(range(4), key=lambda e: (cost[e] + TO_END[e], rank[e]))
    starts, ends = [], []
    for p in reversed(parents):
        ends.append(state)
        state = p[state]
        starts.append(state)
    # what two blocks make together is counted at the later one
    more, fewer, turn, initial = [], [], None, None
    for n, t0, t1, i0, i1 in zip(b["rows"], b["first_turn"], b["last_turn"], b["first_initial"], b["last_initial"]):
        more.append(int(n > 0 and initial is not None and initial + i0 not in ("su", "ua", "au")))
        fewer.append(int(not pd.isna(t0) and turn is not None and turn == t0))
        if n:
            initial = i1
        if not pd.isna(t1):
            turn = t1
    # a block without rows at the end: the conversation ends after the last block all the same
    last = [False] * (len(b) - 1) + [True]
    return b[["conv", "place"]].assign(start=starts[::-1], stop=ends[::-1], last=last, of=len(b), more_illegal=more, fewer_turns=fewer)


def segments(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Repaired conversations, one row a block (`of` tells how many a conversation has, `place` their order).

    Columns: id_col, place, of, rows, min_turn, max_turn, distinct_turns, blank, duplicate, truncated, illegal, cost, audit, turns
    (role, text); counts, costs and turns of a conversation are the sums and the sequence of its blocks'.
    """
    spark, kind = rows.sparkSession, rows.select(id_col).schema[0].dataType.simpleString()
    copies = F.col(copies_col).cast("long") if copies_col else F.lit(1)
    lines = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(to) for c, to in ((role_col, "role"), (text_col, "text"))], F.coalesce(copies, F.lit(0)).alias("copies"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    key, order = F.sha2("text", 256), F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # texts that a conversation has in more than one turn, with the first of those
    seen = lines.where((F.col("copies") > 0) & (end != "")).groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), key.alias("k")).agg(F.min(order).alias("first"), F.max(order).alias("final")).where("NOT first <=> final").drop("final")
    one = lines.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    marked = one.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = marked.select("conv", "turn", "role", "text", "copies", (end == "").alias("blank"), F.coalesce(order > F.col("first"), F.lit(False)).alias("again"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), "key").repartitionByRange(parts, "conv", "turn", "role", "key").sortWithinPartitions("conv", "turn", "role", "key").drop("key")
    at = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    made = _blocks(dealt, kind)
    made.write.parquet(at)
    blocks = spark.read.schema(made.schema).parquet(at)
    out = [F.col("conv").alias(id_col), "place", "of", *_COUNTS, "cost", "audit", "turns"]
    solved = blocks.where("whole").withColumn("of", F.lit(1).cast("long")).select(*out)
    opened = blocks.where("NOT whole")
    ends = _tables(opened).groupBy("conv").applyInPandas(_fold, f"conv {kind}, place long, start int, stop int, last boolean, of long, more_illegal long, fewer_turns long")
    both = opened.join(ends.drop("conv"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 16) for x in batches for i in range(0, x.num_rows, 16)):
            rows = []
            for r in b.to_pylist():
                r |= _solved(_items(r["codes"], r["times"]), r["start"], None if r["last"] else r["stop"], r["roles"], r["texts"])
                r["illegal"] += r["more_illegal"]
                r["distinct_turns"] -= r["fewer_turns"]
                rows.append({k: r[k] for k in ("conv", "place", "of", *_COUNTS, "cost", "audit", "turns")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv", b.schema.field("conv").type), ("place", pa.int64()), ("of", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("turns", _TURNS)]))

    joined = with_path(both).mapInArrow(run, f"conv {kind}, place long, of long, {', '.join(c + ' long' for c in _COUNTS)}, cost long, audit string, turns array<struct<role:string,text:string>>")
    return solved.unionByName(joined.withColumnRenamed("conv", id_col))


def digests(found: DataFrame) -> DataFrame:
    """One row a conversation of `segments`: gaps, counts, cost, audit and the SHA-256 of the repaired `role:text` lines.

    A digest of a text is taken from its start to its end, so blocks of one conversation meet in one task, one at a time."""
    conv = found.columns[0]
    line = lambda x: F.concat(x.role, F.lit(":"), x.text)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    single = found.where("of = 1").select(conv, gaps.alias("gaps"), *counts, "audit", F.sha2(F.concat_ws("\n", F.transform("turns", line)), 256).alias("repaired_sha256"))
    kind = found.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def done() -> pa.RecordBatch:
            known = now["min"] is not None
            row = {conv: now["conv"], "gaps": now["max"] - now["min"] + 1 - now["distinct"] if known else 0, **{c: now[c] for c in counts}, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(conv, kind), ("gaps", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        for b in (x.slice(i, 4) for x in batches for i in range(0, x.num_rows, 4)):
            kind = b.schema.field(0).type
            for r in b.to_pylist():
                if now is None or r[conv] != now["conv"]:
                    if now is not None:
                        yield done()
                    now = {"conv": r[conv], "min": None, "max": None, "distinct": 0, "audit": [], "sha": hashlib.sha256(), "any": False} | {c: 0 for c in counts}
                if r["min_turn"] is not None:
                    now["min"] = r["min_turn"] if now["min"] is None else min(now["min"], r["min_turn"])
                    now["max"] = r["max_turn"] if now["max"] is None else max(now["max"], r["max_turn"])
                now["distinct"] += r["distinct_turns"]
                for c in counts:
                    now[c] += r[c]
                now["audit"].append(r["audit"])
                for t in r["turns"]:
                    now["sha"].update((("\n" if now["any"] else "") + t["role"] + ":" + t["text"]).encode())
                    now["any"] = True
        if now is not None:
            yield done()

    several = found.where("of > 1").repartition(conv).sortWithinPartitions(conv, "place")
    return single.unionByName(with_path(several).mapInArrow(run, f"`{conv}` {kind}, gaps long, {', '.join(c + ' long' for c in counts)}, audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated and given to the user by crc32 of `conv_id:turn`; dropped ones stay with 0 copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    gone = F.col("fate") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def oracle() -> str:
    """The query's rows over the table conversations, for DuckDB: all four states with their least audits, row by row."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    to = "[2, 2, 3, 2]"
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
fate AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS f FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), tab),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again FROM fate WHERE f <> 0),
ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i, rtrim(text, {spaces}) AS trimmed FROM dam),
flt AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1] AS ini, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN trimmed[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM ord),
adj AS (SELECT *, coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM flt),
num AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, max(i) AS n FROM adj GROUP BY conv_id),
walk(conv_id, i, st, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM num
  UNION ALL
  SELECT conv_id, i, st, (b).cost, (b).audit, (b).lines FROM (
    SELECT conv_id, i, st, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS b FROM (
      SELECT m.conv_id, m.i, CASE act WHEN 'D' THEN pos WHEN 'R' THEN {to}[pos + 1] ELSE list_position(['s', 'u', 'a'], ini) END AS st,
        cost + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 + cut ELSE cut END AS cost, audit || act AS audit,
        CASE act WHEN 'D' THEN lines ELSE list_append(lines, CASE act WHEN 'K' THEN role ELSE ['user', 'assistant'][{to}[pos + 1] - 1] END || ':' || text) END AS lines
      FROM (SELECT w.conv_id, f.i, f.role, f.text, f.ini, f.fault, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS cut,
          CASE k WHEN 0 THEN st WHEN 1 THEN {to}[st + 1] ELSE {to}[{to}[st + 1] + 1] END AS pos, w.cost + 2 * k AS cost, w.audit || repeat('I', k) AS audit,
          CASE k WHEN 0 THEN lines WHEN 1 THEN list_append(lines, ['user:', 'assistant:'][{to}[st + 1] - 1]) ELSE list_concat(lines, [['user:', 'assistant:'][{to}[st + 1] - 1], ['user:', 'assistant:'][{to}[{to}[st + 1] + 1] - 1]]) END AS lines
        FROM walk w JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1, range(3) ks(k)) m, unnest(['D', 'K', 'R']) acts(act)
      WHERE act = 'D' OR (m.fault IN ('none', 'truncated') AND (act = 'R' OR (ini = 's' AND pos = 0) OR (ini = 'u' AND pos <> 2) OR (ini = 'a' AND pos = 2))))
    GROUP BY conv_id, i, st)),
fin AS (SELECT w.conv_id, min({{'cost': w.cost + [0, 4, 2, 0][st + 1], 'audit': w.audit || ['', 'II', 'I', ''][st + 1], 'lines': list_concat(w.lines, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS b FROM walk w JOIN num ON num.conv_id IS NOT DISTINCT FROM w.conv_id AND num.n = w.i GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce((b).cost, 0)::BIGINT AS cost, coalesce((b).audit, '') AS audit, sha256(coalesce(array_to_string((b).lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN num ON num.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id"""
