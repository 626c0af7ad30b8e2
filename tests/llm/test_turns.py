"""Conversation repair against plain search over all edits, and against the SQL."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.llm import queries, turns
from tests.oracle import same

KIND = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def in_order(rows):
    """A conversation's rows as the operator takes them."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACES)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, lines) by carrying the best of every state, whole audits and all."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, w, lines) in list(out.items()):
                made = (c + 2, w + "I", lines + (name[after[s]] + ":",))
                out[after[s]] = min(out.get(after[s], made), made)
        return out

    for (_, _, role, text), fault in zip(rows, found):
        new = {}
        # every number of inserts is tried from every state, not only the best of them
        for s, (c, w, lines) in states.items():
            at = s
            for k in range(4):
                moves = [(at, 3, "D", ())]
                if fault in ("none", "truncated"):
                    cut = int(fault == "truncated")
                    moves.append((after[at], 2 + cut, "R", (f"{name[after[at]]}:{text}",)))
                    if role[:1] == after[at] or (role[:1] == "s" and at == ""):
                        moves.append((role[:1], cut, "K", (f"{role}:{text}",)))
                for to, cost, letter, more in moves:
                    made = (c + 2 * k + cost, w + "I" * k + letter, lines + more)
                    new[to] = min(new.get(to, made), made)
                at = after[at]
                lines += (name[at] + ":",)
        states = new
    done = inserted(states)
    return min(done[s] for s in ("", "a") if s in done)


def conversation(rng, conv, n):
    text = lambda: rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why? ", "naïve…", "long " * 30 + "end."])
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, rng.choice(["user", "assistant", "system", "tool", "", None, "sudo"] if rng.random() < 0.5 else ["user", "assistant"]), rng.choice([None, text()]) if rng.random() < 0.1 else text()) for i in range(n)]


def summary(rows):
    rows = in_order(rows)
    found, known = faults(rows), [t for _, t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(rows, found)
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("block", [1 << 14, 3, 1])
def test_repair_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [r for c in range(60) for r in conversation(rng, None if c == 7 else c, rng.choice([0, 1, 2, 5, 9, 40]))]
    rows += rows[:30]
    d = spark.createDataFrame(rows, KIND).repartition(5).withColumns({"copies": F.lit(0), "place": F.lit("x"), "k": F.lit(1)})
    got = {r[0]: tuple(r)[1:] for r in turns.digests(turns.segments(d)).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == summary([r for r in rows if r[0] == conv]), conv
    assert len(got) == len({r[0] for r in rows})


def test_turns_come_out_as_text(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "And"), (1, 3, "user", "And"), (2, 0, "user", " ")]
    found = sorted(turns.segments(spark.createDataFrame(rows, KIND)).collect(), key=lambda r: (r.conv_id, r.place))
    assert ["".join(r.audit for r in found if r.conv_id == c) for c in (1, 2)] == ["KIKDD", "D"]  # as cheap as KIKKDI
    assert [(t.role, t.text) for r in found if r.conv_id == 1 for t in r.turns] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]


def test_empty_and_hot_conversation(spark):
    none = spark.createDataFrame([], KIND)
    assert turns.digests(turns.segments(turns.damaged(none), copies_col="copies")).count() == 0
    hot = [(5, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(5, 3, "assistant", "line 3.")] * 500
    found = turns.segments(spark.createDataFrame(hot, KIND).repartition(8))
    assert found.count() > 1  # several ranges hold it
    r = turns.digests(found).collect()
    assert len(r) == 1 and (r[0].duplicate, r[0].cost, r[0].gaps, r[0].audit) == (500, 1500, 0, "K" * 4 + "D" * 500 + "K" * 2996)


def test_very_long_text(spark):
    long = "word " * 2_000_000 + "end."
    r = turns.digests(turns.segments(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", long)], KIND))).collect()
    assert [(x.duplicate, x.audit, x.repaired_sha256) for x in r] == [(1, "KKD", hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest())]


def test_query_equals_its_sql(spark, tmp_path):
    assert same(spark, queries.op12_turn_repair, turns.oracle()) > 0
    rng = random.Random(9)
    rows = [r for c in range(200) for r in conversation(rng, c, rng.choice([1, 3, 6]))] + [(776, None, None, None), (776, 3, "user", "a."), (777, 0, "user", "x")]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    assert same(spark, queries.op12_turn_repair, turns.oracle(), str(tmp_path)) == 202
