"""Paths found in blocks of node ids against all simple paths, and by rounds where blocks do not hold them."""

import random

import pytest

from hazegrid.operators import routing


def simple_paths(edges: dict, source: int, target: int) -> list[tuple[float, list]]:
    found, stack = [], [(0.0, [source])]
    while stack:
        cost, path = stack.pop()
        if path[-1] == target:
            found.append((cost, path))
            continue
        stack += [(cost + w, [*path, v]) for (u, v), w in edges.items() if u == path[-1] and v not in path]
    return sorted(found)


@pytest.mark.parametrize("bits", [3, 14])
def test_paths_by_blocks(spark, bits):
    r = random.Random(5)
    edges = {(u, (u + s) % 14): float(r.randint(1, 4)) for u in range(14) for s in r.sample(range(1, 6), 2)}
    asked = [(i, r.randrange(14), r.randrange(14)) for i in range(25)] + [(90, 3, 400), (91, 6, 6)]
    e = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()] + [(0, 1, 9.0), (0, 1, edges.get((0, 1), 8.0))], "u long, v long, w double")
    edges.setdefault((0, 1), 8.0)
    q = spark.createDataFrame(asked, "request_id long, source long, target long")
    want = {i: simple_paths(edges, s, t) for i, s, t in asked}
    got = {x.request_id: (x.cost, x.path) for x in routing.shortest(q, e, bits).collect()}
    assert got.keys() == {i for i, p in want.items() if p}
    assert all(got[i][0] == want[i][0][0] and got[i] in want[i] for i in got)
    some = {}
    for x in routing.k_paths(q, e, 3, 1.0, bits).orderBy("rank").collect():
        some.setdefault(x.request_id, []).append((x.cost, x.path))
    assert some.keys() == got.keys()
    assert all([c for c, _ in some[i]] == [c for c, _ in want[i][:3]] and all(p in want[i] for p in some[i]) and len({tuple(p) for _, p in some[i]}) == len(some[i]) for i in some)


@pytest.mark.parametrize("bits", [1, 14])
def test_a_dear_detour_is_found(spark, bits):
    """Twice the slack without more nodes does not mean that there are none."""
    e = spark.createDataFrame([(1, 5, 1.0), (1, 9, 10.0), (9, 5, 1.0)], "u long, v long, w double")
    q = spark.createDataFrame([(1, 1, 5)], "request_id long, source long, target long")
    assert [(x.cost, x.path) for x in routing.k_paths(q, e, 3, 4.0, bits).orderBy("rank").collect()] == [(1.0, [1, 5]), (11.0, [1, 9, 5])]


def test_few_requests_leave_their_blocks(spark, monkeypatch):
    """Where neighbours have near ids, no request goes through the rounds, whose tables hold every request's nodes."""
    monkeypatch.setattr(routing, "_reach", lambda *a: pytest.fail("rounds over all edges"))
    e = spark.range(4000).selectExpr("id u", "explode(sequence(id + 1, id + 9)) v").selectExpr("u", "v", "double(1 + v % 3) w")
    q = spark.range(300).selectExpr("id request_id", "id * 13 source", "id * 13 + 30 target")
    assert routing.shortest(q, e, 9).count() == 300
    assert routing.k_paths(q, e, 3, 4.0, 9).count() == 900
