"""Batch routing: least summed toxicity for many requests at once, and sums along paths."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.scratch import Rounds, with_package

#: Nodes of a block are 2^BITS consecutive ids; so many of its requests meet its edges in one group.
BITS, REQUESTS = 14, 2**14
INF = float("inf")


def plain(edges: DataFrame) -> DataFrame:
    """One edge (u, v, w) for all parallel ones: the cheapest."""
    return edges.where("u is not null and v is not null and w is not null").groupBy("u", "v").agg(F.min("w").cast("double").alias("w"))


def adjacency(u: list, v: list, w: list) -> tuple[dict, dict]:
    """Edges into each node, [(w, u)] with the cheapest first, and out of it, {v: w}."""
    into, out = {}, {}
    for a, b, c in zip(u, v, w):
        into.setdefault(b, []).append((c, a))
        out.setdefault(a, {})[b] = c
    for e in into.values():
        e.sort()
    return into, out


def towards(into: dict, lo: float, hi: float, source: int, target: int, slack: float | None) -> tuple[dict, dict, bool] | None:
    """Least costs to the target of the nodes within `slack` of the source's (None: up to the source), the node after each,
    and whether these are all nodes there are. None if a node outside lo..hi, whose edges are not at hand, is among them."""
    cost, after, best, heap, top, whole = {}, {}, {target: 0.0}, [(0.0, target)], INF, True
    while heap:
        d, n = heapq.heappop(heap)
        if n in cost:
            continue
        if d > top:
            return cost, after, False
        if not lo <= n < hi:
            return None
        cost[n] = d
        if n == source:
            if slack is None:
                break
            top = d + slack
        for w, u in into.get(n, ()):
            if d + w > top:
                whole = False
                break
            if d + w < best.get(u, INF):
                best[u], after[u] = d + w, n
                heapq.heappush(heap, (d + w, u))
    return cost, after, whole


def k_cheapest(out: dict, left: dict, source: int, target: int, k: int) -> list[tuple[float, list]]:
    """Yen's k cheapest simple paths (cost, path) over the nodes of `left`, whose least costs to the target lead each search."""

    def cheapest(start: int, banned_nodes: set, banned_edges: set) -> tuple[float, list] | None:
        heap, done = [(left[start], [start], 0.0)], set()
        while heap:
            _, path, cost = heapq.heappop(heap)
            n = path[-1]
            if n == target:
                return cost, path
            if n in done:
                continue
            done.add(n)
            for v, w in out.get(n, {}).items():
                if v in left and v not in done and v not in banned_nodes and (n, v) not in banned_edges:
                    heapq.heappush(heap, (cost + w + left[v], [*path, v], cost + w))
        return None

    found, spare = [], []
    if source in left and (first := cheapest(source, set(), set())):
        found.append(first)
    while found and len(found) < k:
        _, last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1}
            if tail := cheapest(root[-1], set(root[:-1]), banned):
                whole = (sum(out[a][b] for a, b in zip(root, root[1:])) + tail[0], root[:-1] + tail[1])
                if whole not in spare and whole not in found:
                    spare.append(whole)
        if not spare:
            break
        spare.sort()
        found.append(spare.pop(0))
    return found


def in_blocks(requests: DataFrame, edges: DataFrame, solve: Callable, bits: int, shift: int) -> DataFrame:
    """(request_id, rank, cost, path): what `solve` finds for each request among the edges into the block of its target.

    A request whose search leaves the block has one row with a null cost; one without a path has none. Blocks with many
    requests are dealt to several groups, each of which gets the block's edges.
    """
    block = lambda c: F.shiftright(F.col(c).cast("long") + F.lit(shift), bits)
    q = requests.select("request_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), block("target").alias("block"))
    parts = q.groupBy("block").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("parts"))
    q = q.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("parts")).cast("int")).drop("parts")
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "w", block("v").alias("block")).join(parts, "block")
    e = e.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kind = requests.schema["request_id"].dataType.simpleString(), requests.schema["source"].dataType.simpleString()

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        into, out = adjacency(*[right[c].to_numpy().tolist() for c in ("u", "v", "w")])
        lo = (left["block"][0].as_py() << bits) - shift if left.num_rows else 0
        rows = []
        for i, (s, t) in enumerate(zip(left["source"].to_pylist(), left["target"].to_pylist())):
            found = solve(into, out, lo, lo + (1 << bits), s, t)
            rows += [(i, 0, None, None)] if found is None else [(i, r, c, p) for r, (c, p) in enumerate(found, 1)]
        at, rank, cost, path = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        return pa.table({"request_id": left["request_id"].take(pa.array(np.array(at, "int64"))), "rank": pa.array(rank, pa.int32()), "cost": pa.array(cost, pa.float64()), "path": pa.array(path, pa.list_(pa.int64()))})

    with_package(requests.sparkSession)
    got = q.groupBy("block", "part").cogroup(e.groupBy("block", "part")).applyInArrow(group, f"request_id {kind[0]}, rank int, cost double, path array<long>")
    return got.withColumn("path", F.col("path").cast(f"array<{kind[1]}>"))


def block_passes(rounds: Rounds, requests: DataFrame, edges: DataFrame, solve: Callable, bits: int) -> tuple[DataFrame, DataFrame | None]:
    """What blocks find, and the requests that are left (None: there are none). The second pass has its blocks' bounds where the first has their middles."""
    done, left = requests.sparkSession.createDataFrame([], f"request_id {requests.schema['request_id'].dataType.simpleString()}, rank int, cost double, path array<{requests.schema['source'].dataType.simpleString()}>"), requests
    if requests.schema["source"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return done, left
    for k, shift in enumerate((0, 1 << (bits - 1))):
        got = rounds.put(f"blocks{k}", in_blocks(left, edges, solve, bits, shift))
        done = done.unionByName(got.where("cost is not null"))
        left = rounds.put(f"left{k}", left.join(got.where("cost is null").select("request_id"), "request_id", "left_semi"))
        if left.isEmpty():
            return done, None
    return done, left


def reach(requests: DataFrame, edges: DataFrame, slack: float | None = 0.0) -> DataFrame:
    """(request_id, node, cost, prev): nodes within `slack` of each request's cheapest arrival, with their least cost and the node before on one such way.

    edges (u, v, w >= 0), requests (request_id, source, target). Each round relaxes all requests' frontiers by one join, until
    no node improves: however many edges that takes. A node is in the frontier only while it improves and is no dearer than the
    request's best arrival so far plus the slack. Every round is written and read back.
    """
    rounds = Rounds(requests.sparkSession)
    return _reach(rounds, requests, rounds.put("edges", plain(edges)), slack)


def _reach(rounds: Rounds, requests: DataFrame, edges: DataFrame, slack: float) -> DataFrame:
    """As `reach`, for edges that are stored."""
    out = edges.withColumnRenamed("u", "node")
    best = rounds.put("best", requests.select("request_id", "target", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["u"].dataType).alias("prev"), F.lit(True).alias("fresh")))
    while not best.where("fresh").isEmpty():
        goal = best.where("node = target").select("request_id", F.col("cost").alias("goal"))
        # what is too dear is left out before it is shuffled
        step = best.where("fresh and node <> target").join(goal, "request_id", "left").join(out, "node").where(F.col("goal").isNull() | (F.col("cost") + F.col("w") <= F.col("goal") + slack))
        step = step.select("request_id", "target", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("node").alias("prev"))
        step = step.groupBy("request_id", "target", "node").agg(F.min(F.struct("cost", "prev")).alias("new"))
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new.cost") < F.col("cost")))
        both = best.drop("fresh").withColumnRenamed("target", "t").join(step, ["request_id", "node"], "full_outer").withColumn("fresh", F.coalesce(better, F.lit(False)))
        pick = lambda c: F.when(F.col("fresh"), F.col("new")[c]).otherwise(F.col(c)).alias(c)
        best = rounds.put("best", both.select("request_id", F.coalesce("t", "target").alias("target"), "node", pick("cost"), pick("prev"), "fresh"))
    goal = best.where("node = target").select("request_id", F.col("cost").alias("goal"))
    return best.join(goal, "request_id").where(F.col("cost") <= F.col("goal") + slack).select("request_id", "target", "node", "cost", "prev", "goal")


def shortest(requests: DataFrame, edges: DataFrame, bits: int = BITS) -> DataFrame:
    """(request_id, cost, path) of the cheapest path, of any number of edges; requests without one are left out.

    Requests are done where they meet the edges of a block of 2^bits node ids, as far as neighbours have near ids; those whose
    search leaves its block in both passes go through `reach`, by rounds over all edges.
    """

    def one(into: dict, out: dict, lo: int, hi: int, source: int, target: int) -> list | None:
        if (got := towards(into, lo, hi, source, target, None)) is None:
            return None
        cost, after, _ = got
        if source not in cost:
            return []
        path = [source]
        while path[-1] != target:
            path.append(after[path[-1]])
        return [(cost[source], path)]

    rounds = Rounds(requests.sparkSession)
    stored = rounds.put("edges", plain(edges))
    done, left = block_passes(rounds, requests.select("request_id", "source", "target"), stored, one, bits)
    done = done.select("request_id", "cost", "path")
    if left is None:
        return done
    best = rounds.put("reached", _reach(rounds, left, stored, 0.0))
    back = best.select("request_id", "node", F.col("prev").alias("before"))
    now = rounds.put("paths", best.where("node = target").select("request_id", F.col("goal").alias("cost"), F.col("prev").alias("node"), F.array("node").alias("path")))
    while not now.where("node is not null").isEmpty():
        known = F.col("node").isNull()
        now = rounds.put("paths", now.join(back, ["request_id", "node"], "left").select("request_id", "cost", F.col("before").alias("node"), F.when(known, F.col("path")).otherwise(F.concat(F.array("node"), "path")).alias("path")))
    return done.unionByName(now.drop("node"))


def k_paths(requests: DataFrame, edges: DataFrame, k: int = 3, slack: float = 4.0, bits: int = BITS) -> DataFrame:
    """(request_id, rank, cost, path): the k cheapest simple paths, exactly, or all if fewer.

    A path of a cost keeps to nodes within that cost of its ends, so paths found among the nodes within `slack` of the cheapest
    way are right up to that cost. Requests with fewer than k such paths are done again with twice the slack, at last with all
    nodes. Blocks come first, as in `shortest`; of requests that leave theirs, one request's nodes are one group.
    """

    def some(into: dict, out: dict, lo: int, hi: int, source: int, target: int) -> list | None:
        within = slack / 4  # most requests need no more, and others go on from there
        while True:
            if (got := towards(into, lo, hi, source, target, within)) is None:
                return None
            cost, _, whole = got
            found = k_cheapest(out, cost, source, target, k)
            if whole or source not in cost or (len(found) == k and found[-1][0] <= cost[source] + within):
                return found
            within = 2 * within or 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into, out = adjacency(*[pdf[c].tolist() for c in ("u", "v", "w")])
        source, target = int(pdf["source"].iloc[0]), int(pdf["target"].iloc[0])
        found = k_cheapest(out, towards(into, -INF, INF, source, target, INF)[0], source, target, k)
        return pd.DataFrame({"request_id": [pdf["request_id"].iloc[0]] * len(found), "rank": range(1, len(found) + 1), "cost": [c for c, _ in found], "path": [p for _, p in found]})

    rounds = Rounds(requests.sparkSession)
    stored = rounds.put("edges", plain(edges))
    # a request from a node to itself has the path of that node alone
    alone = requests.where("source = target").select("request_id", F.lit(1).alias("rank"), F.lit(0.0).alias("cost"), F.array("source").alias("path"))
    done, left = block_passes(rounds, requests.where("source <> target").select("request_id", "source", "target"), stored, some, bits)
    done = done.unionByName(alone)
    if left is None:
        return done
    done, before = rounds.put("done", done), None
    while True:
        near = rounds.put("near", _reach(rounds, left, stored, slack))
        nodes = near.groupBy("request_id").agg(F.count("*").alias("nodes"), F.first("goal").alias("goal"))
        inside = near.select("request_id", F.col("node").alias("u")).join(stored, "u").join(near.select("request_id", F.col("node").alias("v")), ["request_id", "v"]).join(left, "request_id")
        found = rounds.put("found", inside.select("request_id", "source", "target", "u", "v", "w").groupBy("request_id").applyInPandas(run, "request_id long, rank int, cost double, path array<long>"))
        last = found.groupBy("request_id").agg(F.count("*").alias("n"), F.max("cost").alias("most")).join(nodes, "request_id")
        ready = F.lit(slack == INF) | ((F.col("n") == k) & (F.col("most") <= F.col("goal") + slack))
        if before is not None:
            last = last.join(before, "request_id", "left")
        more = F.col("nodes") > F.col("nodes_before") if before is not None else F.lit(True)
        last = rounds.put("last", last.select("request_id", "nodes", F.coalesce(ready, F.lit(False)).alias("ready"), more.alias("more")))
        done = rounds.put("done", done.unionByName(found.join(last.where("ready").select("request_id"), "request_id", "left_semi")))
        if last.where("not ready").isEmpty():
            return done
        before = last.where("not ready").select("request_id", F.col("nodes").alias("nodes_before"))
        left = rounds.put("left", left.join(before.select("request_id"), "request_id", "left_semi"))
        # no more nodes within twice the slack may still mean some beyond
        slack = INF if not last.where("not ready and not more").isEmpty() else 2 * slack or 1.0


def path_sums(paths: DataFrame, edges: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Sums of edge columns along each path (an array of nodes): key and the named sums."""
    hop = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("u"), F.element_at("path", i + 1).alias("v")))
    steps = paths.where(F.size("path") > 1).select(key, F.explode(hop).alias("e")).select(key, "e.u", "e.v")
    return steps.join(edges, ["u", "v"]).groupBy(key).agg(*[F.sum(c).alias(n) for n, c in columns.items()])


def wake_hits(routes: DataFrame, wake: DataFrame) -> DataFrame:
    """(route, hit): whether any point of a route lies in the bounding box of the wake's ring (arrays of lat, lon structs)."""
    values = {"lat": F.transform("ring", lambda p: p["lat"]), "lon": F.transform("ring", lambda p: p["lon"])}
    box = wake.select(*[f(v).alias(f"{k}_{n}") for k, v in values.items() for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    inside = F.exists("points", lambda p: p["lat"].between(F.col("lat_lo"), F.col("lat_hi")) & p["lon"].between(F.col("lon_lo"), F.col("lon_hi")))
    return routes.crossJoin(F.broadcast(box)).select("route", inside.alias("hit"))  # one wake
