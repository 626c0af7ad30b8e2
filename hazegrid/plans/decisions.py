"""Queries of matching, routing, features, metrics, audit and stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.functions import physics
from hazegrid.functions.timeutil import floor_hour
from hazegrid.operators import audit, evaluate, features, matching, routing
from hazegrid.operators.scratch import Rounds
from hazegrid.plans.registry import query, r6

PREF = {
    "pf": "SELECT cohort, id AS commuter, route_id AS route, row_number() OVER (PARTITION BY cohort, id ORDER BY a * (dose / top) + (1 - a) * (distance_m / distance_tolerance_m), route_id) AS pref_rank FROM (SELECT c.*, r.route_id, r.dose, r.distance_m, max(dose) OVER (PARTITION BY c.cohort) AS top, CASE mode WHEN 'jogger' THEN 0.75 WHEN 'cyclist' THEN 0.60 ELSE 0.35 END::DOUBLE AS a FROM commuters c JOIN routes r USING (cohort))",
    "sr": "SELECT r.cohort, route_id AS route, id AS commuter, rk AS seg_rank FROM (SELECT cohort, id, row_number() OVER (PARTITION BY cohort ORDER BY CASE mode WHEN 'jogger' THEN 3.0 WHEN 'cyclist' THEN 2.0 ELSE 1.0 END::DOUBLE + 1 / id_min DESC, id) AS rk FROM commuters) JOIN routes r USING (cohort)",
    "cp": "SELECT cohort, route_id AS route, greatest(1, CAST(trunc(40 / dose) AS INTEGER)) AS capacity FROM routes",
}


@query("w17_commuter_ranking", "commuters routes", "SELECT * FROM pf", PREF)
def _(t):
    return matching.commuter_ranking(t.commuters(), t.routes())


@query("w18_segment_ranking", "commuters routes", "SELECT * FROM sr", PREF)
def _(t):
    return matching.segment_ranking(t.commuters(), t.routes())


@query("m18_quotas", "routes", "SELECT * FROM cp", {"cp": PREF["cp"]})
def _(t):
    return matching.quotas(t.routes(), F.col("dose"), 40.0)


def matched(t):
    c, r = t.commuters(), t.routes()
    return matching.match_by_order(c, r, matching.quotas(r, F.col("dose"), 40.0))


#: All routes of a cohort rank commuters alike, so the stable matching is each commuter's first choice with room, in that order.
SERIAL = PREF | {
    "turns": "SELECT p.cohort, s.seg_rank AS k, any_value(p.commuter) AS commuter, list(p.route ORDER BY p.pref_rank) AS wishes FROM pf p JOIN sr s USING (cohort, route, commuter) GROUP BY ALL",
    "rooms": "SELECT cohort, map_from_entries(list((route, capacity))) AS room FROM cp GROUP BY 1",
}
PICK = """WITH RECURSIVE g AS (
  SELECT cohort, 0::BIGINT AS k, NULL::BIGINT AS commuter, NULL::BIGINT AS route, room FROM rooms
  UNION ALL
  SELECT cohort, k, commuter, route, map_from_entries(list_transform(map_entries(room), lambda e: {'key': e.key, 'value': e.value - CASE WHEN e.key = route THEN 1 ELSE 0 END}))
  FROM (SELECT g.cohort, t.k, t.commuter, list_filter(t.wishes, lambda x: g.room[x] > 0)[1] AS route, g.room FROM g JOIN turns t ON t.cohort = g.cohort AND t.k = g.k + 1)
) SELECT cohort, commuter, route FROM g WHERE k > 0"""


@query("g7_stable_matching", "commuters routes", "SELECT cohort, commuter, coalesce(route, -1) AS route FROM (" + PICK + ")", SERIAL)
def _(t):
    return matched(t).select("cohort", "commuter", F.coalesce("route", F.lit(-1)).alias("route"))  # -1: no place


@query("g8_stability", "commuters", "SELECT cohort, count(*) AS commuters, 0 AS blocking FROM commuters WHERE cohort IN (SELECT DISTINCT CAST(s_nationkey AS BIGINT) FROM supplier) GROUP BY 1")
def _(t):
    m = Rounds(t.spark).put("matched", matched(t))
    r = t.routes()
    bad = matching.blocking_by_order(m, t.commuters(), r, matching.quotas(r, F.col("dose"), 40.0)).groupBy("cohort").agg(F.count("*").alias("blocking"))
    return m.groupBy("cohort").agg(F.count("*").alias("commuters")).join(bad, "cohort", "left").select("cohort", "commuters", F.coalesce("blocking", F.lit(0)).cast("int").alias("blocking"))


#: What is left goes to the least loaded routes: the i-th commuter, by id, takes the i-th slot in order of (load, route).
LEFT = SERIAL | {
    "m": PICK,
    "ld": "SELECT r.cohort, r.route_id AS route, count(m.commuter) AS load FROM routes r LEFT JOIN m ON m.cohort = r.cohort AND m.route = r.route_id GROUP BY ALL",
    "wt": "SELECT cohort, commuter, row_number() OVER (PARTITION BY cohort ORDER BY commuter) AS i FROM m WHERE route IS NULL",
    "sl": "SELECT cohort, route, row_number() OVER (PARTITION BY cohort ORDER BY level, route) AS i FROM (SELECT ld.cohort, route, unnest(generate_series(load, load + need - 1)) AS level FROM ld JOIN (SELECT cohort, count(*) AS need FROM wt GROUP BY 1) USING (cohort))",
    "placed": "SELECT cohort, commuter, route FROM m WHERE route IS NOT NULL UNION ALL SELECT cohort, commuter, route FROM wt JOIN sl USING (cohort, i)",
}


@query("g7_fallback", "commuters routes", "SELECT cohort, commuter, route FROM placed", LEFT)
def _(t):
    return matching.fallback(matched(t), t.routes())


@query("g7_nearest_fallback", "commuters routes", "SELECT cohort, commuter, coalesce(m.route, n.route) AS route FROM m JOIN (SELECT c.cohort, c.id AS commuter, arg_min(route_id, (abs(distance_m - distance_tolerance_m), route_id)) AS route FROM commuters c JOIN routes r USING (cohort) GROUP BY ALL) n USING (cohort, commuter)", SERIAL | {"m": PICK})
def _(t):
    c, r = t.commuters(), t.routes()
    return matching.fallback(matched(t), r, matching.nearest_routes(c, r))


@query("g8_assigned", "commuters routes", "SELECT cohort, bool_and(route IS NOT NULL) AS stable FROM m GROUP BY 1", SERIAL | {"m": PICK})
def _(t):
    return matching.all_assigned(matched(t))


#: Weights are whole numbers of at least 1, so no path of a cost has more edges than that; all costs here stay below the bound.
BOUND = 14
W = {"w": "SELECT u, v, min(1 + length % 7) AS w FROM road_edges GROUP BY u, v", "wl": "SELECT u, v, min(length / 10) AS w FROM road_edges GROUP BY u, v"}


def relaxed(w: str, bound: int) -> str:
    """Least costs of all requests up to a bound, by a recursive query over (request, node, cost)."""
    return f"WITH RECURSIVE x AS (SELECT request_id, target, source AS node, 0.0::DOUBLE AS cost FROM od_requests UNION SELECT request_id, target, v, cost + w FROM x JOIN {w} ON u = node WHERE node <> target AND cost + w <= {bound}) SELECT request_id, min(cost) AS cost FROM x WHERE node = target GROUP BY 1"


RELAX = W | {"r": relaxed("w", BOUND)}


def weights(t):
    return t.road_edges().groupBy("u", "v").agg(F.min(1 + F.col("length") % 7).alias("w"))


@query("g3_shortest_paths", "od_requests road_edges", "SELECT request_id, cost FROM r", RELAX)
def _(t):
    return routing.shortest(t.od_requests(), weights(t)).select("request_id", "cost")


@query("g3_k_paths")
def _(t):
    return routing.k_paths(t.od_requests(), weights(t), 3).select("request_id", "rank", "cost")


@query("a22_path_sums", "od_requests road_edges", "SELECT request_id, cost AS dose, true AS hops FROM r WHERE cost > 0", RELAX)
def _(t):
    e = weights(t)
    p = routing.shortest(t.od_requests(), e)
    return routing.path_sums(p, e.withColumn("one", F.lit(1)), "request_id", {"dose": "w", "hops": "one"}).select("request_id", "dose", (F.col("hops") >= 1).alias("hops"))


#: Routes whose dose is the least toxicity of their request's paths and whose distance follows from it; the rest is the matching above.
ALLOCATION = {"routes": "SELECT o.cohort, o.request_id AS route_id, r.cost AS dose, 500 + r.cost * 100 AS distance_m FROM od_requests o JOIN r USING (request_id) WHERE o.request_id IN (SELECT s_suppkey FROM supplier)"}


@query("g9_allocation", "commuters od_requests road_edges", "SELECT p.cohort, p.commuter, p.route, round(r.dose, 6) AS dose, round(r.distance_m, 6) AS distance_m, pf.pref_rank FROM placed p JOIN routes r ON r.cohort = p.cohort AND r.route_id = p.route JOIN pf ON pf.cohort = p.cohort AND pf.commuter = p.commuter AND pf.route = p.route", RELAX | ALLOCATION | LEFT)
def _(t):
    """Paths to doses, preferences, quotas, places and what each commuter takes in."""
    asked = t.od_requests().join(t.raw("supplier").select(F.col("s_suppkey").alias("request_id")), "request_id", "left_semi")
    e = weights(t)
    dose = routing.path_sums(routing.shortest(asked, e), e, "request_id", {"dose": "w"})
    r = Rounds(t.spark).put("routes", asked.join(dose, "request_id").select("cohort", F.col("request_id").alias("route_id"), "dose", (500 + F.col("dose") * 100).alias("distance_m")))
    c = t.commuters().join(r.select("cohort").distinct(), "cohort", "left_semi")
    m = matching.match_by_order(c, r, matching.quotas(r, F.col("dose"), 40.0))
    m = Rounds(t.spark).put("places", matching.fallback(m, r))
    cost = r.select("cohort", F.col("route_id").alias("route"), *r6("dose", "distance_m"))
    return m.join(cost, ["cohort", "route"]).join(matching.ranks_of(m, c, r), ["cohort", "commuter", "route"]).select("cohort", "commuter", "route", "dose", "distance_m", "pref_rank")


@query("g10_wake_hits", "routes", "SELECT route_id AS route, dose BETWEEN 8 AND 20 AND distance_m / 100 BETWEEN 20 AND 45 AS hit FROM routes")
def _(t):
    p = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    r = t.routes().select(F.col("route_id").alias("route"), F.array(p(F.col("dose"), F.col("distance_m") / 100)).alias("points"))
    ring = t.spark.range(1).select(F.array(p(F.lit(8.0), F.lit(20.0)), p(F.lit(20.0), F.lit(20.0)), p(F.lit(20.0), F.lit(45.0)), p(F.lit(8.0), F.lit(45.0))).alias("ring"))
    return routing.wake_hits(r, ring)


STAKE = {"dc": "SELECT o_orderkey, 'seed-' || o_custkey AS env_seed, (o_orderkey % 7) || '|' || (o_orderkey % 11) AS route, o_orderkey * 60 AS timestamp FROM orders"}
HASH = "sha256('{\"env_seed\":\"' || env_seed || '\",\"route\":\"' || route || '\",\"timestamp\":' || timestamp || '}')"


def decisions(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select("o_orderkey", F.concat(F.lit("seed-"), F.col("o_custkey").cast("string")).alias("env_seed"), F.concat_ws("|", (k % 7).cast("string"), (k % 11).cast("string")).alias("route"), (k * 60).alias("timestamp"))


@query("m19_stake_hash", "", f"SELECT o_orderkey, {HASH} AS stake_hash FROM dc", STAKE)
def _(t):
    return audit.stake(decisions(t)).select("o_orderkey", "stake_hash")


@query("j17_verify_audit", "", f"SELECT {HASH} AS stake_hash, o_orderkey % 3 = 0 AS valid FROM dc", STAKE)
def _(t):
    a = audit.stake(decisions(t))
    return audit.verify(a.select("stake_hash"), a.where("o_orderkey % 3 = 0"))


@query("a24_state_seed", "grid", "SELECT 'ts=2024-01-01 00:00:00;mean=' || printf('%.6f', avg(concentration)) AS env_seed FROM grid")
def _(t):
    return audit.state_seed(t.grid().withColumn("time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "concentration", "time")


WIN = {"wn": "SELECT station_id, time AS start, lead(time, 5) OVER w AS label_time, lead(target, 5) OVER w AS y, sum(target) OVER (PARTITION BY station_id ORDER BY time ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s, row_number() OVER w - 1 AS i FROM predictions WINDOW w AS (PARTITION BY station_id ORDER BY time)"}


@query("w11_sliding_windows", "predictions", "SELECT station_id, start, label_time, round(y, 6) AS y, round(s, 6) AS x_sum FROM wn WHERE label_time IS NOT NULL AND i % 2 = 0", WIN)
def _(t):
    d = features.sliding_windows(t.predictions(), "station_id", "time", ["target"], "target", 5, 2)
    return d.select("station_id", "start", "label_time", "y", F.aggregate("x", F.lit(0.0), lambda a, p: a + p["target"]).alias("x_sum")).select("station_id", "start", "label_time", *r6("y", "x_sum"))


@query("w11_contiguous_windows", "predictions", "SELECT station_id, start FROM (SELECT station_id, time AS start, lead(time, 1) OVER w AS l FROM predictions WINDOW w AS (PARTITION BY station_id ORDER BY time)) WHERE epoch(l) - epoch(start) = 3600")
def _(t):
    return features.sliding_windows(t.predictions(), "station_id", "time", ["target"], "target", 1, 1, True).select("station_id", "start")


IDX = {"ix": "SELECT time, row_number() OVER (ORDER BY time) - 1 AS t FROM (SELECT DISTINCT time FROM predictions)", "nn": "SELECT count(*) AS n FROM ix"}


@query("w12_time_split", "predictions", "SELECT CASE WHEN t < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(t) AS first FROM predictions JOIN ix USING (time), nn GROUP BY 1", IDX)
def _(t):
    return features.split_by_share(t.predictions(), "time").groupBy("split").agg(F.count("*").alias("rows"), F.min("t").cast("long").alias("first"))


@query("w12_block_split", "predictions", "SELECT CASE WHEN t >= n - 48 THEN 'test' WHEN t >= n - 96 THEN 'val' ELSE 'train' END AS split, (t >= n - 54 AND t < n - 48) OR (t >= n - 102 AND t < n - 96) AS reaches, count(*) AS rows FROM predictions JOIN ix USING (time), nn GROUP BY ALL", IDX)
def _(t):
    return features.split_blocks(t.predictions(), "time", 48, 6).groupBy("split", "reaches").agg(F.count("*").alias("rows"))


@query("w13_blocked_folds", "predictions", "SELECT fold, CASE WHEN t < n - fold * 24 THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM predictions JOIN ix USING (time), nn, (SELECT unnest([1, 2, 3]) AS fold) WHERE n - fold * 24 >= 100 AND t < n - fold * 24 + 24 GROUP BY ALL", IDX)
def _(t):
    plan = features.blocked_folds(t.predictions(), "time", 3, 24, 100)
    return features.assign_folds(t.predictions(), "time", plan).groupBy("fold", "part").agg(F.count("*").alias("rows"))


@query("t6_windows_per_cluster", "predictions", "SELECT station_id, start FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY (i * 7919) % 10007) AS rn FROM wn WHERE label_time IS NOT NULL) WHERE rn <= 4", WIN)
def _(t):
    from pyspark.sql import Window

    d = features.sliding_windows(t.predictions(), "station_id", "time", ["target"], "target", 5)
    i = F.row_number().over(Window.partitionBy("station_id").orderBy("start")) - 1
    return features.cap_per_cluster(d.withColumn("i", i), "station_id", 4, (F.col("i") * 7919) % 10007).select("station_id", "start")


@query("a25_masked_errors", "predictions", "SELECT count(*) AS n, round(avg(pow(pred - target, 2)), 6) AS mse, round(avg(abs(pred - target)), 6) AS mae, round(sqrt(avg(pow(pred - target, 2))), 6) AS rmse FROM predictions WHERE train_mask")
def _(t):
    return evaluate.masked_errors(t.predictions(), F.col("train_mask")).select("n", *r6("mse", "mae", "rmse"))


@query("a26_weighted_mse", "predictions", "SELECT round(sum(greatest(0.05, least(1, weight)) * pow(pred - target, 2)) / (sum(greatest(0.05, least(1, weight))) + 1e-8), 6) AS weighted_mse FROM predictions")
def _(t):
    return evaluate.weighted_mse(t.predictions()).select(*r6("weighted_mse"))


UP = {"ue": "SELECT DISTINCT l_partkey % 150 AS u, l_suppkey % 150 AS v, 20 + 10 * l_quantity AS length FROM lineitem WHERE l_partkey % 150 <> l_suppkey % 150", "up": "SELECT *, 1 / (2 * pi() * 2 * sy * sz) * exp(-4 / (2 * sz * sz)) AS pl FROM (SELECT *, greatest(2, 0.2::DOUBLE * length) AS sy, greatest(1, 0.06::DOUBLE * length) AS sz FROM ue)"}


@query("a27_upwind_penalty", "predictions", "SELECT round(coalesce(avg(pow(greatest(0, b.pred - a.pred), 2) * (1 + pl / (SELECT greatest(max(pl), 1e-8) FROM up))), 0), 4) AS penalty FROM predictions a JOIN up ON up.u = a.station_id JOIN predictions b ON b.station_id = up.v AND b.time = a.time", UP)
def _(t):
    p = t.predictions().select(F.col("time").alias("t"), F.col("station_id").alias("node"), "pred")
    li = t.raw("lineitem")
    e = li.select((F.col("l_partkey") % 150).alias("u"), (F.col("l_suppkey") % 150).alias("v"), (20 + 10 * F.col("l_quantity")).alias("length")).where("u <> v").distinct()
    return evaluate.upwind_penalty(p, e).select(F.round("penalty", 4).alias("penalty"))


@query("a28_fold_stability", "predictions", "SELECT round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(max(mae), 6) AS mae_worst FROM (SELECT station_id % 5 AS fold, avg(abs(pred - target)) AS mae FROM predictions GROUP BY 1)")
def _(t):
    s = t.predictions().groupBy((F.col("station_id") % 5).alias("fold")).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))
    return evaluate.fold_stability(s, ["mae"]).select(*r6("mae_mean", "mae_std", "mae_worst"))


@query("a20_circular_mean", "weather_hourly", "SELECT CAST(time AS DATE)::VARCHAR AS day, round(((degrees(atan2(avg(sin(radians(wind_direction_10m))), avg(cos(radians(wind_direction_10m))))) % 360) + 360) % 360, 6) AS wd FROM weather_hourly GROUP BY 1")
def _(t):
    return t.weather_hourly().groupBy(F.to_date("time").cast("string").alias("day")).agg(evaluate.circular_mean("wind_direction_10m").alias("wd")).select("day", *r6("wd"))
