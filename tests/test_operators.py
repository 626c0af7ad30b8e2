"""Small literal cases and properties."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import clean, geo, physics
from hazegrid.operators import diffusion, graph, matching, routing, series


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


TIMES = [0, 1, 2, 5, 6, 10, 11, 12, 13, 14]
VALUES = [None, None, 10.0, None, None, None, None, None, 20.0, None]


def sparse(spark):
    rows = [(1, f"2024-01-01 {h:02d}:00:00", v) for h, v in zip(TIMES, VALUES)]
    return spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))


def column(df, name):
    return [None if r[name] is None else round(r[name], 6) for r in df.orderBy("t").collect()]


def test_interpolation_with_and_without_limit(spark):
    s = sparse(spark)
    assert column(series.interpolate(s, ["k"], "t", "v", "o", limit=1), "o") == [None, 10, 10, 12.727273, None, None, None, 19.090909, 20, 20]
    assert column(series.interpolate(s, ["k"], "t", "v", "o", limit=None), "o") == [10, 10, 10, 12.727273, 13.636364, 17.272727, 18.181818, 19.090909, 20, 20]
    assert column(series.interpolate(s, ["k"], "t", "v", "o", limit=None, by_time=False), "o") == [10, 10, 10, 11.666667, 13.333333, 15, 16.666667, 18.333333, 20, 20]
    assert column(series.gap_lengths(s, ["k"], "t", "v", "o"), "o") == [2, 2, 0, 5, 5, 5, 5, 5, 0, 1]


def test_interpolation_equals_pandas_on_random_gaps(spark):
    rng = np.random.default_rng(3)
    frames = []
    for k in range(12):
        t = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(400, 80, replace=False)), unit="h")
        v = rng.normal(size=80)
        v[rng.random(80) < 0.8] = np.nan
        frames.append(pd.DataFrame({"k": k, "t": t, "v": v, "want": pd.Series(v, index=t).interpolate(method="time", limit=5, limit_direction="both").to_numpy()}))
    d = pd.concat(frames)
    s = spark.createDataFrame([(int(r.k), str(r.t), None if np.isnan(r.v) else float(r.v)) for r in d.itertuples()], "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = series.interpolate(s, ["k"], "t", "v", "o", limit=5).toPandas().sort_values(["k", "t"])
    want = d.sort_values(["k", "t"])["want"].to_numpy()
    assert (np.isnan(got["o"].to_numpy(dtype=float)) == np.isnan(want)).all()
    assert np.allclose(got["o"].to_numpy(dtype=float), want, equal_nan=True)


def test_excess_and_spike(spark):
    x = lambda o: value(spark, physics.excess(F.lit(o), F.lit(1.0), 1.5))
    assert [x(1.2), x(1.49)] == [0, 0] and x(1.6) > 0 and x(1.51) > 0
    assert [2 * round(x(o), 6) for o in (1.4, 1.7, 1.0, 2.0)] == [0, 1.4, 0, 2.0]


def test_physics_values(spark):
    assert value(spark, physics.plume(F.lit(20.0), F.lit(8.0), F.lit(1.2), F.lit(15.0), F.lit(6.0))) > 0
    assert value(spark, physics.plume(F.lit(20.0), F.lit(8.0), F.lit(0.0), F.lit(15.0), F.lit(6.0))) == 0
    assert round(value(spark, physics.canyon(F.lit(10.0), F.lit(0.8), F.lit(0.9))), 6) == 15.85
    assert round(value(spark, physics.street_wind(F.lit(2.0), F.lit(0.8))), 6) == 1.12
    assert [round(value(spark, c), 6) for c in physics.sigmas(F.lit(100.0))] == [20, 6]
    assert round(value(spark, physics.dose(F.lit(40.0), F.lit(300.0), F.lit("cycling"))), 2) == 11.67
    assert round(value(spark, physics.dose(F.lit(40.0), F.lit(300.0), F.lit("car"))), 2) == 2.0
    assert round(value(spark, clean.inhalation_rate(F.lit("car"))), 6) == round(0.65 * 1.41, 6)
    assert value(spark, physics.quota(F.lit(8.0), 40.0)) == 5 and value(spark, physics.quota(F.lit(20.0), 40.0)) == 2
    assert value(spark, physics.quota(F.lit(999.0))) == 1 and value(spark, physics.quota(F.lit(0.0))) == 10


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(Exception, match="unknown key"):
        value(spark, clean.minute_volume(F.lit("hovercraft")))


@pytest.mark.parametrize("w,sun,night,want", [(1.0, None, False, "E"), (1.0, 300.0, False, "A"), (2.5, 300.0, False, "B"), (4.0, 500.0, False, "B"), (5.5, None, False, "D"), (5.5, 400.0, False, "C"), (1.0, 500.0, True, "F"), (9.0, 500.0, False, "D")])
def test_stability(spark, w, sun, night, want):
    assert value(spark, physics.stability_class(F.lit(w), F.lit(sun), F.lit(night))) == want


def test_utm_point(spark):
    x, y = geo.to_utm(F.lit(12.9716), F.lit(77.5946))
    assert round(value(spark, x), 3) == 781481.020 and round(value(spark, y), 3) == 1435426.407


def test_road_classes(spark):
    names = ["['Primary', 'secondary']", "Residential;service", "tertiary", "", None, "nan", "('trunk','x')"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, h string")
    assert [r.c for r in d.select("i", clean.road_class(F.col("h")).alias("c")).orderBy("i").collect()] == ["primary", "residential", "tertiary", "unknown", "unknown", "unknown", "trunk"]


EDGES = [(1, 2, 0.72), (2, 3, 0.58), (1, 4, 0.44), (4, 5, 0.67), (5, 3, 0.51)]


def spread(spark, seeds, steps, **options):
    e = spark.createDataFrame([(u, v, 100.0, 0.0, b) for u, v, b in EDGES], "u long, v long, length double, bearing_deg double, building_density double")
    s = spark.createDataFrame([(u, v, float(x)) for (u, v, _), x in zip(EDGES, seeds)], "u long, v long, s double")
    wind = spark.createDataFrame([(1.0, 0.0)], "wind_speed double, wind_dir double")
    return {(r.u, r.v): r.s for r in diffusion.propagate(s, e, wind, steps, **options).collect()}


def test_propagation(spark):
    seeds = [15, 10, 8, 6, 5]
    one, two = spread(spark, seeds, 1), spread(spark, seeds, 2)
    assert one[2, 3] != two[2, 3]
    slow, fast = spread(spark, seeds, 3, damping=0.2), spread(spark, seeds, 3, damping=1.0)
    assert abs(slow[2, 3] - 10) < abs(fast[2, 3] - 10)
    assert all(0 <= x <= 500 for x in spread(spark, [120, 110, 90, 80, 70], 10).values())
    assert spread(spark, [10], 1)[1, 2] > 0


def test_constant_field_stays(spark):
    g = spark.createDataFrame([(0, r, c, 10.0, 1.0, 0.0) for r in range(5) for c in range(5)], "grid_id int, r int, c int, concentration double, wind_u double, wind_v double")
    assert {r.concentration for r in diffusion.advect(g).collect()} == {10.0}


def test_commuter_and_segment_ranking(spark):
    c = spark.createDataFrame([(0, 1, "jogger", 2.0, 6000.0), (0, 2, "two_wheeler", 3.0, 6000.0)], "cohort long, id long, mode string, id_min double, distance_tolerance_m double")
    r = spark.createDataFrame([(0, 10, 30.0, 1200.0), (0, 11, 10.0, 2400.0), (0, 12, None, 10.0)], "cohort long, route_id long, dose double, distance_m double")
    p = [x.route for x in matching.commuter_ranking(c, r).where("commuter = 1").orderBy("pref_rank").collect()]
    assert p == [11, 10, 12]
    assert [x.commuter for x in matching.segment_ranking(c, r).where("route = 10").orderBy("seg_rank").collect()] == [1, 2]


def test_matching_preference_and_fallback(spark):
    prefs = spark.createDataFrame([(0, u, r, k) for u in (1, 2, 3) for k, r in enumerate((10, 11), 1)], "cohort long, commuter long, route long, pref_rank int")
    ranks = spark.createDataFrame([(0, 10, 2, 1), (0, 10, 1, 2), (0, 10, 3, 3), (0, 11, 3, 1), (0, 11, 1, 2), (0, 11, 2, 3)], "cohort long, route long, commuter long, seg_rank int")
    cap = spark.createDataFrame([(0, 10, 1), (0, 11, 1)], "cohort long, route long, capacity int")
    m = matching.match(prefs, ranks, cap)
    assert {r.commuter: r.route for r in m.collect()} == {1: None, 2: 10, 3: 11}
    assert matching.blocking_pairs(m, prefs, ranks, cap).count() == 0
    routes = cap.select("cohort", F.col("route").alias("route_id"))
    d = spark.createDataFrame([(0, 1, 10, 11.0), (0, 1, 11, 2.5)], "cohort long, commuter long, route long, d double")
    assert {r.commuter: r.route for r in matching.fallback(m, routes, d).collect()}[1] == 11
    assert {r.commuter: r.route for r in matching.fallback(m, routes).collect()}[1] == 10


def best_stable(prefs, ranks, room):
    """Of all assignments that no commuter and route would both leave, the one that is best for every commuter."""
    stable = []
    for places in itertools.product(*[[None, *p] for p in prefs]):
        held = {r: [u for u, x in enumerate(places) if x == r] for r in room}
        if any(len(h) > room[r] for r, h in held.items()):
            continue
        better = [(u, r) for u, p in enumerate(prefs) for r in p[: p.index(places[u]) if places[u] is not None else len(p)]]
        if not any(len(held[r]) < room[r] or ranks[r][u] < max(ranks[r][x] for x in held[r]) for u, r in better):
            stable.append(places)
    worth = lambda u, r: prefs[u].index(r) if r is not None else 99
    return next(s for s in stable if all(worth(u, s[u]) <= worth(u, o[u]) for o in stable for u in range(len(prefs))))


def test_matching_equals_the_best_stable_assignment(spark):
    rng = np.random.default_rng(3)
    prefs, ranks, cap, want = [], [], [], {}
    for cohort in range(12):
        n, m = int(rng.integers(2, 6)), int(rng.integers(1, 4))
        wish = [[int(r) for r in rng.permutation(m)[: rng.integers(1, m + 1)]] for _ in range(n)]
        order = {r: [int(x) for x in rng.permutation(n)] for r in range(m)}
        room = {r: int(rng.integers(1, 3)) for r in range(m)}
        known = {r: {u: k for k, u in enumerate(o) if rng.random() < 0.8} for r, o in order.items()}  # others come last, by id
        prefs += [(cohort, u, r, k) for u, p in enumerate(wish) for k, r in enumerate(p, 1)]
        ranks += [(cohort, r, u, k) for r, o in known.items() for u, k in o.items()]
        cap += [(cohort, r, c) for r, c in room.items()]
        want |= {(cohort, u): r for u, r in enumerate(best_stable(wish, {r: {u: o.get(u, 50 + u) for u in range(n)} for r, o in known.items()}, room))}
    p = spark.createDataFrame(prefs, "cohort long, commuter long, route long, pref_rank int")
    r = spark.createDataFrame(ranks, "cohort long, route long, commuter long, seg_rank int")
    c = spark.createDataFrame(cap, "cohort long, route long, capacity int")
    assert {(x.cohort, x.commuter): x.route for x in matching.match(p, r, c).collect()} == want


def test_matching_of_many_rounds(spark):
    """Each round moves one commuter on to the next route."""
    n = 30
    prefs = [(0, i, r, k) for i in range(n) for k, r in ((1, i), (2, i + 1))] + [(0, n, 0, 1)]
    ranks = [(0, r, u, k) for r in range(n + 1) for k, u in ((1, r - 1 if r else n), (2, r))]
    p, r = spark.createDataFrame(prefs, "cohort long, commuter long, route long, pref_rank int"), spark.createDataFrame(ranks, "cohort long, route long, commuter long, seg_rank int")
    c = spark.createDataFrame([(0, 0, 1)], "cohort long, route long, capacity int")
    assert {x.commuter: x.route for x in matching.match(p, r, c).collect()} == {i: i + 1 for i in range(n)} | {n: 0}


def test_one_long_series(spark):
    """Windows are linear in the length of a series: 35,000 rows of one series."""
    d = spark.range(35_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("time"), F.when(F.col("id") % 50 == 0, F.col("id").cast("double")).alias("v"))
    began = time.time()
    out = series.fill_both(series.interpolate(d, ["k"], "time", "v", "lin", limit=None), ["k"], "time", ["v"])
    row = out.agg(F.max(F.abs(F.col("lin") - (F.unix_timestamp("time") / 3600)).cast("double")).alias("off"), F.count_if(F.col("v").isNull()).alias("open")).first()
    assert row.off == 49.0 and row.open == 0 and time.time() - began < 30  # the last 49 hours are filled flat


def test_path_of_many_edges(spark):
    n = 25
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(0, n, n + 0.5), (3, 900, 1.0)], "u long, v long, w double")
    q = spark.createDataFrame([(1, 0, n), (2, 5, 900), (3, 4, 4)], "request_id long, source long, target long")
    got = {r.request_id: (r.cost, r.path) for r in routing.shortest(q, e).collect()}
    assert got == {1: (float(n), list(range(n + 1))), 3: (0.0, [4])}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p, t = rng.uniform(0, 1000, (60, 2)), np.concatenate([rng.uniform(0, 200, (50, 2)), [[900, 900]]])
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)], "tid long, x double, y double")
    got = {r.id: r.tid for r in graph.nearest(a, b).collect()}
    want = {i: int(np.argmin(((t - x) ** 2).sum(axis=1))) for i, x in enumerate(p)}
    assert got == want


def test_k_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.5), (3, 4, 1.0), (1, 4, 5.0), (2, 3, 0.1)], "u long, v long, w double")
    q = spark.createDataFrame([(7, 1, 4)], "request_id long, source long, target long")
    got = [(r.cost, r.path) for r in routing.k_paths(q, e, 3).orderBy("rank").collect()]
    assert [round(c, 6) for c, _ in got] == [2.0, 2.1, 2.5]
    assert got[0][1] == [1, 2, 4] and got[1][1] == [1, 2, 3, 4] and got[2][1] == [1, 3, 4]
    assert routing.shortest(q, e).first().path == [1, 2, 4]
    every = [(round(r.cost, 6), r.path) for r in routing.k_paths(q, e, 9, 0.05).orderBy("rank").collect()]
    assert every == [(2.0, [1, 2, 4]), (2.1, [1, 2, 3, 4]), (2.5, [1, 3, 4]), (5.0, [1, 4])]


def test_node_index_counts_through_ranges(spark):
    n = spark.createDataFrame([(x,) for x in (5, 100, 101, 7, 100)], "osmid long")
    assert {r.osmid: r.i for r in graph.index_ids(n, "osmid", "i", 10).collect()} == {5: 0, 7: 1, 100: 2, 101: 3}


def test_sql_functions(spark):
    physics.register_functions(spark)
    assert round(spark.sql("SELECT hg_bearing_deg(0, 0, 0, 1) AS b").first().b, 6) == 90


def test_spread_over_snapshots_stores_a_row_an_edge(spark):
    """As `propagate` under each wind, from one row an edge and one a node: no edge is stored or shuffled by snapshots."""
    e = spark.createDataFrame([(u, v, 100.0 + 7 * v, 40.0 * u, b) for u, v, b in EDGES], "u long, v long, length double, bearing_deg double, building_density double")
    winds = [(k, 1.0 + k, 50.0 * k) for k in range(5)]
    wind = spark.createDataFrame(winds, "snapshot_id long, wind_speed double, wind_dir double")
    for steps in (1, 3):
        rows = diffusion.spread_over(e, wind, F.lit(2.0) + F.col("building_density"), steps)
        got = {(r.snapshot_id, r.u, r.v): r.s for r in rows.collect()}
        state = e.select("u", "v", (F.lit(2.0) + F.col("building_density")).alias("s")).crossJoin(wind.select("snapshot_id"))
        want = {(r.snapshot_id, r.u, r.v): r.s for r in diffusion.propagate(state, e, wind, steps, keys=["snapshot_id"]).collect()}
        assert got == pytest.approx(want) and len(got) == len(EDGES) * len(winds)
        tables = {f.rsplit("/", 2)[-2] for f in rows.inputFiles()}
        assert {t.split("-")[0] for t in tables} == {"edges", *[f"up{k}" for k in range(steps)]}
        assert spark.read.parquet(next(f.rsplit("/", 1)[0] for f in rows.inputFiles() if "/edges-" in f)).count() == len(EDGES)


def test_points_are_weighed_once(spark):
    """The fusion's plan folds a snapshot's points in one pass, whatever the number of readings."""
    e = spark.createDataFrame([(u, v) for u, v, _ in EDGES], "u long, v long")
    n = spark.createDataFrame([(i, 10.0 * i, 5.0 * i * i) for i in range(1, 6)], "osmid long, x double, y double")
    p = spark.createDataFrame([(0, 2.0, 30.0, [(1.0, 2.0, 3.0, 4.0, 5.0), (20.0, 9.0, 1.0, 0.0, 2.0)])], "snapshot_id long, wind_speed double, wind_dir double, points array<struct<x: double, y: double, no2: double, so2: double, pm2_5: double>>")
    f = diffusion.fuse(e.unionAll(e), n, p)
    assert f._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    more = diffusion.fuse(e, n, p.withColumn("points", F.concat("points", F.slice("points", 1, 1))))  # three points are folded
    for got, at in ((f, ((1.0, 2.0, 3.0, 5.0), (20.0, 9.0, 1.0, 2.0))), (more, ((1.0, 2.0, 3.0, 5.0), (20.0, 9.0, 1.0, 2.0), (1.0, 2.0, 3.0, 5.0)))):
        for r in got.collect():
            w = [1 / ((r.x - x) ** 2 + (r.y - y) ** 2 + 1) for x, y, *_ in at]
            assert r.no2 == pytest.approx(sum(a * q[2] for a, q in zip(w, at)) / sum(w)) and r.pm2_5 == pytest.approx(sum(a * q[3] for a, q in zip(w, at)) / sum(w))
        assert got.count() == len(EDGES)
