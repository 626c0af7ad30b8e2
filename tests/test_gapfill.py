"""Cells from observed rows against the dense operators, and weighted means against pairs of all stations."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions.geo import haversine_m
from hazegrid.operators import gapfill as G
from hazegrid.operators import series

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def observed(spark):
    r = random.Random(3)
    rows = [(p, s, DAY + datetime.timedelta(hours=h), r.choice([None, float(r.randrange(50)), r.random()])) for p in ("pm10", "co") for s in range(12) for h in r.sample(range(400), 20)]
    rows += [("co", 99, DAY + datetime.timedelta(hours=7), None)]
    return spark.createDataFrame(rows, "parameter string, station_id long, time timestamp_ntz, value double").localCheckpoint()


@pytest.fixture(scope="module")
def meta(spark):
    r = random.Random(4)
    rows = [(s, None if s == 5 else 12 + r.random() / 5, 77 + r.random() / 5) for s in range(12)] + [(99, 12.0, 77.0)]
    return spark.createDataFrame(rows, "id long, lat double, lon double").localCheckpoint()


def rows(df):
    return sorted([tuple(-1.0 if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


def dense(observed):
    times, stations = observed.select("parameter", "time").distinct(), observed.select("parameter", "station_id").distinct()
    return times.join(stations, "parameter").join(observed, ["parameter", "station_id", "time"], "left")


def sparse(observed):
    return G.timed(G.series_of(observed), G.times_of(observed))


@pytest.mark.parametrize("limit, by_time", [(3, True), (None, False)])
def test_cells_equal_windows_over_the_dense_spine(observed, limit, by_time):
    out = ["parameter", "station_id", "time", "value", "lin", "gap_hours"]
    want = series.gap_lengths(series.interpolate(dense(observed), G.SERIES, "time", "value", "lin", limit=limit, by_time=by_time), G.SERIES, "time", "value")
    for c in (G.cells(sparse(observed)), G.cells_blocks(observed, 2 * 86400.0)):
        got = series.gap_between(series.between(c, "time", "value", "lin", limit, by_time), "value")
        assert rows(got.select(out)) == rows(want.select(out))


def test_dense_rows_are_not_shuffled(observed):
    plan = G.climate(sparse(observed)).transform(G.cells)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Generate explode(sequence", 1)
    assert "Exchange" not in before


def test_slots_have_the_medians_of_the_dense_series(observed):
    want = G.climatology(series.interpolate(dense(observed), G.SERIES, "time", "value", "lin", limit=3), "lin")
    got = G.cells(G.climate(sparse(observed), 3)).withColumn("clim", F.get("_clim", G.slot(F.col("time"))))
    out = ["parameter", "station_id", "time", "clim"]
    assert rows(got.select(out)) == rows(want.select(out))


def test_means_equal_those_over_pairs(observed, meta):
    holes = dense(observed).select("parameter", "station_id", "time")
    out = ["parameter", "station_id", "time", "idw", "neighbours"]
    assert rows(G.idw_all(holes, observed, meta, 2).select(out)) == rows(G.idw(holes, observed, G.pair_distances(meta), 2).select(out))
    near = G.pair_distances(meta).where("d <= 9000")
    assert rows(G.idw_within(holes, observed, meta, 9000.0, 1).select(out)) == rows(G.idw(holes, observed, near, 1).select(out))


def test_a_cascade_without_values_has_the_same_lineage(spark, observed, meta):
    hourly = observed.withColumn("station_name", F.lit("s"))
    policy = spark.createDataFrame([("co", 2.0), ("pm10", 3.0)], "parameter string, p90 double")
    for how in ({}, {"use_idw": True, "limit": 2}, {"use_idw": True, "limit": 2, "reach": 9000.0}):
        full = G.cascade(hourly, meta, policy, **how)
        lineage = G.cascade(hourly, meta, policy, values=False, **how)
        names = [c for c in full.columns if c != "value"]
        assert rows(lineage.select(names)) == rows(full.select(names))
        assert full.where("(value is null) <> (impute_method is null)").isEmpty()
    full = G.cascade(hourly, meta, policy, use_idw=True, limit=2).where("impute_method = 'spatial_idw'")
    fills = G.spatial_fills(hourly, meta, policy, 2)
    assert rows(fills) == rows(full.select(fills.columns)) != []


def test_squared_distances(spark):
    r = np.random.default_rng(2)
    for spread in (1e-4, 0.5, 3.0, 90.0):
        a, b = r.random((2, 20)) * spread, r.random((2, 30)) * spread
        pairs = spark.createDataFrame([(float(x), float(y), float(z), float(w)) for x, y in a.T for z, w in b.T], "a double, b double, c double, d double")
        want = [x.d for x in pairs.select(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("d")).collect()]
        assert np.allclose(np.sqrt(G.square_m(a[0], a[1], b[0], b[1])).ravel(), want, rtol=1e-13, atol=0)


def test_a_back_test_shuffles_the_sampled_series_only(observed, meta):
    points = observed.where("value is not null and parameter = 'co' and station_id in (3, 5, 7)")
    got = G.backtest(observed, points, meta)
    every = G.backtest(observed, observed.where("value is not null"), meta)
    assert rows(got) == rows(every.where("pollutant = 'co' and station_id in (3, 5, 7)")) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    for i, x in enumerate(plan):
        if x.lstrip(" :+-").startswith("Window"):
            below = plan[i + 1 :][: next((k for k, d in enumerate(depth[i + 1 :]) if d <= depth[i]), len(plan))]
            assert any("LeftSemi" in y for y in below)
