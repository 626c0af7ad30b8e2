"""Cells that neighbours fill, by tiles of locations and times, against the cascade and plain sums."""

import random

import numpy as np
from pyspark.sql import functions as F

from hazegrid.operators import gapfill as G


def test_tiles_equal_the_means_over_pairs(spark, monkeypatch):
    """Several tiles and chunks of times, stations at one location, two pollutants, a station without coordinates."""
    for k, v in {"NEAR": 3, "TILE": 4, "HELD": 60}.items():
        monkeypatch.setattr(G, k, v)
    r = random.Random(3)
    at = [(i, *([None, 1.0] if i == 5 else [12.9 + i % 11 / 100, 77.5 + i % 7 / 100])) for i in range(30)] + [(40, 12.9, 77.5), (41, 12.9, 77.5)]
    meta = spark.createDataFrame(at, "id long, lat double, lon double")
    seen = [(p, i, h, r.random() * 50) for p in ("co", "pm10") for i, *_ in at for h in range(40) if r.random() < 0.08]
    hourly = spark.createDataFrame(seen, "parameter string, station_id long, h int, value double").selectExpr("parameter", "station_id", "'s' AS station_name", "timestamp_ntz'2024-01-01 00:00:00' + h * INTERVAL 1 HOUR AS time", "value").localCheckpoint()
    policy = spark.createDataFrame([("co", 2.0), ("pm10", 3.0)], "parameter string, p90 double")
    observed = G.per_station(hourly)
    holes = G.cascade(hourly, meta, policy, use_idw=True, limit=2, values=False).where("impute_method = 'spatial_idw'").select("parameter", "station_id", "time")
    want = {(x.parameter, x.station_id, x.time): (x.idw, x.neighbours) for x in G.idw(holes, observed, G.pair_distances(meta), 2).collect()}
    got = {(x.parameter, x.station_id, x.time): (x.value, x.impute_source_count) for x in G.spatial_fills(hourly, meta, policy, 2).collect()}
    assert got.keys() == want.keys() and len(want) > 500
    assert all(np.isclose(got[k][0], want[k][0], rtol=1e-12, atol=0) and got[k][1] == want[k][1] for k in want)


def test_products_are_plain_sums(monkeypatch):
    monkeypatch.setattr(G, "FAR", 8)
    monkeypatch.setattr(G, "PAIRS", 10)
    r = np.random.default_rng(1)
    lat, lon, x, y = r.random(30) + 12, r.random(30) + 77, r.random(5) + 12, r.random(5) + 77
    who, at, v = r.integers(0, 30, 200), r.integers(0, 6, 200), r.random(200)
    order = np.lexsort((at, who // 8))
    who, at, v = who[order], at[order], v[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(who // 8) != 0) | (np.diff(at) != 0), [True]]))
    total, weight = G._products((lat, lon), (x, y), (who, v, at, starts), 6)
    w = 1 / (G.square_m(lat, lon, x, y) + 1)
    for c in range(6):
        assert np.allclose(total[c], (w[who[at == c]] * v[at == c, None]).sum(axis=0), rtol=1e-12, atol=0)
        assert np.allclose(weight[c], w[who[at == c]].sum(axis=0), rtol=1e-12, atol=0)


def test_cells_without_a_value_are_not_shuffled(spark):
    """Holes leave the last grouped step; before, dense rows were made, located and shuffled to their hours."""
    from hazegrid.plans import registry

    plan = registry.QUERIES["c1_idw_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Aggregate" not in above and "Repartition" not in above and "Generate" not in above
