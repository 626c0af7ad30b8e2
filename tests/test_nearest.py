"""Nearest targets by leaves of equal count, against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import graph

POINT = "id long, x double, y double"


def frame(spark, kind, xy):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], kind)


def plain(points, targets):
    out = {}
    for i, p in enumerate(points):
        d = np.hypot(targets[:, 0] - p[0], targets[:, 1] - p[1])
        out[i] = (int(np.flatnonzero(d == d.min())[0]), float(d.min()))
    return out


def clouds(rng, n, m):
    """Uniform, clustered, gridded with ties, and far away points; targets dense in one place."""
    t = np.concatenate([rng.normal(0, 1, (m // 2, 2)), rng.uniform(-1e5, 1e5, (m // 4, 2)), rng.integers(0, 9, (m // 4, 2)) * 10.0])
    p = np.concatenate([rng.normal(0, 1, (n // 3, 2)), rng.uniform(-2e5, 2e5, (n // 3, 2)), rng.integers(-2, 20, (n // 3, 2)) * 5.0])
    return p, t


@pytest.mark.parametrize(("n", "m"), [(300, 4), (600, 400), (900, 4000)])
def test_equals_plain_search(spark, n, m):
    p, t = clouds(np.random.default_rng(n), n, m)
    got = {r.id: (r.tid, r.distance_meters) for r in graph.nearest(frame(spark, POINT, p), frame(spark, POINT.replace("id", "tid"), t)).collect()}
    want = plain(p, t)
    assert got.keys() == want.keys()
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}  # ties go to the smaller target


def test_bad_points_and_no_targets(spark):
    p = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 1.0, 1.0), (4, 9.0, 9.0)], POINT)
    t = spark.createDataFrame([(7, 1.0, 2.0), (5, 1.0, 2.0), (None, 1.0, 1.0), (6, None, 1.0), (8, 9.0, 9.5)], "tid long, x double, y double")
    assert sorted((r.id, r.tid, r.distance_meters) for r in graph.nearest(p, t).where("tid is not null").collect()) == [(4, 8, 0.5)]
    assert sorted(r.id for r in graph.nearest(p, t).where("tid is null").collect()) == [1, 2, 3]
    assert {(r.id, r.tid) for r in graph.nearest(p, t.where(F.lit(False))).collect()} == {(i, None) for i in (1, 2, 3, 4)}
    assert graph.nearest(p.where(F.lit(False)), t).count() == 0


def test_pairs_a_point_stay_bounded(spark):
    """Ten times both sides: as many pairs a point; also where all points and targets lie in a thousandth of the extent."""
    rng, met = np.random.default_rng(3), []
    for n in (2_000, 20_000):
        for spread in (1.0, 0.001):
            t = np.concatenate([rng.uniform(0, spread, (n, 2)), rng.uniform(0, 1, (20, 2))])
            p = rng.uniform(0, spread, (n, 2))
            pairs = graph._pairs_within(frame(spark, POINT, p), frame(spark, POINT.replace("id", "tid"), t)).count()
            met.append(pairs / n)
    assert max(met) <= 8 * graph.LEAF_ROWS, met
    assert met[2] <= 1.5 * met[0] and met[3] <= 1.5 * met[1], met


def test_neighbours_within_reach(spark):
    """Pairs from cells equal all pairs within the reach, also at a pole and over the date line; the bound on dropped weight holds."""
    from hazegrid.operators import gapfill as G

    rng = np.random.default_rng(5)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(12.9, 13.1, 40), rng.uniform(77.5, 77.7, 40))] + [(0.0, 179.99), (0.01, -179.99), (89.99, 10.0), (89.99, -170.0), (None, 1.0)]
    meta = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(at)], "id long, lat double, lon double")
    for reach in (700.0, 5000.0):
        want = {(r.a, r.b): r.d for r in G.pair_distances(meta).where(F.col("d") <= reach).collect()}
        got = {(r.a, r.b): r.d for r in G.near_pairs(meta, reach).collect()}
        assert got == want and len(want) >= 8
    times = "timestamp_ntz'2024-01-01 00:00:00'"
    o = spark.range(45).selectExpr("'co' AS parameter", f"{times} AS time", "id AS station_id", "CAST(id * 7 % 13 AS DOUBLE) AS value").where("station_id % 4 <> 0")
    exact = {r.station_id: r for r in G.idw(o, o, G.pair_distances(meta), 1).collect()}
    near = {r.station_id: r for r in G.idw_within(o, o, meta, 5000.0, 1).collect()}
    assert near and near.keys() <= exact.keys()
    for i, r in near.items():
        # with a share of the weight unknown, the mean may be off by that share of the values' range
        assert abs(r.idw - exact[i].idw) <= r.dropped_share * 12 + 1e-9 and 0 <= r.dropped_share < 1


def test_a_point_and_a_leaf_make_one_row(spark):
    """However many targets a leaf has, what is grouped by point is a row a leaf, not a row a pair."""
    rng = np.random.default_rng(11)
    p, t = rng.uniform(0, 1, (400, 2)), rng.uniform(0, 1, (4000, 2))
    points, targets = frame(spark, POINT, p), frame(spark, POINT.replace("id", "tid"), t)
    asked, held = graph._sides_within(points, targets)
    rows = graph._best_within(points, targets)
    assert rows.count() == asked.count() <= graph._pairs_within(points, targets).count() / 8
    assert {r.id: (r.m.tid, r.m.d) for r in rows.groupBy("id").agg(F.min("m").alias("m")).collect()} == {i: (w[0], pytest.approx(w[1])) for i, w in plain(p, t).items()}


def test_lloyd_clusters_against_plain_rounds(spark):
    """Many centres, ties to the smaller one, and as many expressions in the plan for 300 centres as for 3."""
    xy = [(float(i * 37 % 64), float(i * 53 % 64)) for i in range(900)]
    n = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "osmid long, x double, y double")
    order = sorted(range(900), key=lambda i: (i % 1000003 * 2654435761 % 1000003, i))
    for k in (3, 300):
        c = np.array([xy[order[i * 900 // k]] for i in range(k)])
        for _ in range(2):
            near = np.array([int(np.argmin(((c - p) ** 2).sum(axis=1))) for p in np.array(xy)])
            c = np.array([np.array(xy)[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        near = [int(np.argmin(((c - p) ** 2).sum(axis=1))) for p in np.array(xy)]
        got = graph.lloyd(n, k, 2)
        assert {r.osmid: r.cluster for r in got.collect()} == dict(enumerate(near))
        assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 2000
