"""Matching without stored pairs against the general operators over all pairs."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import matching as M
from hazegrid.plans import registry
from tests.oracle import same


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(8)
    modes = ["jogger", "cyclist", "car", None]
    people = [(c, 100 * c + i, r.choice(modes), r.choice([1.5, 2.0]), r.choice([None, 1000.0, 2000.0])) for c in range(3) for i in range(25)] + [(9, 1, "car", 1.0, 5.0)]
    ways = [(c, 10 * c + i, r.choice([None, 2.0, 4.0, 8.0]), r.choice([None, 500.0, 900.0])) for c in range(3) for i in range(7)] + [(8, 88, 1.0, 1.0)]
    c = spark.createDataFrame(people, "cohort long, id long, mode string, id_min double, distance_tolerance_m double").localCheckpoint()
    w = spark.createDataFrame(ways, "cohort long, route_id long, dose double, distance_m double").localCheckpoint()
    return c, w, w.select("cohort", F.col("route_id").alias("route"), (F.col("route_id") % 3).cast("int").alias("capacity"))


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_choosing_in_order_is_the_stable_matching(sides):
    c, w, room = sides
    prefs, order = M.commuter_ranking(c, w), M.commuter_order(c)
    want = M.match(prefs, order, room)
    got = M.match_by_order(c, w, room).select(want.columns)
    assert rows(got) == rows(want)
    ranks = M.ranks_of(got.where("route is not null"), c, w)
    assert rows(ranks) == rows(prefs.join(got, ["cohort", "commuter", "route"]).select(ranks.columns))
    # and a bad one has the same blocking pairs
    bad = got.withColumn("route", F.when(F.col("commuter") % 2 == 0, F.col("route")))
    pairs = M.blocking_pairs(bad, prefs, order, room)
    assert rows(M.blocking_by_order(bad, c, w, room)) == rows(pairs) != []
    assert M.blocking_by_order(got, c, w, room).isEmpty()


def test_slots_fill_the_least_loaded_routes(spark):
    r = random.Random(1)
    for need in (1, 2, 7, 40):
        loads = [r.randrange(6) for _ in range(5)]
        ways = spark.createDataFrame([(1, i) for i in range(5)], "cohort long, route_id long")
        held = [(1, 1000 + 10 * i + j, i) for i, n in enumerate(loads) for j in range(n)]
        matched = spark.createDataFrame(held + [(1, k, None) for k in range(need)], "cohort long, commuter long, route long")
        got = {x.commuter: x.route for x in M.fallback(matched, ways).where("commuter < 1000").collect()}
        for k in range(need):
            i = min(range(5), key=lambda x: (loads[x], x))
            assert got[k] == i
            loads[i] += 1


def test_a_station_whose_ratio_is_zero_has_no_row_in_either(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, 1, "view", 2.0, "{}"), (2, at, 1, "click", 0.0, "{}"), (3, at, 2, "view", 2.0, "{}"), (4, at, 2, "click", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/all")
    shutil.copy(next((tmp_path / "all").glob("*.parquet")), tmp_path / "events.parquet")
    assert same(spark, registry.QUERIES["io9_ratio_cache"], registry.ORACLES["io9_ratio_cache"], str(tmp_path)) == 1
