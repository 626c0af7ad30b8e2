"""The stored master table: incremental syncs equal a full build, and read and write affected days only."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import gapfill, master, sync

START = dt.datetime(2024, 1, 1)
NODES = "station_id long, station_name string, node_id long, distance_meters double"


def hour(k):
    return START + dt.timedelta(hours=k)


def sources(spark, seed, hours, stations=4):
    rng = random.Random(seed)
    rows = []
    for s in range(stations):
        for k in range(hours):
            for p in sync.POLLUTANTS:
                # some columns fall silent for long, some start late, station 3 never has co or pm10
                if rng.random() < 0.3 and not (s == 3 and p in ("co", "pm10")) and not (s == 1 and p == "so2" and 20 < k < 60) and not (s == 2 and p == "so2" and k < 50):
                    rows.append((hour(k) + dt.timedelta(minutes=rng.randint(0, 59)), s, f"station_{s}", p, float(rng.randint(1, 90))))
    readings = spark.createDataFrame(rows, "time timestamp_ntz, station_id long, station_name string, parameter string, value double")
    weather = spark.createDataFrame([(hour(k), float(k % 7) if k % 5 else None) for k in range(hours)], "time timestamp_ntz, wind_speed_10m double")
    air = spark.createDataFrame([(hour(k), float(k % 11) if k % 3 else None) for k in range(hours)], "time timestamp_ntz, pm10 double")
    return readings, weather, air


def rows_of(df):
    cols = sorted(c for c in df.columns if c != "day")
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_equal_one_build(spark, tmp_path, seed):
    readings, weather, air = sources(spark, seed, 96)
    nodes = spark.createDataFrame([(s, f"station_{s}", s * 10, 1.5 * s) for s in range(4)], NODES)
    at, rng = str(tmp_path / "master"), random.Random(seed)
    sync.statistics(readings, nodes, weather, air, at)
    ends = [*sorted(rng.sample(range(10, 95), 3)), 96]
    upto = [0, 0, 0]
    for i, k in enumerate(ends):
        late = [0, 0, 0] if k == 96 else [0, rng.randint(0, 9), rng.randint(-5, 9)]
        upto = [max(u, k - x) for u, x in zip(upto, late)]  # sources grow, each at its own pace
        cut = [d.where(F.col("time") < F.lit(hour(u)).cast("timestamp_ntz")) for d, u in zip((readings, weather, air), upto)]
        if i == 0:
            sync.create(cut[0], nodes, *cut[1:], at)
        else:
            made = sync.sync(cut[0], nodes, *cut[1:], at)
            assert made.horizon == cut[0].agg(F.date_trunc("hour", F.max("time"))).first()[0]
    full = master.filled(master.joined(gapfill.hourly_mean(readings), nodes, weather, air, spark.read.parquet(f"{at}/ratios")), spark.read.parquet(f"{at}/medians"))
    assert rows_of(sync.read(spark, at)) == rows_of(full)
    again = sync.sync(readings, nodes, weather, air, at)
    assert (again.new_hours, again.days) == (0, 0)


def files(at):
    return {d: sorted(f for f in os.listdir(f"{at}/rows/{d}") if f.endswith(".parquet")) for d in os.listdir(f"{at}/rows") if d.startswith("day=")}


def test_only_affected_days_are_read_and_written(spark, tmp_path):
    readings, weather, air = sources(spark, 5, 24 * 6, stations=2)
    nodes = spark.createDataFrame([(0, "a", 0, 0.0)], NODES)
    at = str(tmp_path / "master")
    sync.statistics(readings, nodes, weather, air, at)
    cut = [d.where(F.col("time") < F.lit(hour(24 * 5)).cast("timestamp_ntz")) for d in (readings, weather, air)]
    sync.create(cut[0], nodes, *cut[1:], at)
    before = files(at)
    state, done, _ = sync._state(spark, at)
    fresh = sync._wide(sync._after(readings, "time", done["readings"]), spark.read.parquet(f"{at}/ratios"))
    start, old = sync.affected(spark, at, fresh, state, [])
    assert start.date() >= dt.date(2024, 1, 5)
    assert "PartitionFilters: [isnotnull(day" in old._jdf.queryExecution().executedPlan().toString()
    report = sync.sync(readings, nodes, weather, air, at)
    after = files(at)
    assert report.from_day == start.date() and report.days == 2 and report.new_hours == fresh.select("timestamp").distinct().count()
    assert all(after[d] == f for d, f in before.items() if d < f"day={start.date()}")
    assert after[f"day={start.date()}"] != before[f"day={start.date()}"] and "day=2024-01-06" in after


def test_a_run_that_died_is_run_again(spark, tmp_path, monkeypatch):
    readings, weather, air = sources(spark, 7, 60, stations=3)
    nodes = spark.createDataFrame([(s, "x", s, 0.0) for s in range(3)], NODES)
    at = str(tmp_path / "master")
    sync.statistics(readings, nodes, weather, air, at)
    cut = [d.where(F.col("time") < F.lit(hour(40)).cast("timestamp_ntz")) for d in (readings, weather, air)]
    sync.create(cut[0], nodes, *cut[1:], at)
    put = sync._put_state

    def dies(*a):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(sync, "_put_state", dies)
    with pytest.raises(RuntimeError):
        sync.sync(readings, nodes, weather, air, at)
    monkeypatch.setattr(sync, "_put_state", put)
    sync.sync(readings, nodes, weather, air, at)
    full = master.filled(master.joined(gapfill.hourly_mean(readings), nodes, weather, air, spark.read.parquet(f"{at}/ratios")), spark.read.parquet(f"{at}/medians"))
    assert rows_of(sync.read(spark, at)) == rows_of(full)
