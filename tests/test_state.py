"""Streaming state: list state against the batch form, restarts, and epochs that are run again."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.functions import physics
from hazegrid.operators import diffusion, graph
from hazegrid.streaming import state, streams

T0 = dt.datetime(2024, 1, 1)
PAYLOADS = "event_id long, stream string, ts timestamp, payload string"


def put(spark, at, rows):
    spark.createDataFrame(rows, PAYLOADS).coalesce(1).write.mode("append").parquet(at)


def drain(spark, at, out, n, idle=None, per=1):
    s = streams.read_payloads(spark, at, per)
    s = state.newest(s if idle is None else s.withWatermark("ts", "0 seconds"), n, idle)
    q = s.writeStream.outputMode("update").foreachBatch(state.newest_into(f"{out}/kept")).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_list_state_equals_batch_after_a_restart(spark, tmp_path):
    rng, at, out = random.Random(1), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, rng.choice(["weather:live", "sensors:live", "a/b c"]), T0 + dt.timedelta(minutes=rng.randint(0, 300)), f"p{i}") for i in range(200)]
    rows += rng.sample(rows, 40)  # payloads come again, in any batch
    rng.shuffle(rows)
    for k in range(3):
        put(spark, at, rows[k * 60 : (k + 1) * 60])
    drain(spark, at, out, 7)
    put(spark, at, rows[180:])  # the query starts anew from its checkpoint
    put(spark, at, [(999, "new", T0, "x"), (1000, None, T0, "no stream"), (1001, "new", None, "no time")])
    drain(spark, at, out, 7)
    want = streams.retain(spark.createDataFrame(sorted(set(rows)) + [(999, "new", T0, "x")], PAYLOADS), 7)
    key = lambda df: sorted((r.stream, r.event_id, r.payload) for r in df.collect())
    assert key(state.read_newest(spark, f"{out}/kept")) == key(want)


def test_silent_streams_are_forgotten(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[(1, "a", T0, "x"), (2, "b", T0, "y")], [(3, "b", T0 + dt.timedelta(hours=5), "z")], [(4, "b", T0 + dt.timedelta(hours=6), "z")]]):
        put(spark, at, rows)
        drain(spark, at, out, 3, "2 hours")
    assert sorted({r.stream for r in state.read_newest(spark, f"{out}/kept").collect()}) == ["b"]


def road(spark):
    nodes = spark.createDataFrame([(i, 770000.0 + 100 * i, 1420000.0 + 37 * (i * i % 11)) for i in range(12)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(i, (i + s) % 12, 0, 50.0 * s, "tertiary", 0.1 * s) for i in range(12) for s in (1, 2, 5)], "u long, v long, key int, length double, highway string, building_density double")
    simple = graph.with_bearing(graph.simple_edges(edges, ["length", "building_density"]), nodes)
    return edges, nodes, simple


def payload(stream, minute, event, **values):
    import json

    return (event, stream, T0 + dt.timedelta(minutes=minute), json.dumps(values))


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_road_state_and_an_epoch_that_is_run_again(spark, tmp_path):
    edges, nodes, simple = road(spark)
    path = str(tmp_path / "state")
    job = state.refresh_roads(edges, nodes, simple, path)
    batches = [
        [payload("weather:live", 1, 1, wind_speed_10m=3.0, wind_direction_10m=40.0)],
        [payload("airquality:live", 2, 2, nitrogen_dioxide=20.0, sulphur_dioxide=5.0, pm2_5=30.0), payload("weather:live", 0, 3, wind_speed_10m=9.0, wind_direction_10m=1.0)],  # late weather does not count
        [payload("sensors:live", 3, 4, no2="44", so2="n/a", pm2_5="7", lat="12.9", lon="77.5"), payload("airquality:live", 4, 5, nitrogen_dioxide=25.0, sulphur_dioxide=6.0, pm2_5=31.0)],
        [],
    ]
    for epoch, rows in enumerate(batches):
        job(spark.createDataFrame(rows, PAYLOADS), epoch)
        made = rows_of(state.read_roads(spark, path))
        job(spark.createDataFrame(rows, PAYLOADS), epoch)  # the same epoch after a failure
        assert rows_of(state.read_roads(spark, path)) == made
        assert len(made) == 36 and state.versions(spark, f"{path}/roads") == list(range(max(0, epoch - 1), epoch + 1))
    # a crash between the two tables of an epoch
    os.remove(f"{path}/roads/v3/_SUCCESS")
    assert state.versions(spark, f"{path}/roads")[-1] == 2
    job(spark.createDataFrame(batches[3], PAYLOADS), 3)
    assert rows_of(state.read_roads(spark, path)) == made
    # as one batch: the newest payloads fused and spread
    snap = state.snapshot(spark.createDataFrame([batches[0][0], *batches[2]], PAYLOADS))
    points = diffusion.snapshot_points(snap)
    fused = diffusion.fuse(edges, nodes, points)
    turn = F.radians("wind_dir")
    speed, direction = physics.wind_state(F.col("wind_speed") * F.sin(turn), F.col("wind_speed") * F.cos(turn))
    spread = diffusion.propagate(fused.select("u", "v", F.col("toxicity").alias("s")), simple, points.select(speed.alias("wind_speed"), direction.alias("wind_dir")), 2)
    want = fused.join(spread, ["u", "v"]).select("u", "v", "no2", "so2", "pm2_5", "toxicity", "s")
    assert rows_of(want) == made
    left = [d for d in os.listdir(spark.sparkContext.getConf().get("spark.checkpoint.dir")) if d.startswith("rounds-")]
    assert all(not os.path.exists(f"{d}/fused-0") for d in left)


def test_road_state_shuffles_no_state_of_edges(spark, monkeypatch):
    """Edges are stored fused and spread from means by node; the joins of edges by (u, v) are not made."""
    for name in ("fuse", "propagate"):
        monkeypatch.setattr(diffusion, name, lambda *a, **k: pytest.fail("joins edges with edges"))
    newest = spark.createDataFrame([payload("weather:live", 1, 1, wind_speed_10m=3.0, wind_direction_10m=40.0)], PAYLOADS)
    rows, rounds = state.road_state(road(spark)[2], newest)
    assert rows.count() == 36 and rows.where("spread is null").isEmpty()
    rounds.close()
