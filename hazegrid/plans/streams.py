"""Queries of the stream and source operators, as far as they are tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import floor_hour
from hazegrid.operators import ratios as R
from hazegrid.operators import gapfill as G
from hazegrid.operators.scratch import shared_dir
from hazegrid.plans import graphs
from hazegrid.plans.registry import query, r6
from hazegrid.sources import files, json_sources
from hazegrid.streaming import state, streams


def scratch(t) -> str:
    """A new folder under the shared one, for what a query stores and reads again."""
    return f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"


def as_stream(t, df):
    """A table as a stream: stored once, then read as files."""
    at = scratch(t)
    df.write.parquet(at)
    return t.spark.readStream.schema(df.schema).parquet(at)


def drained(t, stream, mode: str = "append"):
    at = scratch(t)
    streams.run_once(stream, f"{at}/out", f"{at}/check", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("s1_latest_payloads", "payloads", "SELECT stream, arg_max(payload, (ts, event_id)) AS payload FROM payloads GROUP BY 1")
def _(t):
    return streams.latest(t.payloads()).select("stream", "payload")


@query("s2_retention", "payloads", "SELECT stream, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, event_id DESC) AS rn FROM payloads) WHERE rn <= 30")
def _(t):
    return streams.retain(t.payloads(), 30).select("stream", "event_id")


@query("s2_retention_stream", "payloads", "SELECT stream, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, event_id DESC) AS rn FROM payloads) WHERE rn <= 30")
def _(t):
    at = scratch(t)
    s = as_stream(t, t.payloads().withColumn("ts", F.col("ts").cast("timestamp")))
    q = s.writeStream.foreachBatch(streams.retain_into(f"{at}/kept", 30)).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return t.spark.read.schema(streams.SCHEMA).parquet(f"{at}/kept/v{last}").select("stream", "event_id")


@query("s4_streaming_hourly_means", "readings", "SELECT CAST(date_trunc('hour', time) AS VARCHAR) AS hour, station_id, parameter, round(avg(value), 6) AS value FROM readings WHERE date_trunc('hour', time) < (SELECT date_trunc('hour', max(time) - INTERVAL 2 HOUR) FROM readings) GROUP BY ALL")
def _(t):
    r = t.readings().select(F.col("time").cast("timestamp").alias("ts"), "station_id", "parameter", "value")
    h = drained(t, streams.hourly_means(as_stream(t, r)))
    return h.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "station_id", "parameter", *r6("value"))


@query("s5_streaming_dedup", "readings", "SELECT count(*) AS rows FROM (SELECT DISTINCT station_id, parameter, time FROM readings)")
def _(t):
    r = t.readings().select(F.col("time").cast("timestamp").alias("ts"), "station_id", "parameter", "value")
    d = drained(t, streams.drop_duplicates(as_stream(t, r.unionAll(r)), ["ts", "station_id", "parameter"], "40 days"))
    return d.agg(F.count("*").alias("rows"))


LATEST = {n.replace(":", "_"): f"SELECT ts, arg_max(payload, event_id) AS {n.replace(':', '_')} FROM payloads WHERE stream = '{n}' GROUP BY ts" for n in ("weather:live", "sensors:live")}


@query("j16_latest_state_join", "payloads", "SELECT s.snapshot_id, weather_live, sensors_live FROM (SELECT event_id AS snapshot_id, ts + INTERVAL 90 SECOND AS ts FROM payloads) s ASOF LEFT JOIN weather_live w ON s.ts >= w.ts ASOF LEFT JOIN sensors_live e ON s.ts >= e.ts", LATEST)
def _(t):
    p = t.payloads()
    s = p.select(F.col("event_id").alias("snapshot_id"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"))
    return streams.as_of(s, p, ["weather:live", "sensors:live"]).drop("ts")


@query("io10_publish", "weather_hourly", "SELECT CAST(time AS VARCHAR) AS ts, round(wind_speed_10m, 6) AS speed FROM weather_hourly")
def _(t):
    p = streams.publish(t.weather_hourly(), "weather:live", ["wind_speed_10m", "surface_pressure"], "time")
    return p.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.from_json("payload", "wind_speed_10m DOUBLE")["wind_speed_10m"].alias("speed")).select("ts", *r6("speed"))


@query("io3_hourly_json", "readings", "SELECT station_id, date_trunc('hour', time)::TIMESTAMP AS time, round(max(value), 6) AS pm10 FROM readings WHERE parameter = 'pm10' GROUP BY ALL")
def _(t):
    h = t.readings().where("parameter = 'pm10'").groupBy("station_id", floor_hour(F.col("time")).alias("time")).agg(F.max("value").alias("v"))
    j = h.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("time", "v"))).alias("a"))
    js = j.select("station_id", F.to_json(F.struct(F.struct(F.transform("a", lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform("a", lambda x: x["v"]).alias("pm10")).alias("hourly"))).alias("payload"))
    return json_sources.hourly_series(js, "payload", ["pm10"], ["station_id"]).select("station_id", "time", *r6("pm10"))


@query("io4_measurement_json", "readings", "SELECT event_id, date_trunc('second', time)::TIMESTAMP AS time, round(value, 6) AS value, unit FROM readings")
def _(t):
    r = t.readings().select("event_id", F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("local")).alias("datetimeFrom")).alias("period"), "value", F.struct(F.col("parameter").alias("name"), F.col("unit").alias("units")).alias("parameter"))).alias("results"))).alias("payload"))
    return json_sources.measurements(r, "payload", ["event_id"]).select("event_id", "time", *r6("value"), "unit")


@query("io5_station_json", "station_meta", "SELECT id, round(lat, 6) AS lat, id * 10 + 7 AS pm10 FROM station_meta WHERE id % 4 <> 0")
def _(t):
    i = F.col("id")
    s = lambda k, n: F.struct((i * 10 + k).alias("id"), F.struct(F.lit(n).alias("name")).alias("parameter"))
    m = t.station_meta().select(F.to_json(F.struct(F.array(F.struct("id", "name", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinates"), F.when(i % 4 == 0, F.array(s(1, "o3"))).otherwise(F.array(s(0, "pm10"), s(1, "o3"), s(7, "pm10"))).alias("sensors"))).alias("results"))).alias("payload"))
    return json_sources.stations(m, "payload").select("id", *r6("lat"), F.col("sensors")["pm10"].alias("pm10"))


@query("io6_live_json", "readings", "SELECT event_id, round(value, 6) AS no2 FROM readings WHERE parameter = 'no2' AND station_id % 3 <> 0")
def _(t):
    r = t.readings().where("parameter = 'no2'").select("event_id", F.to_json(F.struct(F.when(F.col("station_id") % 3 == 0, "error").otherwise("ok").alias("status"), F.struct(F.struct(F.struct(F.col("value").alias("v")).alias("no2")).alias("iaqi")).alias("data"))).alias("payload"))
    return json_sources.live_sensors(r, "payload", ["event_id"]).select("event_id", *r6("no2"))


@query("io1_io7_parquet_round_trip", "readings", "SELECT parameter, count(*) AS rows, round(sum(value), 4) AS total FROM readings WHERE parameter IN ('pm10', 'pm25') GROUP BY 1")
def _(t):
    at, r = scratch(t), t.readings()
    files.write_parquet(r.where("parameter = 'pm10'"), f"{at}/2023.parquet")
    files.write_parquet(r.where("parameter = 'pm25'"), f"{at}/2024.parquet")
    files.write_parquet(r.select("unit").distinct(), f"{at}/odd.parquet")
    d = files.read_station_files(t.spark, [f"{at}/{n}.parquet" for n in ("2023", "2024", "odd")], ["time", "parameter", "value", "station_id"])
    return d.groupBy("parameter").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("io9_ratio_cache", "hourly", "SELECT 'pm25' AS pollutant, count(*) AS rows FROM (SELECT station_id, coalesce(avg(pm25 / pm10) FILTER (pm10 > 0), avg(pm25) / CASE WHEN avg(pm10) > 0 THEN avg(pm10) END) AS ratio FROM (SELECT station_id, time, avg(value) FILTER (parameter = 'pm10') AS pm10, avg(value) FILTER (parameter = 'pm25') AS pm25 FROM hourly GROUP BY ALL) GROUP BY 1) WHERE ratio > 0 HAVING count(*) > 0")
def _(t):
    build = lambda: R.ratio_table(R.pivot_hourly(G.hourly_mean(t.readings())))
    at = scratch(t)
    R.load_or_build(t.spark, at, build)
    return R.load_or_build(t.spark, at, build).where("pollutant = 'pm25'").groupBy("pollutant").agg(F.count("*").alias("rows"))


@query("io2_folder_read", "readings", "SELECT parameter, time, round(value, 6) AS value FROM readings")
def _(t):
    at, r = scratch(t), t.readings().select(F.col("time").alias("timestamp"), "parameter", "value")
    r.write.parquet(at)
    r.agg(F.count("*").alias("rows")).write.parquet(f"{at}-meta")
    # the writer names its files itself, so the summary is moved beside the others under its own name
    fs, paths = files.file_system(t.spark, at)
    part = next(p for p in files.listed(t.spark, f"{at}-meta") if p.endswith(".parquet"))
    fs.rename(paths(part), paths(f"{at}/meta.parquet"))
    return files.read_folder(t.spark, at).select("parameter", "time", *r6("value"))


@query("io8_csv_metrics", "hourly", "SELECT parameter, count(*) AS n, round(avg(value), 4) AS mean FROM hourly GROUP BY 1")
def _(t):
    at = scratch(t)
    files.write_csv(G.hourly_mean(t.readings()).groupBy("parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), at)
    return t.spark.read.schema("parameter STRING, n LONG, mean DOUBLE").csv(at, header=True).select("parameter", "n", F.round("mean", 4).alias("mean"))


@query("s3_periodic_refresh", "payloads", "SELECT stream, arg_max(payload, (ts, event_id)) AS payload FROM payloads GROUP BY 1")
def _(t):
    at, p = scratch(t), t.payloads()
    p.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{at}/in")
    q = streams.refresh(streams.read_payloads(t.spark, f"{at}/in", 1 << 30), lambda b, e: b.select("stream", "payload").write.mode("overwrite").parquet(f"{at}/out-{e}"), f"{at}/check", "1 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.read.schema("stream STRING, payload STRING").parquet(f"{at}/out-0")


def by_time(t, payloads, files: int = 4) -> str:
    """Payloads as files of consecutive times, whose names are in order: a micro-batch each."""
    at = scratch(t)
    p = payloads.select("event_id", "stream", F.col("ts").cast("timestamp").alias("ts"), "payload")
    edges = p.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (edges.hi - edges.lo) / files
    for k in range(files):
        part = p.where((F.col("ts") >= F.lit(edges.lo + k * step)) & ((F.col("ts") < F.lit(edges.lo + (k + 1) * step)) if k < files - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(at)
    return at


@query("s2_keyed_state", "payloads", "SELECT stream, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, event_id DESC) AS rn FROM payloads) WHERE rn <= 30")
def _(t):
    """Four micro-batches through list state; the last comes again, late and repeated."""
    at = scratch(t)
    first = by_time(t, t.payloads().unionByName(t.payloads().where("event_id % 5 = 0")))
    s = state.newest(streams.read_payloads(t.spark, first, 1), 30)
    q = s.writeStream.outputMode("update").foreachBatch(state.newest_into(f"{at}/kept")).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return state.read_newest(t.spark, f"{at}/kept").select("stream", "event_id")


LIVE = graphs.FUSED | {
    "sn": "SELECT 0 AS snapshot_id, w.wind_speed_10m AS ws, w.wind_direction_10m AS wd, coalesce(a.nitrogen_dioxide, 0) AS no2, coalesce(a.sulphur_dioxide, 0) AS so2, coalesce(a.pm2_5, 0) AS pm FROM (SELECT * FROM weather_hourly ORDER BY time DESC LIMIT 1) w, (SELECT * FROM air_hourly ORDER BY time DESC LIMIT 1) a",
    "st": f"SELECT u, v, s, CASE WHEN d <= 75 THEN exp(-(d * d) / 2450) ELSE 0 END AS dw, 1 / (2 * pi() * ew * sy * sz) * exp(-pow(sin(radians(d)) * length, 2) / (2 * sy * sy)) * exp(-4 / (2 * sz * sz)) AS pl, 1 + 0.6::DOUBLE * bd + 0.15::DOUBLE * greatest(0, 1 - least(1, ew / 3)) AS cf FROM (SELECT u, v, s, length, bd, {graphs.ANGLE.format(a='bearing', b='wdir')} AS d, greatest(2, 0.2::DOUBLE * greatest(1, length)) AS sy, greatest(1, 0.06::DOUBLE * greatest(1, length)) AS sz, greatest(0.2, wsp * (1 - 0.55::DOUBLE * bd)) AS ew FROM (SELECT se.u, se.v, length, bd, bearing, toxicity AS s, greatest(0.2, ws) AS wsp, ((degrees(atan2(ws * cos(radians(wd)), ws * sin(radians(wd)))) % 360) + 360) % 360 AS wdir FROM se JOIN fused USING (u, v), sn))",
} | graphs._step("st", "q1") | graphs._step("q1", "q2")


@query("s3_road_state", "road_nodes road_edges weather_hourly air_hourly", "SELECT u, v, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("no2", "so2", "pm2_5", "toxicity")) + ", round(q2.s + 1e-7, 4) AS spread FROM fused JOIN q2 USING (u, v)", LIVE)
def _(t):
    """Hourly weather and city air and one sensor as payloads, four micro-batches; the road state after the last."""
    at = scratch(t)
    sensor = t.weather_hourly().select("time", F.lit("11.5").alias("no2"), F.lit("n/a").alias("so2"), F.lit("30").alias("pm2_5"), F.lit("12.95").alias("lat"), F.lit("77.60").alias("lon"))
    topics = [streams.publish(df, topic, cols, "time") for df, topic, cols in ((t.weather_hourly(), "weather:live", ["wind_speed_10m", "wind_direction_10m"]), (t.air_hourly(), "airquality:live", ["nitrogen_dioxide", "sulphur_dioxide", "pm2_5"]), (sensor, "sensors:live", ["no2", "so2", "pm2_5", "lat", "lon"]))]
    payloads = reduce(DataFrame.unionByName, topics).withColumn("event_id", F.unix_seconds("ts"))
    job = state.refresh_roads(t.road_edges(), t.road_nodes(), graphs.simple(t), f"{at}/state")
    s = streams.read_payloads(t.spark, by_time(t, payloads), 1)
    q = s.writeStream.foreachBatch(job).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return state.read_roads(t.spark, f"{at}/state").select("u", "v", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("no2", "so2", "pm2_5", "toxicity", "spread")])
