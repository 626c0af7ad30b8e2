"""Queries of the cleaning, audit and backfill operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazegrid.functions import clean, timeutil
from hazegrid.operators import backfill, quality, series
from hazegrid.operators import gapfill as G
from hazegrid.operators.ratios import modal_units
from hazegrid.operators.scratch import shared_dir
from hazegrid.plans.registry import query, r6
from hazegrid.sources.adapters import POLLUTANTS


@query("p1_local_time", "readings", "SELECT event_id, time + INTERVAL 330 MINUTE AS local_time, date_trunc('hour', time + INTERVAL 330 MINUTE)::TIMESTAMP AS local_hour FROM readings")
def _(t):
    local = timeutil.to_local(F.col("time"))
    return t.readings().select("event_id", local.alias("local_time"), timeutil.floor_hour(local).alias("local_hour"))


@query("p3_keep_pollutants", "readings", "SELECT parameter, count(*) AS rows, round(sum(value), 4) AS total FROM readings WHERE parameter IN ('pm10', 'no2') AND value IS NOT NULL GROUP BY 1")
def _(t):
    return clean.keep_pollutants(t.readings(), ("pm10", "no2")).groupBy("parameter").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("p4_year_or_all", "readings", "SELECT 2024 AS year, count(*) FILTER (year(time) = 2024) AS rows FROM readings UNION ALL SELECT 1999, count(*) FROM readings")
def _(t):
    one = lambda y: timeutil.in_year(t.readings(), "time", y).agg(F.lit(y).alias("year"), F.count("*").alias("rows"))
    return one(2024).unionAll(one(1999))


@query("p5_time_window_of_other", "readings air_hourly", "SELECT parameter, count(*) AS rows FROM readings WHERE time BETWEEN (SELECT min(time) FROM air_hourly WHERE hour(time) >= 6) AND (SELECT max(time) FROM air_hourly WHERE hour(time) >= 6) GROUP BY 1")
def _(t):
    return timeutil.between_bounds(t.readings(), "time", t.air_hourly().where(F.hour("time") >= 6), "time").groupBy("parameter").agg(F.count("*").alias("rows"))


@query("p6_lookback_stride", "hourly", "SELECT parameter, station_id, time FROM hourly WHERE time >= (SELECT max(time) FROM hourly) - INTERVAL 7 DAY AND epoch(time)::BIGINT // 3600 % 3 = 0")
def _(t):
    return timeutil.lookback(G.hourly_mean(t.readings()), "time", 7, 3).select("parameter", "station_id", "time")


@query("p7_horizon_floor", "readings", "SELECT count(*) AS rows, min(time) AS first FROM readings WHERE time >= TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    return timeutil.since(t.readings(), "time", "2024-01-10").agg(F.count("*").alias("rows"), F.min("time").alias("first"))


@query("p8_reading_repair", "", "SELECT o_orderkey, round(least(abs(CASE WHEN v >= 1000 THEN CAST(substr(CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR), 1, 3) AS DOUBLE) ELSE v END), 250), 6) AS value FROM (SELECT o_orderkey, o_totalprice / 50 - 600 AS v FROM orders)")
def _(t):
    return t.raw("orders").select("o_orderkey", clean.repair_reading(F.col("o_totalprice") / 50 - 600).alias("value")).select("o_orderkey", *r6("value"))


@query("p9_pm25_units", "readings", "SELECT event_id, round(greatest(0, least(500, CASE WHEN mx < 0.005 AND q < 0.002 THEN v * 1e9 ELSE v END)), 6) AS v FROM (SELECT event_id, value / 1e6 / 10 AS v FROM readings WHERE parameter = 'pm25'), (SELECT max(value / 1e6 / 10) AS mx, quantile_cont(value / 1e6 / 10, 0.99) AS q FROM readings WHERE parameter = 'pm25')")
def _(t):
    r = t.readings().where("parameter = 'pm25'").select("event_id", (F.col("value") / 1e6 / 10).alias("v"))
    return clean.repair_pm25_units(r, "v", "v").select("event_id", *r6("v"))


@query("p10_physical_clamps", "weather_hourly", "SELECT time, round(greatest(0, least(100, relative_humidity_2m)), 6) AS humidity, round(greatest(10, least(50, temperature_2m)), 6) AS temperature, round(greatest(800, least(1000, surface_pressure)), 6) AS level FROM weather_hourly")
def _(t):
    return t.weather_hourly().select("time", clean.clamp(F.col("relative_humidity_2m"), 0.0, 100.0).alias("humidity"), clean.clamp(F.col("temperature_2m"), 10.0, 50.0).alias("temperature"), clean.clamp(F.col("surface_pressure"), 800.0, 1000.0).alias("level")).select("time", *r6("humidity", "temperature", "level"))


@query("p11_median_fill", "air_hourly", "SELECT time, " + ", ".join(f"round(coalesce(CASE WHEN {c} <> 0 THEN {c} END, (SELECT coalesce(median({c}) FILTER ({c} <> 0), 1) FROM air_hourly)), 6) AS {c}" for c in ("pm2_5", "pm10", "nitrogen_dioxide")) + " FROM air_hourly")
def _(t):
    return clean.fill_with_median(t.air_hourly(), ("pm2_5", "pm10", "nitrogen_dioxide")).select("time", *r6("pm2_5", "pm10", "nitrogen_dioxide"))


@query("p12_road_class", "road_edges", "SELECT CASE highway WHEN '[''Primary'', ''secondary'']' THEN 'primary' WHEN 'Residential;service' THEN 'residential' ELSE 'tertiary' END AS road, count(*) AS edges FROM road_edges GROUP BY 1")
def _(t):
    return t.road_edges().groupBy(clean.road_class(F.col("highway")).alias("road")).agg(F.count("*").alias("edges"))


@query("p13_bias_correction", "grid", "SELECT grid_id, r, c, round(greatest(0, concentration * 1.15::DOUBLE - 120), 6) AS corrected FROM grid")
def _(t):
    return t.grid().select("grid_id", "r", "c", clean.bias_corrected(F.col("concentration"), 1.15, -120.0).alias("corrected")).select("grid_id", "r", "c", *r6("corrected"))


@query("p14_safe_float", "", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 12.97) AS lat FROM events")
def _(t):
    return t.raw("events").select("event_id", clean.safe_double(F.get_json_object("props", "$.k"), -1.0).alias("k"), clean.safe_double(F.col("event_type"), 12.97).alias("lat"))


@query("p15_bbox", "station_meta", "SELECT id FROM station_meta WHERE lat BETWEEN 12.9 AND 13.0 AND lon BETWEEN 77.5 AND 77.7")
def _(t):
    return t.station_meta().where(clean.in_bbox(F.col("lat"), F.col("lon"), "12.9,77.5,13.0,77.7")).select("id")


@query("p16_mode_lookup", "commuters", "SELECT mode, count(*) AS n, max(CASE mode WHEN 'jogger' THEN 2.75 WHEN 'cyclist' THEN 1.8 WHEN 'two_wheeler' THEN 0.65 ELSE 0.65::DOUBLE * 1.41::DOUBLE END::DOUBLE) AS ir, max(CASE WHEN mode IN ('car', 'two_wheeler') THEN 0.6 WHEN mode = 'cyclist' THEN 3.5 ELSE 1.2 END::DOUBLE) AS rmv FROM commuters GROUP BY 1")
def _(t):
    as_rmv = F.when(F.col("mode") == "cyclist", "Cycling").when(F.col("mode") == "jogger", "walking").otherwise(F.col("mode"))
    return t.commuters().groupBy("mode").agg(F.count("*").alias("n"), F.max(clean.inhalation_rate(F.col("mode"))).alias("ir"), F.max(clean.minute_volume(as_rmv)).alias("rmv"))


@query("p17_zscore", "air_hourly", "SELECT time, round(CAST(CAST((coalesce(pm10, 0) - (SELECT avg(coalesce(pm10, 0)) FROM air_hourly)) / ((SELECT stddev_pop(coalesce(pm10, 0)) FROM air_hourly) + 1e-8) AS FLOAT) AS DOUBLE) + 1e-7, 4) AS pm10 FROM air_hourly")
def _(t):
    return clean.scale_features(t.air_hourly(), ["pm10"]).select("time", F.round(F.col("pm10").cast("double") + 1e-7, 4).alias("pm10"))


@query("p17_scaler_table", "air_hourly", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(coalesce({c}, 0)), 6) AS mean, round(stddev_pop(coalesce({c}, 0)), 6) AS std FROM air_hourly" for c in ("pm10", "pm2_5")))
def _(t):
    return clean.scaler_table(t.air_hourly(), ["pm10", "pm2_5"]).select("feature", *r6("mean", "std"))


@query("p18_target_scale", "predictions", "SELECT time, station_id, round(target / greatest(50, (SELECT quantile_cont(target, 0.95) FROM predictions)), 6) AS y_scaled FROM predictions")
def _(t):
    return clean.scale_target(t.predictions(), "target").select("time", "station_id", *r6("y_scaled"))


@query("a10_modal_unit", "readings", "SELECT parameter, u AS unit FROM (SELECT parameter, CASE WHEN station_id % 3 = 0 THEN 'ppb' ELSE unit END AS u, row_number() OVER (PARTITION BY parameter ORDER BY count(*) DESC, CASE WHEN station_id % 3 = 0 THEN 'ppb' ELSE unit END) AS rn FROM readings GROUP BY 1, 2) WHERE rn = 1".replace("GROUP BY 1, 2", "GROUP BY parameter, CASE WHEN station_id % 3 = 0 THEN 'ppb' ELSE unit END"))
def _(t):
    return modal_units(t.readings().withColumn("unit", F.when(F.col("station_id") % 3 == 0, "ppb").otherwise(F.col("unit"))))


@query("a15_null_counts", "air_hourly", "SELECT count(*) AS rows, count(*) - count(time) AS null_time, " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in ("no2", "pm10")) + " FROM (SELECT time, nitrogen_dioxide AS no2, pm10 FROM air_hourly)")
def _(t):
    return quality.null_counts(t.air_hourly().select("time", F.col("nitrogen_dioxide").alias("no2"), "pm10"))


@query("a15_null_counts_by_file", "", "SELECT 'events.parquet' AS file, count(*) AS rows, " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events")
def _(t):
    e = t.raw("events").withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1))
    return quality.null_counts(e, ["file"])


@query("a16_key_audit", "readings", "SELECT sum(n) AS rows, sum(n - 1) AS duplicates, sum(nt) AS null_times FROM (SELECT count(*) AS n, count(*) FILTER (time IS NULL) AS nt FROM readings GROUP BY station_id, parameter, date_trunc('day', time))".replace("sum(n)", "CAST(sum(n) AS BIGINT)").replace("sum(n - 1)", "CAST(sum(n - 1) AS BIGINT)").replace("sum(nt)", "CAST(sum(nt) AS BIGINT)"))
def _(t):
    return quality.key_audit(t.readings().withColumn("day", F.to_date("time")), ["station_id", "parameter", "day"], "time")


@query("a17_coverage", "readings", "SELECT min(time) AS first, max(time) AS last, (SELECT string_agg(DISTINCT CAST(year(time) AS VARCHAR), ',' ORDER BY CAST(year(time) AS VARCHAR)) FROM readings) AS years, count(DISTINCT station_id) AS distinct_station_id, count(DISTINCT parameter) AS distinct_parameter FROM readings")
def _(t):
    return quality.coverage(t.readings(), "time", ["station_id", "parameter"])


@query("a18_horizon", "readings", "SELECT max(date_trunc('hour', time))::TIMESTAMP AS horizon, count(DISTINCT date_trunc('hour', time)) FILTER (date_trunc('hour', time) > TIMESTAMP '2024-01-20 00:00:00') AS new_hours FROM readings")
def _(t):
    return quality.horizon(t.readings(), "time", "2024-01-20 00:00:00")


@query("a19_contiguity", "hourly", "SELECT station_id, count(*) AS steps, count(*) FILTER (d <> 3600) AS bad_steps FROM (SELECT station_id, epoch(time) - lag(epoch(time)) OVER (PARTITION BY station_id ORDER BY time) AS d FROM (SELECT DISTINCT station_id, time FROM hourly)) GROUP BY 1")
def _(t):
    return quality.contiguity(G.hourly_mean(t.readings()), ["station_id"], "time")


@query("m23_time_audit", "", "SELECT 'ts' AS column, 'timestamp_ntz' AS type, count(*) AS rows, CAST(count(ts) AS DOUBLE) / count(*) AS parsed FROM events UNION ALL SELECT 'ts_text_date', 'string', count(*), CAST(count(try_cast(CAST(ts AS VARCHAR) AS TIMESTAMP)) AS DOUBLE) / count(*) FROM events")
def _(t):
    e = t.raw("events")
    return quality.time_audit(e.select("*", F.col("ts").cast("string").alias("ts_text_date")))


DAYS = {"days": "SELECT DISTINCT station_id, CAST(time AS DATE) AS day FROM readings WHERE station_id % 4 <> 0 AND day(time) % 6 <> 0 AND day(time) NOT BETWEEN 8 AND 10"}


def day_table(t):
    d = t.readings().select("station_id", F.to_date("time").alias("day")).distinct()
    return d.where("station_id % 4 <> 0 and day(day) % 6 <> 0 and day(day) not between 8 and 10")


@query("w6_missing_day_ranges", "readings", "SELECT CAST(min(day) AS VARCHAR) AS date_from, CAST(max(day) AS VARCHAR) AS date_to, count(*) AS days FROM (SELECT day, CAST(epoch(day) / 86400 AS BIGINT) - row_number() OVER (ORDER BY day) AS g FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day EXCEPT SELECT day FROM days)) GROUP BY g", DAYS)
def _(t):
    d = quality.missing_days(day_table(t), "day", "2024-01-01", "2024-01-31").withColumn("k", F.lit(0))
    return series.date_ranges(d, ["k"], "day").select(F.col("date_from").cast("string"), F.col("date_to").cast("string"), "days")


@query("u2_missing_stations", "readings station_meta", "SELECT id AS station_id FROM station_meta EXCEPT SELECT station_id FROM days", DAYS)
def _(t):
    return quality.missing_keys(t.station_meta().select(F.col("id").alias("station_id")), day_table(t), ["station_id"])


@query("u3_missing_days", "readings", "SELECT CAST(day AS VARCHAR) AS day FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day EXCEPT SELECT day FROM days)", DAYS)
def _(t):
    return quality.missing_days(day_table(t), "day", "2024-01-01", "2024-01-31").select(F.col("day").cast("string"))


@query("u4_absent_years", "readings", "SELECT y AS year FROM (SELECT unnest([2022, 2023, 2024, 2025]) AS y) WHERE y NOT IN (SELECT year(time) FROM readings)")
def _(t):
    want = t.spark.createDataFrame([(2022,), (2023,), (2024,), (2025,)], "year int")
    return quality.missing_keys(want, t.readings().select(F.year("time").alias("year")), ["year"])


@query("u5_key_overlap", "readings", "SELECT count(*) FILTER (a = 1) AS left_keys, count(*) FILTER (b = 1) AS right_keys, count(*) FILTER (a = 1 AND b = 1) AS shared_keys FROM (SELECT station_id, h, max(a) AS a, max(b) AS b FROM (SELECT station_id, date_trunc('hour', time) AS h, CASE WHEN parameter = 'pm10' THEN 1 ELSE 0 END AS a, CASE WHEN parameter = 'pm25' THEN 1 ELSE 0 END AS b FROM readings) GROUP BY 1, 2)")
def _(t):
    h = t.readings().select("station_id", "parameter", timeutil.floor_hour(F.col("time")).alias("h"))
    return quality.key_overlap(h.where("parameter = 'pm10'"), h.where("parameter = 'pm25'"), ["station_id", "h"])


@query("w7_keep_last", "readings", "SELECT station_id, parameter, h, event_id FROM (SELECT *, date_trunc('hour', time)::TIMESTAMP AS h, row_number() OVER (PARTITION BY station_id, parameter, date_trunc('hour', time) ORDER BY event_id DESC) AS rn FROM readings) WHERE rn = 1")
def _(t):
    r = t.readings().withColumn("h", timeutil.floor_hour(F.col("time")))
    return series.keep_last(r, ["station_id", "parameter", "h"], "event_id").select("station_id", "parameter", "h", "event_id")


@query("w9_first_per_coordinate", "station_meta", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY round(lat + 1e-9, 2), round(lon + 1e-9, 2) ORDER BY id) AS rn FROM station_meta) WHERE rn = 1")
def _(t):
    m = t.station_meta().withColumns({"_a": F.round(F.col("lat") + 1e-9, 2), "_b": F.round(F.col("lon") + 1e-9, 2)})
    return series.keep_one(m, ["_a", "_b"], [F.col("id")]).select("id")


TASKS = DAYS | {
    "gaps": "SELECT min(day) AS date_from, max(day) AS date_to FROM (SELECT day, CAST(epoch(day) / 86400 AS BIGINT) - row_number() OVER (ORDER BY day) AS g FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day EXCEPT SELECT day FROM days)) GROUP BY g",
    "base": "SELECT id AS station_id, 'missing_station' AS task_type, DATE '2024-01-01' AS date_from, DATE '2024-12-31' AS date_to FROM station_meta WHERE id NOT IN (SELECT station_id FROM days) UNION ALL SELECT station_id, 'missing_range', date_from, date_to FROM (SELECT DISTINCT station_id FROM days), gaps",
    "sens": "SELECT id AS station_id, unnest(['pm10', 'pm25', 'no2', 'so2', 'co']) AS parameter, unnest([id * 10, id * 10 + 1, id * 10 + 2, id * 10 + 3, id * 10 + 4]) AS sensor_id FROM station_meta",
}


@query("u7_backfill_tasks", "readings station_meta", "SELECT '2024|' || station_id || '|' || parameter || '|' || date_from || '|' || date_to AS task_id, station_id, task_type, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, parameter, sensor_id FROM base JOIN sens USING (station_id)", TASKS)
def _(t):
    x = backfill.tasks(t.station_meta().select(F.col("id").alias("station_id")), day_table(t), t.station_meta(), 2024)
    return x.select("task_id", "station_id", "task_type", F.col("date_from").cast("string"), F.col("date_to").cast("string"), "parameter", "sensor_id")


@query("t3_task_order", "readings station_meta", "SELECT '2024|' || station_id || '|' || parameter || '|' || date_from || '|' || date_to AS task_id FROM base JOIN sens USING (station_id) ORDER BY station_id, parameter, date_from LIMIT 50", TASKS)
def _(t):
    x = backfill.tasks(t.station_meta().select(F.col("id").alias("station_id")), day_table(t), t.station_meta(), 2024)
    return backfill.ordered(x, 50).select("task_id")


def pull_events(t):
    d = t.readings().where("parameter in ('pm25', 'co')")
    return d.select(F.concat_ws("|", "station_id", "parameter").alias("task_id"), "station_id", "parameter", "sensor_id", F.lit(2023).alias("year"), F.when(F.col("station_id") % 2 == 0, "confirmed_missing").otherwise("inserted").alias("status"), (F.col("station_id") % 5).alias("inserted_rows")).distinct()


EVENTS = {"ev": "SELECT DISTINCT station_id || '|' || parameter AS task_id, station_id, parameter, sensor_id, CASE WHEN station_id % 2 = 0 THEN 'confirmed_missing' ELSE 'inserted' END AS status, station_id % 5 AS inserted_rows FROM readings WHERE parameter IN ('pm25', 'co')"}


@query("u8_retry_tasks", "readings", "SELECT task_id, CAST(sensor_id AS VARCHAR) || ',' || CAST(sensor_id + 5 AS VARCHAR) AS sensor_ids FROM ev WHERE status = 'confirmed_missing'", EVENTS)
def _(t):
    e = pull_events(t)
    cand = e.select("station_id", "parameter", F.array(F.col("sensor_id") + 5, F.col("sensor_id"), F.col("sensor_id") + 5).alias("candidates"))
    return backfill.retries(e, cand, 2023).select("task_id", F.array_join(F.transform("sensor_ids", lambda x: x.cast("string")), ",").alias("sensor_ids"))


@query("a29_event_summary", "readings", "SELECT count(*) AS tasks, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'already_present') AS already_present, count(*) FILTER (status = 'confirmed_missing') AS confirmed_missing, count(*) FILTER (status = 'failed') AS failed, CAST(sum(inserted_rows) AS BIGINT) AS inserted_rows FROM ev", EVENTS)
def _(t):
    return backfill.event_summary(pull_events(t))


UPSERT = {"st": "SELECT * FROM readings WHERE event_id % 2 = 0", "fe": "SELECT *, 'task_' || station_id % 20 AS task_id FROM readings WHERE event_id % 3 = 0 AND station_id % 7 <> 3"}


@query("u9_upsert", "readings", "SELECT event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY station_id, parameter, time ORDER BY seq DESC) AS rn FROM (SELECT event_id, station_id, parameter, time, event_id AS seq FROM st UNION ALL SELECT event_id, station_id, parameter, time, event_id + 1000000000 FROM fe)) WHERE rn = 1", UPSERT)
def _(t):
    r = t.readings()
    a = r.where("event_id % 2 = 0").withColumn("seq", F.col("event_id"))
    b = r.where("event_id % 3 = 0 and station_id % 7 <> 3").withColumn("seq", F.col("event_id") + 1000000000)
    return backfill.upsert(a, b, ["station_id", "parameter", "time"], "seq").select("event_id", "seq")


def fetch(t):
    """(tasks, fetched): forty tasks of two years, some of which fail or bring nothing; every sixth row is fetched twice and every tenth by two tasks."""
    spark, r = t.spark, t.readings()
    k = F.col("station_id") % 40
    rows = r.where("event_id % 3 = 0 and station_id % 40 < 36").select("event_id", "station_id", "parameter", "time", k.alias("k"), F.explode(F.when(F.col("event_id") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    both = rows.unionByName(rows.where("event_id % 10 = 0").withColumn("k", (F.col("k") + 1) % 36))
    fetched = both.select("event_id", "station_id", "parameter", "time", F.concat(F.lit("task_"), F.col("k").cast("string")).alias("task_id"), (F.col("k") * 1000000000 + F.col("event_id") * 2 + F.col("copy") + 100000000000).alias("seq"))
    tasks = spark.range(40).select(F.concat(F.lit("task_"), F.col("id").cast("string")).alias("task_id"), F.when(F.col("id") % 9 == 8, 2023).otherwise(2024).alias("year"), F.when(F.col("id") == 37, 500).when(F.col("id") == 38, 404).otherwise(200).alias("http_status"))
    return tasks, fetched


FETCH = {
    "st": "SELECT DISTINCT station_id, parameter, time FROM readings WHERE event_id % 2 = 0",
    "one": "SELECT *, station_id % 40 AS k, unnest(CASE WHEN event_id % 6 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM readings WHERE event_id % 3 = 0 AND station_id % 40 < 36",
    "fe": "SELECT station_id, parameter, time, k, k * 1000000000 + event_id * 2 + copy AS seq FROM (SELECT * FROM one UNION ALL SELECT * REPLACE ((k + 1) % 36 AS k) FROM one WHERE event_id % 10 = 0)",
    "tk": "SELECT range AS k, 'task_' || range AS task_id, CASE WHEN range % 9 = 8 THEN 2023 ELSE 2024 END AS year, CASE range WHEN 37 THEN 500 WHEN 38 THEN 404 ELSE 200 END AS http_status FROM range(40)",
    "inside": "SELECT fe.* FROM fe JOIN tk USING (k) WHERE year(time) = year",
    # the store as each task leaves it, from the number of its keys before and after
    "size": "SELECT tk.k, (SELECT count(*) FROM (SELECT station_id, parameter, time FROM st UNION SELECT station_id, parameter, time FROM inside i WHERE i.k <= tk.k)) AS after, (SELECT count(*) FROM (SELECT station_id, parameter, time FROM st UNION SELECT station_id, parameter, time FROM inside i WHERE i.k < tk.k)) AS before FROM tk",
    "cnt": "SELECT tk.k, (SELECT count(*) FROM fe WHERE fe.k = tk.k) AS raw, (SELECT count(*) FROM inside WHERE inside.k = tk.k) AS api FROM tk",
}


@query("u9_upsert_events", "readings", "SELECT task_id, http_status, raw AS raw_api_rows, api AS api_rows, raw - api AS year_filtered_out_rows, api - (after - before) AS dedupe_overlap_rows, after - before AS inserted_rows, CASE WHEN after > before THEN 'success' WHEN api > 0 OR http_status = 200 THEN 'confirmed_missing' ELSE 'failed' END AS status, CASE WHEN after > before THEN 'inserted_new_rows' WHEN api > 0 THEN 'not_inserted_all_rows_already_present_after_dedupe' WHEN http_status <> 200 THEN 'http_status_' || http_status WHEN raw > 0 THEN 'not_inserted_rows_outside_target_year' ELSE 'api_returned_no_rows_for_requested_window' END AS message FROM tk JOIN size USING (k) JOIN cnt USING (k)", FETCH)
def _(t):
    tasks, fetched = fetch(t)
    return backfill.upsert_events(t.readings().where("event_id % 2 = 0"), fetched, tasks, ["station_id", "parameter", "time"], "time", "seq")


@query("u9_merge", "readings", "SELECT station_id, parameter, time, seq FROM (SELECT *, row_number() OVER (PARTITION BY station_id, parameter, time ORDER BY seq DESC) AS rn FROM (SELECT station_id, parameter, time, event_id AS seq FROM readings WHERE event_id % 2 = 0 UNION ALL SELECT station_id, parameter, time, seq + 100000000000 FROM fe WHERE day(time) % 3 = 1)) WHERE rn = 1", FETCH)
def _(t):
    """A store by day into which the fetched rows of every third day are merged."""
    at, keys = f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}", ["station_id", "parameter", "time"]
    r = t.readings().where("event_id % 2 = 0").select(*keys, F.col("event_id").alias("seq"))
    with_day = lambda df: df.withColumn("day", F.to_date("time"))
    with_day(series.keep_last(r, keys, "seq")).repartition("day").write.partitionBy("day").parquet(at)
    backfill.merge(at, with_day(fetch(t)[1].select(*keys, "seq").where("day(time) % 3 = 1")), keys, "seq", "day")
    return t.spark.read.parquet(at).select("station_id", "parameter", "time", "seq")
