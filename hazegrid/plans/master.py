"""Queries of the ratio, master and spine operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazegrid.functions.timeutil import floor_hour
from hazegrid.operators import gapfill as G
from hazegrid.operators import master as M
from hazegrid.operators import ratios as R
from hazegrid.operators import sync
from hazegrid.operators.scratch import shared_dir
from hazegrid.plans.registry import query, r6
from hazegrid.sources.adapters import AIR, POLLUTANTS, WEATHER

P = [f"station_{p}" for p in POLLUTANTS]
WIDE = {
    "wide": "SELECT station_id, time, " + ", ".join(f"avg(value) FILTER (parameter = '{p}') AS {p}" for p in POLLUTANTS) + " FROM hourly GROUP BY ALL",
    "per": "SELECT station_id, " + ", ".join(f"coalesce(avg({p} / pm10) FILTER (pm10 > 0), avg({p}) / CASE WHEN avg(pm10) > 0 THEN avg(pm10) END) AS {p}" for p in R.TARGETS) + " FROM wide GROUP BY 1",
    "ratio": " UNION ALL ".join(f"SELECT station_id, '{p}' AS pollutant, {p} AS ratio FROM per WHERE {p} > 0" for p in R.TARGETS),
    "gmean": "SELECT pollutant, avg(ratio) AS g FROM ratio GROUP BY 1",
    "imp": "SELECT w.station_id, w.time, w.pm10, w.so2, " + ", ".join(f"coalesce(w.{p}, w.pm10 * coalesce((SELECT ratio FROM ratio r WHERE r.station_id = w.station_id AND r.pollutant = '{p}'), (SELECT g FROM gmean WHERE pollutant = '{p}'))) AS {p}" for p in R.TARGETS) + " FROM wide w",
}


def wide(t):
    return R.pivot_hourly(G.hourly_mean(t.readings()))


def node_map(t):
    """Stations to nodes by arithmetic; the nearest-node query makes a real one."""
    i = F.col("id")
    return t.station_meta().select(i.alias("station_id"), F.col("name").alias("station_name"), (i * 13 % 199).alias("node_id"), (i % 90).cast("double").alias("distance_meters"))


@query("a2_hourly_prefixed", "weather_hourly", "SELECT time AS timestamp, " + ", ".join(f"round({c}, 6) AS weather_{c}" for c in WEATHER) + " FROM weather_hourly")
def _(t):
    return M.hourly_prefixed(t.weather_hourly(), "weather_").select("timestamp", *r6(*[f"weather_{c}" for c in WEATHER]))


@query("a3_parameter_pivot", "hourly", "SELECT station_id, time, " + ", ".join(f"round({p}, 6) AS {p}" for p in POLLUTANTS) + " FROM wide", WIDE)
def _(t):
    return wide(t).select("station_id", "time", *r6(*POLLUTANTS))


@query("a4_ratio_table", "hourly", "SELECT station_id, pollutant, round(ratio, 6) AS ratio, round(g, 6) AS global_ratio FROM ratio JOIN gmean USING (pollutant)", WIDE)
def _(t):
    return R.ratio_table(wide(t)).select("station_id", "pollutant", *r6("ratio", "global_ratio"))


@query("c3_ratio_imputation", "hourly", "SELECT station_id, time, " + ", ".join(f"round({p}, 6) AS {p}" for p in POLLUTANTS) + " FROM imp", WIDE)
def _(t):
    w = wide(t)
    return R.impute(w, R.ratio_table(w)).select("station_id", "time", *r6(*POLLUTANTS))


@query("j5_observed_wins_union", "hourly", "SELECT time, station_id, parameter, round(value, 6) AS value, source FROM (SELECT time, station_id, parameter, value, 'observed' AS source FROM readings UNION ALL SELECT * FROM (SELECT DISTINCT ON (time, station_id, parameter) b.time, b.station_id, b.parameter, b.value * coalesce(r.ratio, g.g) AS value, 'ratio' AS source FROM (SELECT *, unnest(['pm25', 'no2', 'co']) AS p2 FROM readings WHERE parameter = 'pm10') b0, LATERAL (SELECT b0.time, b0.station_id, b0.p2 AS parameter, b0.value) b LEFT JOIN ratio r ON r.station_id = b.station_id AND r.pollutant = b.parameter JOIN gmean g ON g.pollutant = b.parameter) m WHERE NOT EXISTS (SELECT 1 FROM readings o WHERE o.time = m.time AND o.station_id = m.station_id AND o.parameter = m.parameter))", WIDE)
def _(t):
    r = t.readings()
    return R.impute_raw(r, R.ratio_table(wide(t)), R.modal_units(r)).select("time", "station_id", "parameter", *r6("value"), "source")


@query("w8_keep_first", "readings", "SELECT station_id, parameter, h, source FROM (SELECT *, row_number() OVER (PARTITION BY station_id, parameter, h ORDER BY source, event_id) AS rn FROM (SELECT station_id, parameter, date_trunc('hour', time)::TIMESTAMP AS h, event_id, event_id % 2 AS source FROM readings)) WHERE rn = 1")
def _(t):
    from hazegrid.operators.series import keep_one

    r = t.readings().select("station_id", "parameter", floor_hour(F.col("time")).alias("h"), "event_id", (F.col("event_id") % 2).alias("source"))
    return keep_one(r, ["station_id", "parameter", "h"], [F.col("source"), F.col("event_id")]).select("station_id", "parameter", "h", "source")


ENRICH = WIDE | {"nodes": "SELECT id AS station_id, name AS station_name, id * 13 % 199 AS node_id, CAST(id % 90 AS DOUBLE) AS distance_meters FROM station_meta"}


@query("j1_j2_enrich", "hourly station_meta weather_hourly air_hourly", "SELECT w.station_id, w.time AS timestamp, node_id, round(pm25, 6) AS station_pm25, round(h.wind_speed_10m, 6) AS weather_wind_speed_10m, round(a.pm10, 6) AS city_pm10 FROM imp w LEFT JOIN nodes n ON n.station_id = w.station_id LEFT JOIN weather_hourly h ON h.time = w.time LEFT JOIN air_hourly a ON a.time = w.time".replace("round(pm25", "round(w.pm25"), ENRICH)
def _(t):
    w = wide(t)
    s = R.impute(w, R.ratio_table(w)).select(F.col("time").alias("timestamp"), "station_id", *[F.col(p).alias(f"station_{p}") for p in POLLUTANTS])
    j = M.enrich(s, node_map(t), M.hourly_prefixed(t.weather_hourly(), "weather_"), M.hourly_prefixed(t.air_hourly(), "city_"))
    return j.select("station_id", "timestamp", "node_id", *r6("station_pm25", "weather_wind_speed_10m", "city_pm10"))


@query("j3_inner_audit_join", "hourly station_meta weather_hourly air_hourly", "SELECT count(*) AS rows, count(DISTINCT w.station_id) AS stations FROM wide w JOIN nodes n USING (station_id) JOIN weather_hourly h USING (time) JOIN (SELECT * FROM air_hourly WHERE pm10 IS NOT NULL) a USING (time)", ENRICH)
def _(t):
    s = wide(t).withColumnRenamed("time", "timestamp")
    j = M.enrich(s, node_map(t), M.hourly_prefixed(t.weather_hourly(), "weather_"), M.hourly_prefixed(t.air_hourly().where("pm10 is not null"), "city_"), "inner")
    return j.agg(F.count("*").alias("rows"), F.countDistinct("station_id").alias("stations"))


def _lin(column: str) -> str:
    return f"SELECT station_id, time, CASE WHEN v IS NOT NULL THEN v WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (rn - p.rn) / (n.rn - p.rn) ELSE coalesce(p.v, n.v) END AS v FROM (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'v': v, 'rn': rn}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(CASE WHEN v IS NOT NULL THEN {{'v': v, 'rn': rn}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM (SELECT station_id, time, {column} AS v, row_number() OVER (PARTITION BY station_id ORDER BY time) AS rn FROM imp) WINDOW w AS (PARTITION BY station_id ORDER BY time))"


MASTER = ENRICH | {f"lin_{p}": _lin(p) for p in POLLUTANTS} | {
    "joined": "SELECT w.station_id, w.time AS timestamp, " + ", ".join(f"lin_{p}.v AS station_{p}" for p in POLLUTANTS) + ", " + ", ".join(f"h.{c} AS weather_{c}" for c in WEATHER) + ", " + ", ".join(f"a.{c} AS city_{c}" for c in AIR.values()) + " FROM imp w " + " ".join(f"JOIN lin_{p} USING (station_id, time)" for p in POLLUTANTS) + " LEFT JOIN weather_hourly h ON h.time = w.time LEFT JOIN air_hourly a ON a.time = w.time",
}
COLUMNS = [*P, *[f"weather_{c}" for c in WEATHER], *[f"city_{c}" for c in AIR.values()]]
MASTER["meds"] = "SELECT " + ", ".join(f"coalesce(median({c}), 0) AS {c}" for c in COLUMNS) + " FROM joined"
MASTER["master"] = "SELECT station_id, timestamp, " + ", ".join(f"coalesce(joined.{c}, meds.{c}) AS {c}" for c in COLUMNS) + " FROM joined, meds"


def master(t):
    return M.build(G.hourly_mean(t.readings()), node_map(t), t.weather_hourly(), t.air_hourly())


@query("c4_master_table", "hourly station_meta weather_hourly air_hourly", "SELECT station_id, timestamp, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + " FROM master", MASTER)
def _(t):
    return master(t).select("station_id", "timestamp", *r6(*COLUMNS))


@query("c5_incremental_sync", "hourly station_meta weather_hourly air_hourly", "SELECT station_id, timestamp, round(station_pm10, 6) AS station_pm10 FROM master WHERE timestamp > TIMESTAMP '2024-01-25 00:00:00'", MASTER)
def _(t):
    m = master(t)
    done = t.spark.createDataFrame([("2024-01-25 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("timestamp"))
    fresh = M.incremental(m, done)
    out = fresh if M.needs_rebuild([(t.readings(), "time"), (t.weather_hourly(), "time")], done, "timestamp") else fresh.limit(0)
    return out.select("station_id", "timestamp", *r6("station_pm10"))


@query("c5_incremental_stages", "hourly station_meta weather_hourly air_hourly", "SELECT station_id, timestamp, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + " FROM master", MASTER)
def _(t):
    """Built up to a day, brought up to a later one, weather late, and then to the end: as if built at once."""
    at = f"{shared_dir(t.spark)}/master-{uuid.uuid4().hex}"
    full = (t.readings(), t.weather_hourly(), t.air_hourly())
    sync.statistics(full[0], node_map(t), *full[1:], at)
    for k, day in enumerate(("2024-01-12", "2024-01-22", None)):
        cut = [d if day is None else d.where(F.col("time") < F.lit(day).cast("timestamp_ntz") - F.expr(f"INTERVAL {late} HOURS")) for d, late in zip(full, (0, 30, 6))]
        (sync.sync if k else sync.create)(cut[0], node_map(t), *cut[1:], at)
    return sync.read(t.spark, at).select("station_id", "timestamp", *r6(*COLUMNS))


SPINE = {
    "obs": "SELECT station_id, date_trunc('hour', time)::TIMESTAMP AS time, avg(value) AS v, min(station_name) AS station_name FROM readings WHERE parameter = 'pm10' GROUP BY ALL",
    "hours": "SELECT unnest(generate_series((SELECT min(time) FROM obs), (SELECT max(time) FROM obs), INTERVAL 1 HOUR)) AS time",
    "cells": "SELECT s.station_id, h.time, o.v, o.station_name, row_number() OVER (PARTITION BY s.station_id ORDER BY h.time) AS rn FROM (SELECT DISTINCT station_id FROM obs) s CROSS JOIN hours h LEFT JOIN obs o ON o.station_id = s.station_id AND o.time = h.time",
    "filled": "SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'v': v, 'rn': rn} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(CASE WHEN v IS NOT NULL THEN {'v': v, 'rn': rn} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM cells WINDOW w AS (PARTITION BY station_id ORDER BY time)",
}


@query("c6_hourly_spine", "readings", "SELECT station_id, time, round(CASE WHEN v IS NOT NULL THEN v WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (rn - p.rn) / (n.rn - p.rn) ELSE coalesce(p.v, n.v) END, 6) AS value, 'station_' || station_id AS station_name FROM filled", SPINE)
def _(t):
    r = t.readings().where("parameter = 'pm10'").select("station_id", "time", "value", "station_name")
    return M.hourly_spine(r, "station_id", "time", ["value"], ["station_name"]).select("station_id", "time", *r6("value"), "station_name")


@query("a11_dedupe_keys", "readings", "SELECT station_id, time, round(v, 6) AS value, station_name FROM obs", {"obs": SPINE["obs"]})
def _(t):
    r = t.readings().where("parameter = 'pm10'").select("station_id", floor_hour(F.col("time")).alias("time"), "value", "station_name")
    return M.dedupe(r, ["station_id", "time"]).select("station_id", "time", *r6("value"), "station_name")


@query("j8_city_repair", "hourly station_meta air_hourly", "SELECT a.time, " + ", ".join(f"round(coalesce(a.{c}, e.{c}), 6) AS {c}" for c in AIR.values()) + " FROM air_hourly a LEFT JOIN est e USING (time)", {
    "md": "SELECT id AS station_id, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(12.9716::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(12.9716::DOUBLE)) * pow(sin(radians(77.5946::DOUBLE - lon) / 2), 2)))) AS d FROM station_meta",
    "est": "SELECT time, " + ", ".join(f"sum(value / (d * d)) FILTER (parameter = '{p}') / sum(1 / (d * d)) FILTER (parameter = '{p}') AS {c}" for p, c in AIR.items()) + " FROM hourly JOIN md USING (station_id) GROUP BY 1",
})
def _(t):
    out = M.city_repair(t.air_hourly(), G.hourly_mean(t.readings()), t.station_meta(), AIR, (12.9716, 77.5946))
    return out.select("time", *r6(*AIR.values()))
