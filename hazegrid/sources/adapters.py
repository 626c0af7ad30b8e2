"""Domain tables derived from the given star schema, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import floor_hour

POLLUTANTS = ("pm10", "pm25", "no2", "so2", "co")
EVENT_OF = {"view": "pm10", "click": "pm25", "purchase": "no2", "signup": "so2", "error": "co"}
AIR = {"no2": "nitrogen_dioxide", "so2": "sulphur_dioxide", "pm25": "pm2_5", "pm10": "pm10", "co": "carbon_monoxide"}
WEATHER = ("wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "temperature_2m", "relative_humidity_2m", "surface_pressure")


def _case(column, pairs: dict):
    out = None
    for k, v in pairs.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out


class Tables:
    """The domain tables over one folder of Parquet tables; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def readings(self) -> DataFrame:
        e = self.raw("events")
        sensor = F.col("user_id") * 10 + _case(F.col("event_type"), {k: i for i, k in enumerate(EVENT_OF)})
        return e.select(F.col("event_id"), F.col("ts").alias("time"), F.col("user_id").alias("station_id"), F.concat(F.lit("station_"), F.col("user_id")).alias("station_name"), _case(F.col("event_type"), EVENT_OF).alias("parameter"), "value", F.lit("ug/m3").alias("unit"), sensor.cast("long").alias("sensor_id"))

    def station_meta(self) -> DataFrame:
        i = F.col("id")
        ids = self.raw("events").select(F.col("user_id").alias("id")).distinct()
        sensors = F.map_from_arrays(F.array(*[F.lit(p) for p in POLLUTANTS]), F.array(*[i * 10 + k for k in range(5)]))
        return ids.select("id", F.concat(F.lit("station_"), i).alias("name"), (F.lit(12.834) + (i * 37 % 311) / 1000.0).alias("lat"), (F.lit(77.461) + (i * 53 % 321) / 1000.0).alias("lon"), sensors.alias("sensors"))

    def weather_hourly(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        h = self.raw("events").select(floor_hour(F.col("ts")).alias("time"), k.alias("k")).groupBy("time").agg(F.avg("k").alias("a"), F.sum("k").alias("s"))
        a, speed = F.col("a"), F.lit(0.2) + F.col("a") / 20
        return h.select("time", speed.alias("wind_speed_10m"), (F.col("s") * 7 % 360).alias("wind_direction_10m"), (speed * 1.5).alias("wind_gusts_10m"), (15 + a / 5).alias("temperature_2m"), (30 + a / 2).alias("relative_humidity_2m"), (900 + a / 10).alias("surface_pressure"))

    def air_hourly(self) -> DataFrame:
        r = self.readings().select(floor_hour(F.col("time")).alias("time"), "parameter", "value")
        gap = F.hour("time") % 5 == 0
        return r.groupBy("time").agg(*[F.avg(F.when((F.col("parameter") == p) & ~gap, F.col("value"))).alias(c) for p, c in AIR.items()])

    def road_nodes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(k.alias("osmid"), (770000 + k * 7919 % 30011).cast("double").alias("x"), (1420000 + k * 10473 % 34019).cast("double").alias("y"))

    def road_edges(self) -> DataFrame:
        n = self.raw("part").agg(F.count("*").alias("n"))
        li = self.raw("lineitem").crossJoin(F.broadcast(n))  # one row
        v = (F.col("l_partkey") + 1 + (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 40) % F.col("n")
        kind = F.when(F.col("l_returnflag") == "R", "['Primary', 'secondary']").when(F.col("l_returnflag") == "A", "Residential;service").otherwise("tertiary")
        e = li.select(F.col("l_partkey").alias("u"), v.alias("v"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", (20 + 10 * F.col("l_quantity")).alias("length"), kind.alias("highway"), F.least(F.lit(1.0), F.col("l_discount") * 9).alias("building_density"))
        from pyspark.sql import Window

        key = F.row_number().over(Window.partitionBy("u", "v").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")) - 1
        return e.select("u", "v", key.alias("key"), "length", "highway", "building_density")

    def grid(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(F.floor(k / 1000).cast("long").alias("grid_id"), F.floor(k % 1000 / 40).cast("long").alias("r"), (k % 40).alias("c"), (F.col("p_retailprice") / 10).alias("concentration"), ((F.col("p_size") % 7) / 3.0).alias("wind_u"), ((F.col("p_size") % 5) / 3.0).alias("wind_v"))

    def commuters(self) -> DataFrame:
        k = F.col("c_custkey")
        mode = _case(F.col("c_mktsegment"), {"BUILDING": "jogger", "HOUSEHOLD": "jogger", "FURNITURE": "cyclist", "AUTOMOBILE": "two_wheeler", "MACHINERY": "car"})
        return self.raw("customer").select(F.col("c_nationkey").cast("long").alias("cohort"), k.alias("id"), mode.alias("mode"), (1.5 + (k % 7) * 0.25).alias("id_min"), (6000 + k * 13 % 40 * 100).cast("double").alias("distance_tolerance_m"))

    def routes(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(F.col("s_nationkey").cast("long").alias("cohort"), k.alias("route_id"), (5 + (k * 29 % 97) / 4.0).alias("dose"), (1500 + k * 71 % 50 * 100).cast("double").alias("distance_m"))

    def od_requests(self) -> DataFrame:
        """One request a customer."""
        n = self.raw("part").agg(F.count("*").alias("n"))
        k = F.col("c_custkey")
        return self.raw("customer").crossJoin(F.broadcast(n)).select(k.alias("request_id"), (k * 7 % F.col("n")).alias("source"), ((k * 7 + 60 + k * 13 % 30) % F.col("n")).alias("target"), F.col("c_nationkey").cast("long").alias("cohort"))  # one row

    def predictions(self) -> DataFrame:
        r = self.readings().where("parameter = 'pm25'").groupBy(floor_hour(F.col("time")).alias("time"), "station_id").agg(F.avg("value").alias("target"))
        return r.select("time", "station_id", "target", (F.col("target") * 0.9 + 1).alias("pred"), ((F.col("station_id") % 10) / 9.0).alias("weight"), (F.col("station_id") % 3 == 0).alias("train_mask"))

    def payloads(self) -> DataFrame:
        topic = _case(F.col("event_type"), {"view": "sensors:live", "click": "sensors:live", "purchase": "airquality:live", "signup": "airquality:live", "error": "weather:live"})
        return self.raw("events").select("event_id", topic.alias("stream"), "ts", F.col("props").alias("payload"))


_CASE = "CASE event_type WHEN 'view' THEN 'pm10' WHEN 'click' THEN 'pm25' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'so2' WHEN 'error' THEN 'co' END"

#: (needs, SQL) of each table.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": ((), f"SELECT event_id, ts AS time, user_id AS station_id, 'station_' || user_id AS station_name, {_CASE} AS parameter, value, 'ug/m3' AS unit, CAST(user_id * 10 + CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS BIGINT) AS sensor_id FROM events"),
    "hourly": (("readings",), "SELECT parameter, station_id, station_name, date_trunc('hour', time)::TIMESTAMP AS time, avg(value) AS value FROM readings WHERE value IS NOT NULL GROUP BY ALL"),
    "station_meta": ((), "SELECT id, 'station_' || id AS name, 12.834::DOUBLE + (id * 37 % 311) / 1000.0::DOUBLE AS lat, 77.461::DOUBLE + (id * 53 % 321) / 1000.0::DOUBLE AS lon FROM (SELECT DISTINCT user_id AS id FROM events)"),
    "weather_hourly": ((), "SELECT time, 0.2::DOUBLE + a / 20 AS wind_speed_10m, s * 7 % 360 AS wind_direction_10m, (0.2::DOUBLE + a / 20) * 1.5::DOUBLE AS wind_gusts_10m, 15 + a / 5 AS temperature_2m, 30 + a / 2 AS relative_humidity_2m, 900 + a / 10 AS surface_pressure FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS time, avg(k) AS a, sum(k) AS s FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1)"),
    "air_hourly": (("readings",), "SELECT date_trunc('hour', time)::TIMESTAMP AS time, " + ", ".join(f"avg(value) FILTER (parameter = '{p}' AND hour(time) % 5 <> 0) AS {c}" for p, c in AIR.items()) + " FROM readings GROUP BY 1"),
    "road_nodes": ((), "SELECT p_partkey AS osmid, CAST(770000 + p_partkey * 7919 % 30011 AS DOUBLE) AS x, CAST(1420000 + p_partkey * 10473 % 34019 AS DOUBLE) AS y FROM part"),
    "road_edges": ((), "SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS key, length, highway, building_density FROM (SELECT l_partkey AS u, (l_partkey + 1 + (l_orderkey * 31 + l_linenumber * 17) % 40) % (SELECT count(*) FROM part) AS v, l_orderkey, l_linenumber, l_suppkey, l_quantity, 20 + 10 * l_quantity AS length, CASE l_returnflag WHEN 'R' THEN '[''Primary'', ''secondary'']' WHEN 'A' THEN 'Residential;service' ELSE 'tertiary' END AS highway, least(1.0::DOUBLE, l_discount * 9) AS building_density FROM lineitem)"),
    "grid": ((), "SELECT p_partkey // 1000 AS grid_id, p_partkey % 1000 // 40 AS r, p_partkey % 40 AS c, p_retailprice / 10 AS concentration, (p_size % 7) / 3.0::DOUBLE AS wind_u, (p_size % 5) / 3.0::DOUBLE AS wind_v FROM part"),
    "commuters": ((), "SELECT CAST(c_nationkey AS BIGINT) AS cohort, c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'jogger' WHEN 'HOUSEHOLD' THEN 'jogger' WHEN 'FURNITURE' THEN 'cyclist' WHEN 'AUTOMOBILE' THEN 'two_wheeler' WHEN 'MACHINERY' THEN 'car' END AS mode, 1.5::DOUBLE + (c_custkey % 7) * 0.25::DOUBLE AS id_min, CAST(6000 + c_custkey * 13 % 40 * 100 AS DOUBLE) AS distance_tolerance_m FROM customer"),
    "routes": ((), "SELECT CAST(s_nationkey AS BIGINT) AS cohort, s_suppkey AS route_id, 5 + (s_suppkey * 29 % 97) / 4.0::DOUBLE AS dose, CAST(1500 + s_suppkey * 71 % 50 * 100 AS DOUBLE) AS distance_m FROM supplier"),
    "od_requests": ((), "SELECT c_custkey AS request_id, c_custkey * 7 % (SELECT count(*) FROM part) AS source, (c_custkey * 7 + 60 + c_custkey * 13 % 30) % (SELECT count(*) FROM part) AS target, CAST(c_nationkey AS BIGINT) AS cohort FROM customer"),
    "predictions": (("readings",), "SELECT time, station_id, target, target * 0.9::DOUBLE + 1 AS pred, (station_id % 10) / 9.0::DOUBLE AS weight, station_id % 3 = 0 AS train_mask FROM (SELECT date_trunc('hour', time)::TIMESTAMP AS time, station_id, avg(value) AS target FROM readings WHERE parameter = 'pm25' GROUP BY ALL)"),
    "payloads": ((), "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'sensors:live' WHEN event_type IN ('purchase', 'signup') THEN 'airquality:live' ELSE 'weather:live' END AS stream, ts, props AS payload FROM events"),
}


def with_tables(names: str, body: str, more: dict[str, str] | None = None) -> str:
    """SQL with the named tables, what they need, and further ones before `body`."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in parts:
            needs, sql = SQL[name]
            for x in needs:
                add(x)
            parts[name] = sql

    for name in names.split():
        add(name)
    parts |= more or {}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" + body if parts else body
