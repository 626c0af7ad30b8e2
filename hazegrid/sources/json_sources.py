"""Row shaping of the JSON that weather, air-quality and sensor services give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLLUTANTS = ("pm10", "pm25", "no2", "so2", "co")


def hourly_series(df: DataFrame, payload: str, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """{"hourly": {"time": [...], "var": [...], ...}} to a row an hour; short or absent arrays give nulls."""
    schema = "hourly STRUCT<time: ARRAY<STRING>, " + ", ".join(f"`{v}`: ARRAY<DOUBLE>" for v in variables) + ">"
    h = df.select(*keep, F.from_json(payload, schema).alias("p")).select(*keep, F.explode(F.arrays_zip(*[F.col(f"p.hourly.{c}") for c in ("time", *variables)])).alias("r"))
    return h.select(*keep, F.col("r.time").try_cast("timestamp_ntz").alias("time"), *[F.col(f"r.{v}") for v in variables]).where("time is not null")


def measurements(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """{"results": [{period.datetimeFrom.local, value, parameter.units}]} to rows time, value, unit."""
    schema = "results ARRAY<STRUCT<period: STRUCT<datetimeFrom: STRUCT<local: STRING>>, value: DOUBLE, parameter: STRUCT<name: STRING, units: STRING>>>"
    r = df.select(*keep, F.explode(F.from_json(payload, schema)["results"]).alias("r"))
    # the local wall clock is kept, its offset dropped
    time = F.replace(F.substring("r.period.datetimeFrom.local", 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return r.select(*keep, time.alias("time"), F.col("r.value").alias("value"), F.col("r.parameter.name").alias("parameter"), F.col("r.parameter.units").alias("unit"))


def stations(df: DataFrame, payload: str, pollutants: Sequence[str] = POLLUTANTS) -> DataFrame:
    """{"results": [{id, name, coordinates, sensors: [{id, parameter.name}]}]} to id, name, lat, lon and a map of the last sensor by pollutant; stations with none go."""
    schema = "results ARRAY<STRUCT<id: BIGINT, name: STRING, coordinates: STRUCT<latitude: DOUBLE, longitude: DOUBLE>, sensors: ARRAY<STRUCT<id: BIGINT, parameter: STRUCT<name: STRING>>>>>"
    s = df.select(F.explode(F.from_json(payload, schema)["results"]).alias("s"))
    kept = F.filter("s.sensors", lambda x: x["parameter"]["name"].isin(*pollutants))
    # the last sensor of a name wins, by looking each name up from the end
    names = F.array_distinct(F.transform(kept, lambda x: x["parameter"]["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(kept, lambda x: x["parameter"]["name"] == n), -1)["id"])
    out = s.select("s.id", "s.name", F.col("s.coordinates.latitude").alias("lat"), F.col("s.coordinates.longitude").alias("lon"), F.map_from_arrays(names, last).alias("sensors"))
    return out.where(F.size("sensors") > 0)


def live_sensors(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """{"status": "ok", "data": {aqi, city, iaqi.no2.v, ...}} to one row each; other statuses go."""
    gases = ("no2", "so2", "pm25", "o3")
    schema = "status STRING, data STRUCT<aqi: DOUBLE, city: STRUCT<name: STRING, geo: ARRAY<DOUBLE>>, iaqi: STRUCT<" + ", ".join(f"{g}: STRUCT<v: DOUBLE>" for g in gases) + ">>"
    d = df.select(*keep, F.from_json(payload, schema).alias("p")).where("p.status = 'ok'").select(*keep, "p.data.*")
    return d.select(*keep, F.col("city.name").alias("station"), "aqi", *[F.col(f"iaqi.{g}.v").alias("pm2_5" if g == "pm25" else g) for g in gases], F.try_element_at("city.geo", F.lit(1)).alias("lat"), F.try_element_at("city.geo", F.lit(2)).alias("lon"))
