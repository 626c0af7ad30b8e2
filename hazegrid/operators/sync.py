"""A stored master table that is kept up to date by recomputing the range that new hours can change, and nothing else.

The folder holds `rows` (by day), `state` (by version) and the fixed ratios and medians that fills use. The state has, for each
station and column, the last hour with an own (or ratio-imputed) value and that value, and how far each source has been read.
A new value changes the flat fill back to the last own one, so a station's affected range runs from there, or from its first
row if it has none, to the end; late weather or city hours affect all stations from where that source ended. Days before the
earliest affected hour are neither read nor written. Rows are staged and then replace whole days (dynamic overwrite); the state
comes last, so a run that died is simply run again. Sources grow in time; older rows that come late need `create`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import floor_hour
from hazegrid.operators import gapfill, master, ratios
from hazegrid.operators.scratch import drop_table, shared_checkpoint
from hazegrid.operators.series import interpolate_all

SOURCES = ("readings", "weather", "air")
POLLUTANTS = ("pm10", "pm25", "no2", "so2", "co")
COLUMNS = [f"station_{p}" for p in POLLUTANTS]
_HOUR = "INTERVAL 1 HOUR"


@dataclass
class Report:
    """What a sync did: hours that were not there, days written, the first affected day and the new horizon."""

    new_hours: int
    days: int
    from_day: object
    horizon: datetime | None


def statistics(readings: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, at: str, exact: bool = True) -> None:
    """Stores the ratios and medians of all given rows; fills use them until they are made anew."""
    hourly = gapfill.hourly_mean(readings)
    table = ratios.ratio_table(ratios.pivot_hourly(hourly))
    table.write.mode("overwrite").parquet(f"{at}/ratios")
    # read three times for the medians
    joined = shared_checkpoint(master.joined(hourly, node_map, weather, air, readings.sparkSession.read.parquet(f"{at}/ratios")))
    master.medians(joined, exact).write.mode("overwrite").parquet(f"{at}/medians")


def _after(df: DataFrame, time: str, horizon) -> DataFrame:
    """Raw rows of the hours after a horizon; the bound is on the raw column, so it reaches the scan."""
    return df if horizon is None else df.where(F.col(time) >= F.lit(horizon).cast(df.schema[time].dataType) + F.expr(_HOUR))


def _wide(readings: DataFrame, table: DataFrame) -> DataFrame:
    w = ratios.impute(ratios.pivot_hourly(gapfill.hourly_mean(readings), POLLUTANTS), table)
    return w.select("station_id", F.col("time").alias("timestamp"), *[F.col(p).alias(c) for p, c in zip(POLLUTANTS, COLUMNS)])


def _last_values(wide: DataFrame) -> DataFrame:
    """(station_id, first_time, {column}_time, {column}_value): where each column was last known."""
    return wide.groupBy("station_id").agg(F.min("timestamp").alias("first_time"), *[x for c in COLUMNS for x in (F.max(F.when(F.col(c).isNotNull(), F.col("timestamp"))).alias(f"{c}_time"), F.max_by(c, F.when(F.col(c).isNotNull(), F.col("timestamp"))).alias(f"{c}_value"))])


def _put_state(state: DataFrame, horizons: dict[str, datetime | None], at: str, version: int) -> None:
    rows = state.withColumns({f"_{s}": F.lit(h).cast("timestamp_ntz") for s, h in horizons.items()})
    rows.write.mode("overwrite").parquet(f"{at}/state/v{version}")
    if version > 1:
        drop_table(state.sparkSession, f"{at}/state/v{version - 2}")


def _state(spark: SparkSession, at: str) -> tuple[DataFrame, dict, int]:
    """The newest whole state, the horizons of the sources, and its version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    version = max(int(n[1:]) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state/{n}/_SUCCESS")))
    rows = spark.read.parquet(f"{at}/state/v{version}")
    top = rows.agg(*[F.max(f"_{s}").alias(s) for s in SOURCES]).first()
    return rows.drop(*[f"_{s}" for s in SOURCES]), top.asDict(), version


def _top(df: DataFrame, time: str):
    return df.agg(F.max(floor_hour(F.col(time)))).first()[0]


def create(readings: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, at: str) -> None:
    """The whole table, with the stored ratios and medians."""
    spark = readings.sparkSession
    table, medians = spark.read.parquet(f"{at}/ratios"), spark.read.parquet(f"{at}/medians")
    rows = master.filled(master.joined(gapfill.hourly_mean(readings), node_map, weather, air, table), medians)
    rows.withColumn("day", F.to_date("timestamp")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{at}/rows")
    _put_state(_last_values(_wide(readings, table)), {"readings": _top(readings, "time"), "weather": _top(weather, "time"), "air": _top(air, "time")}, at, 0)


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/rows")


def affected(spark: SparkSession, at: str, fresh: DataFrame, state: DataFrame, late: list) -> tuple[object, DataFrame]:
    """(first affected hour, stored rows of its day and later); fresh are the new wide rows, late the first hours of sources that lag."""
    seen = fresh.groupBy("station_id").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in COLUMNS])
    # a station without a state has no stored rows
    starts = seen.join(state, "station_id").select(F.least(*[F.when(F.col(c), F.coalesce(f"{c}_time", "first_time")) for c in COLUMNS], F.lit(None).cast("timestamp_ntz")).alias("t"))
    lowest = starts.agg(F.min("t")).first()[0]
    start = min((t for t in (lowest, *late) if t is not None), default=None)
    stored = read(spark, at)
    return start, stored.where(F.lit(False)) if start is None else stored.where(F.col("day") >= F.lit(start.date()))


def sync(readings: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, at: str) -> Report:
    """Brings the table up to the sources' last hours. Nothing is written where no source has got further."""
    spark = readings.sparkSession
    table, medians = spark.read.parquet(f"{at}/ratios"), spark.read.parquet(f"{at}/medians")
    state, done, version = _state(spark, at)
    horizon = done["readings"]
    # a source that is ahead of the readings has hours that new rows need
    base = {s: h if s == "readings" or h is None or horizon is None else min(h, horizon) for s, h in done.items()}
    new = {"readings": _after(readings, "time", base["readings"]), "weather": _after(weather, "time", base["weather"]), "air": _after(air, "time", base["air"])}
    tops = {s: _top(df, "time") for s, df in new.items()}
    if not any(t is not None and (done[s] is None or t > done[s]) for s, t in tops.items()):
        return Report(0, 0, None, horizon)
    fresh = shared_checkpoint(_wide(new["readings"], table))
    firsts = {s: new[s].agg(F.min(floor_hour(F.col("time")))).first()[0] for s in ("weather", "air")}
    late = [t for t in firsts.values() if t is not None and horizon is not None and t <= horizon]
    start, old = affected(spark, at, fresh, state, late)
    if horizon is not None:  # rows of a run that died before its state was written do not count
        old = old.where(F.col("timestamp") <= F.lit(horizon).cast("timestamp_ntz"))
    both = old.drop("day").unionByName(fresh.join(node_map, "station_id", "left"), allowMissingColumns=True).join(state, "station_id", "left")
    is_new = F.lit(True) if horizon is None else F.col("timestamp") > F.lit(horizon).cast("timestamp_ntz")
    known = both.withColumns({f"_k_{c}": F.when(is_new | (F.col("timestamp") == F.col(f"{c}_time")), F.col(c)) for c in COLUMNS})
    lines = interpolate_all(known, ["station_id"], "timestamp", {f"_k_{c}": f"_f_{c}" for c in COLUMNS})
    keep = lambda c: F.coalesce(~is_new & (F.col("timestamp") <= F.col(f"{c}_time")), F.lit(False))
    out = lines.withColumns({c: F.when(keep(c), F.col(c)).otherwise(F.coalesce(f"_f_{c}", f"{c}_value")) for c in COLUMNS})
    for source, prefix in (("weather", "weather_"), ("air", "city_")):
        hours = master.hourly_prefixed(new[source], prefix)
        cols = [c for c in hours.columns if c != "timestamp"]
        renewed: Column = F.lit(True) if base[source] is None else F.col("timestamp") > F.lit(base[source]).cast("timestamp_ntz")
        out = out.join(hours.select("timestamp", *[F.col(c).alias(f"_n_{c}") for c in cols]), "timestamp", "left").withColumns({c: F.when(renewed, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols})
    rows = master.filled(out.select(*old.drop("day").columns), medians).withColumn("day", F.to_date("timestamp"))
    staged = f"{at}/staged-{uuid.uuid4().hex}"
    rows.repartition("day").write.partitionBy("day").parquet(staged)
    made = spark.read.parquet(staged)
    days = made.select("day").distinct().count()
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{at}/rows")
    latest, older = _last_values(fresh), state
    names = [n for n in older.columns if n != "station_id"]
    merged = older.join(latest.select("station_id", *[F.col(n).alias(f"_n_{n}") for n in names]), "station_id", "full")
    choose = lambda n: F.coalesce(n, f"_n_{n}") if n == "first_time" else F.coalesce(f"_n_{n}", n)
    _put_state(merged.select("station_id", *[choose(n).alias(n) for n in names]), {s: max((t for t in (tops[s], done[s]) if t is not None), default=None) for s in SOURCES}, at, version + 1)
    drop_table(spark, staged)
    hours = fresh.select("timestamp").distinct().count()
    return Report(hours, days, None if start is None else start.date(), tops["readings"] or horizon)
