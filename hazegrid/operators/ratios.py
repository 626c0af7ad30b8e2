"""Pollutant ratios to pm10, and imputation by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.operators.quality import require_columns

TARGETS = ("pm25", "no2", "co")
CACHE_COLUMNS = ("station_id", "pollutant", "ratio", "global_ratio")


def pivot_hourly(hourly: DataFrame, parameters=("pm10", "pm25", "no2", "so2", "co")) -> DataFrame:
    """(station_id, time, one column a parameter); the list is fixed, so no pass is needed to find it."""
    return hourly.groupBy("station_id", "time").agg(*[F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters])


def ratio_table(wide: DataFrame, targets=TARGETS) -> DataFrame:
    """(station_id, pollutant, ratio, global_ratio): mean hourly ratio to pm10, else the ratio of means; positive ones only.

    The global ratio is the unweighted mean of the stations' ratios.
    """
    ok = F.col("pm10") > 0
    per = wide.groupBy("station_id").agg(*[F.coalesce(F.avg(F.when(ok, F.col(p) / F.col("pm10"))), F.avg(p) / F.when(F.avg("pm10") > 0, F.avg("pm10"))).alias(p) for p in targets])
    rows = per.select("station_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("ratio")) for p in targets])).alias("r")).select("station_id", "r.*").where("ratio > 0")
    means = rows.groupBy("pollutant").agg(F.avg("ratio").alias("global_ratio"))
    return rows.join(F.broadcast(means), "pollutant").select(*CACHE_COLUMNS)  # a row a pollutant


def impute(wide: DataFrame, ratios: DataFrame, targets=TARGETS) -> DataFrame:
    """wide with missing targets filled as pm10 times the station's ratio, or the global one."""
    per = ratios.groupBy("station_id").agg(*[F.max(F.when(F.col("pollutant") == p, F.col("ratio"))).alias(f"_r_{p}") for p in targets])
    every = ratios.agg(*[F.max(F.when(F.col("pollutant") == p, F.col("global_ratio"))).alias(f"_g_{p}") for p in targets])
    j = wide.join(per, "station_id", "left").crossJoin(F.broadcast(every))
    return j.withColumns({p: F.coalesce(F.col(p), F.col("pm10") * F.coalesce(f"_r_{p}", f"_g_{p}")) for p in targets}).select(*wide.columns)


def impute_raw(readings: DataFrame, ratios: DataFrame, units: DataFrame, targets=TARGETS) -> DataFrame:
    """Readings with a generated row for each raw pm10 row where no observed row of the target has that station and time."""
    base = readings.where("parameter = 'pm10' and value is not null").select("time", "station_id", "station_name", F.col("value").alias("pm10"), F.explode(F.array(*[F.lit(p) for p in targets])).alias("parameter"))
    r = ratios.select("station_id", F.col("pollutant").alias("parameter"), "ratio")
    g = ratios.groupBy(F.col("pollutant").alias("parameter")).agg(F.max("global_ratio").alias("global_ratio"))
    made = base.join(r, ["station_id", "parameter"], "left").join(F.broadcast(g), "parameter").join(F.broadcast(units), "parameter", "left")
    made = made.select("time", "station_id", "station_name", "parameter", (F.col("pm10") * F.coalesce("ratio", "global_ratio")).alias("value"), "unit")
    made = made.dropDuplicates(["time", "station_id", "parameter"])
    observed = readings.select("time", "station_id", "station_name", "parameter", "value", "unit")
    return observed.withColumn("source", F.lit("observed")).unionByName(made.join(observed, ["time", "station_id", "parameter"], "left_anti").withColumn("source", F.lit("ratio")))


def modal_units(readings: DataFrame) -> DataFrame:
    """The most frequent unit of each parameter, the smallest of equals."""
    n = readings.where("unit is not null").groupBy("parameter", "unit").agg(F.count("*").alias("n"))
    return n.withColumn("_rn", F.row_number().over(Window.partitionBy("parameter").orderBy(F.desc("n"), "unit"))).where("_rn = 1").select("parameter", "unit")


def load_or_build(spark, path: str, build) -> DataFrame:
    """A stored ratio table with the required columns; else what `build` gives, stored there."""
    try:
        return require_columns(spark.read.parquet(path), CACHE_COLUMNS)
    except Exception:  # absent, unreadable or of another form: rebuilt
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
