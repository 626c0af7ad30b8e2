"""Cleaning expressions and small table repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_double(c: Column, default: float | None = None) -> Column:
    """The number, or the default where there is none; NaN counts as none."""
    v = c.try_cast("double")
    v = F.when(~F.isnan(v), v)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def keep_pollutants(df: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Rows of the listed pollutants with all of time, station and a numeric value."""
    return df.where(F.col("parameter").isin(*pollutants)).withColumn("value", safe_double(F.col("value"))).dropna(subset=["time", "station_id", "parameter", "value"])


def repair_reading(v: Column, cap: float = 250.0) -> Column:
    """Values from 1000 become their first three digits; then the absolute value, capped."""
    first = F.substring(v.cast("bigint").cast("string"), 1, 3).cast("double")
    fixed = F.abs(F.when(v >= 1000, first).otherwise(v))
    return F.when(v.isNotNull(), F.least(fixed, F.lit(cap)))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def repair_pm25_units(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column in kg/m3 (tiny throughout) becomes ug/m3; all values are then kept within 0 to 500."""
    b = df.agg(F.max(column).alias("_max"), F.percentile(column, F.lit(0.99)).alias("_q99"))
    tiny = (F.col("_max") < 0.005) & (F.col("_q99") < 0.002)
    return df.crossJoin(F.broadcast(b)).withColumn(out, clamp(F.when(tiny, F.col(column) * 1e9).otherwise(F.col(column)), 0.0, 500.0)).drop("_max", "_q99")


def fill_with_median(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Null, non-finite and zero values become the median of the column's other values, or 1.0 if it has none."""
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) & (F.col(c) != 0), F.col(c))
    middle = (lambda c: F.median(good(c))) if exact else (lambda c: F.percentile_approx(good(c), 0.5, 10000))
    meds = df.agg(*[F.coalesce(middle(c), F.lit(1.0)).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(meds)).withColumns({c: F.coalesce(good(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def road_class(c: Column) -> Column:
    """First class of a road that may be written as a list or with semicolons, in lower case; `unknown` if there is none."""
    listed = F.regexp_extract(c, r"^\s*[\[(]\s*['\"]?([^'\",\])]*)", 1)
    first = F.when(c.rlike(r"^\s*[\[(]"), listed).otherwise(F.split_part(c, F.lit(";"), F.lit(1)))
    name = F.lower(F.trim(first))
    return F.when(name.isNull() | name.isin("", "nan", "none", "null"), "unknown").otherwise(name)


def bias_corrected(v: Column, multiplier: float = 1.15, offset: float = 0.0) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), v * multiplier + offset))


def in_bbox(lat: Column, lon: Column, bbox: str) -> Column:
    """Within "south,west,north,east"."""
    s, w, n, e = (float(x) for x in bbox.split(","))
    return lat.between(s, n) & lon.between(w, e)


#: Respiratory minute volumes (m3/h) and inhalation rates by mode, and other names of modes.
RMV = {"walking": 1.2, "cycling": 3.5, "two_wheeler": 0.6}
RMV_ALIASES = {"two-wheeler": "two_wheeler", "driving": "two_wheeler", "car": "two_wheeler"}
INHALATION = {"jogger": 2.75, "cyclist": 1.80, "two_wheeler": 0.65, "car": 0.65 * 1.41}
INHALATION_ALIASES = {"two-wheeler": "two_wheeler"}


def lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    """A value by key; an unknown key gives the default, or is an error where there is none."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    miss = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(key, F.lit("null")))).cast("double")
    return F.coalesce(F.try_element_at(m, key), miss)


def alias(key: Column, table: dict[str, str]) -> Column:
    """Lower-cased key, or what the table names it."""
    key = F.lower(key)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key)


def minute_volume(mode: Column) -> Column:
    """Respiratory minute volume; an unknown mode is an error."""
    return lookup(alias(mode, RMV_ALIASES), RMV)


def inhalation_rate(mode: Column) -> Column:
    """Inhalation rate; an unknown mode is taken as a cyclist."""
    return lookup(alias(mode, INHALATION_ALIASES), INHALATION, INHALATION["cyclist"])


def scale_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores as floats, with null as 0 and the population spread plus 1e-8."""
    z = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    s = df.agg(*[x for c in columns for x in (F.avg(z[c]).alias(f"_a_{c}"), F.stddev_pop(z[c]).alias(f"_s_{c}"))])
    return df.crossJoin(F.broadcast(s)).withColumns({c: ((z[c] - F.col(f"_a_{c}")) / (F.col(f"_s_{c}") + 1e-8)).cast("float") for c in columns}).drop(*[x for c in columns for x in (f"_a_{c}", f"_s_{c}")])


def scaler_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) that scale_features uses."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    wide = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(z(c)).alias("mean"), F.stddev_pop(z(c)).alias("std")) for c in columns]).alias("f"))
    return wide.select(F.inline("f"))


def scale_target(df: DataFrame, target: str, out: str = "y_scaled", floor: float = 50.0) -> DataFrame:
    """The target over the larger of `floor` and its 95th percentile."""
    s = df.agg(F.greatest(F.lit(floor), F.percentile(target, F.lit(0.95))).alias("_scale"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.col(target) / F.col("_scale")).withColumnRenamed("_scale", "target_scale")
