"""Time columns: wall-clock timestamps without a zone, floors, windows and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast(NTZ)


def seconds(c: Column) -> Column:
    """Seconds since the epoch as a double, for differences of times."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def to_local(c: Column, source: str = "UTC", zone: str = "Asia/Kolkata") -> Column:
    """Wall-clock time of `zone` for wall-clock times of `source`; naive times that are local already need no call."""
    return F.convert_timezone(F.lit(source), F.lit(zone), c.cast(NTZ))


def in_year(df: DataFrame, time: str, year: int) -> DataFrame:
    """Rows of a calendar year; all rows if it has none. The test is one aggregate, joined as one row."""
    hit = F.year(time) == year
    any_hit = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_hit)).where(hit | ~F.col("_any")).drop("_any")


def between_bounds(df: DataFrame, time: str, other: DataFrame, other_time: str) -> DataFrame:
    """Rows within the first and last time of another table."""
    b = other.agg(F.min(other_time).alias("_lo"), F.max(other_time).alias("_hi"))
    return df.crossJoin(F.broadcast(b)).where(F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def lookback(df: DataFrame, time: str, days: int = 90, stride_hours: int = 1) -> DataFrame:
    """The last `days` before the newest row, at every `stride_hours`-th hour of the epoch."""
    newest = df.agg(F.max(time).alias("_max"))
    out = df.crossJoin(F.broadcast(newest)).where(F.col(time) >= F.col("_max") - F.expr(f"INTERVAL {days} DAYS")).drop("_max")
    return out.where(F.floor(seconds(F.col(time)) / 3600) % stride_hours == 0) if stride_hours > 1 else out


def since(df: DataFrame, time: str, first: str = "2022-01-01") -> DataFrame:
    return df.where(F.col(time) >= F.lit(first).cast(NTZ))
