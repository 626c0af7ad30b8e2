"""Audits of tables: schema, nulls, duplicates, coverage, horizons and missing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import floor_hour, seconds


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of these columns: {', '.join(candidates)}")


TIME_WORDS = ("time", "date", "timestamp", "datetime")


def time_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of columns that look like times by name or type; reads the schema only."""
    return [(n, t) for n, t in df.dtypes if t.startswith(("timestamp", "date")) or any(w in n.lower() for w in TIME_WORDS) or n.lower() == "ts"]


def time_audit(df: DataFrame) -> DataFrame:
    """(column, type, rows, parsed share) of the time-like columns, in one pass."""
    cols = time_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, type string, rows long, parsed double")
    ok = lambda c: F.avg(F.try_to_timestamp(F.col(c).cast("string")).isNotNull().cast("double"))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("rows"), ok(c).alias("parsed")) for c, t in cols]).alias("f"))
    return row.select(F.inline("f"))


def null_counts(df: DataFrame, by: Sequence = ()) -> DataFrame:
    """Rows and nulls of every column, in one pass; `by` groups, such as the file name."""
    names = [c for c in df.columns if c not in [str(b) for b in by]]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in names])


def key_audit(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row: rows, duplicates beyond the first of each key, null times."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(time).isNull().cast("long")).alias("nulls"))
    return n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("nulls").alias("null_times"))


def coverage(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """First and last time, distinct years, and distinct values of each key."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.array_join(F.array_sort(F.collect_set(F.year(time))), ",").alias("years"), *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys])


def horizon(df: DataFrame, time: str, after=None) -> DataFrame:
    """The last hour, and the number of distinct hours (after a given time)."""
    h = floor_hour(F.col(time))
    d = df.where(F.col(time).isNotNull())
    return d.agg(F.max(h).alias("horizon"), F.countDistinct(h if after is None else F.when(h > F.lit(after).cast("timestamp_ntz"), h)).alias("new_hours"))


def contiguity(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Per key: distinct times, and steps between them that are not an hour."""
    from pyspark.sql import Window

    d = df.select(*keys, time).distinct()
    step = seconds(F.col(time)) - seconds(F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    return d.withColumn("_step", step).groupBy(*keys).agg(F.count("*").alias("steps"), F.count_if(F.col("_step") != 3600).alias("bad_steps"))


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def missing_days(present: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Days of a calendar on which the table has no row."""
    calendar = present.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return calendar.join(present.select(day).distinct(), day, "left_anti")


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys of each table, and of both."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    tagged = x.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(y.withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
    per = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per.agg(F.sum("_a").alias("left_keys"), F.sum("_b").alias("right_keys"), F.sum(F.col("_a") * F.col("_b")).alias("shared_keys"))
