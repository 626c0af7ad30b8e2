"""Window operators over keyed time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import seconds


def _around(df: DataFrame, keys: list[str], time: str, inclusive: bool = True):
    """df with its row numbers `_rn` in order of time, and the frames before and after a row. Both end at the row: the one
    after it runs down from the last row, as a frame that reaches to the end of its partition is read anew for every row."""
    here = 0 if inclusive else -1
    d = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    w = Window.partitionBy(*keys)
    return d, *(w.orderBy(o).rowsBetween(Window.unboundedPreceding, here) for o in (F.asc("_rn"), F.desc("_rn")))


def interpolate(df: DataFrame, keys: list[str], time: str, value: str, out: str, *, limit: int | None = 24, by_time: bool = True) -> DataFrame:
    """Linear interpolation both ways: by time or by row position; ends are filled flat; with a limit, only rows within so many rows of an observed one."""
    d, back, ahead = _around(df, keys, time)
    x = seconds(F.col(time)) if by_time else F.col("_rn").cast("double")
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).cast("double").alias("v"), F.col("_rn").alias("rn")))
    d = d.withColumn("_p", F.last(known, True).over(back)).withColumn("_n", F.last(known, True).over(ahead))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (x - p["x"]) / (n["x"] - p["x"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))
    if limit is not None:
        near = F.coalesce(F.col("_rn") - p["rn"] <= limit, F.lit(False)) | F.coalesce(n["rn"] - F.col("_rn") <= limit, F.lit(False))
        filled = F.when(near, filled)
    return d.withColumn(out, filled).drop("_rn", "_p", "_n")


def interpolate_all(df: DataFrame, keys: list[str], time: str, values: dict[str, str]) -> DataFrame:
    """Columns (name: result) interpolated by row position in one pass each way, ends filled flat."""
    d, back, ahead = _around(df, keys, time)
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).cast("double").alias("v"), F.col("_rn").alias("rn"))) for v in values}
    d = d.withColumns({f"_p_{v}": F.last(k, True).over(back) for v, k in known.items()}).withColumns({f"_n_{v}": F.last(k, True).over(ahead) for v, k in known.items()})

    def filled(v: str) -> Column:
        p, n = F.col(f"_p_{v}"), F.col(f"_n_{v}")
        line = p["v"] + (n["v"] - p["v"]) * (F.col("_rn") - p["rn"]) / (n["rn"] - p["rn"])
        return F.when(F.col(v).isNotNull(), F.col(v)).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))

    return d.withColumns({out: filled(v) for v, out in values.items()}).drop("_rn", *[f"_{s}_{v}" for v in values for s in "pn"])


def _around_blocks(df: DataFrame, keys: list[str], time: str, value: str, x: Column | None, block: float) -> DataFrame:
    """df with its row's number `_rn` in its series, the series' rows `_total`, and the known values `_p` before and `_n` after it (x, v, rn).

    Blocks of `block` seconds of a series are windows of their own; what each begins and ends with is carried over the blocks in
    a table of a row a block, so one very long series fills many tasks. x is a row's place on the line (None: its number)."""
    d = df.withColumn("_b", F.floor(seconds(F.col(time)) / F.lit(float(block))))
    w = Window.partitionBy(*keys, "_b")
    d = d.withColumn("_i", F.row_number().over(w.orderBy(time)))
    known = lambda rn: F.when(F.col(value).isNotNull(), F.struct((rn.cast("double") if x is None else x).alias("x"), F.col(value).cast("double").alias("v"), rn.cast("long").alias("rn")))
    ends = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.max_by(known(F.col("_i")), F.when(F.col(value).isNotNull(), F.col("_i"))).alias("_l"), F.min_by(known(F.col("_i")), F.when(F.col(value).isNotNull(), F.col("_i"))).alias("_f"))
    along = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.withColumn("_o", F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shift = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["rn"] + F.col("_o")).cast("double").alias("x") if x is None else F.col(c)["x"].alias("x"), F.col(c)["v"].alias("v"), (F.col(c)["rn"] + F.col("_o")).alias("rn")))
    ends = ends.withColumn("_l", shift("_l")).withColumn("_f", shift("_f"))
    back = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", "_o", F.sum("_c").over(Window.partitionBy(*keys)).alias("_total"), F.last("_l", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_f", True).over(back).alias("_after"))
    same = None
    for k in keys:  # null keys are series too
        same = F.col(k).eqNullSafe(F.col(f"_e_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    ends = ends.withColumnsRenamed({k: f"_e_{k}" for k in keys} | {"_b": "_e_b"})
    on = F.col("_b").eqNullSafe(F.col("_e_b"))
    d = d.join(ends, on if same is None else on & same).withColumn("_rn", F.col("_i") + F.col("_o"))
    here = known(F.col("_rn"))
    up, down = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_i"), F.desc("_i")))
    d = d.withColumn("_p", F.coalesce(F.last(here, True).over(up), "_before")).withColumn("_n", F.coalesce(F.last(here, True).over(down), "_after"))
    return d.drop("_b", "_i", "_o", "_before", "_after", "_e_b", *[f"_e_{k}" for k in keys])


def interpolate_blocks(df: DataFrame, keys: list[str], time: str, value: str, out: str, *, limit: int | None = 24, by_time: bool = True, block: float = 90 * 86400.0) -> DataFrame:
    """As `interpolate`, for series of any length; times within a series differ."""
    d = _around_blocks(df, keys, time, value, seconds(F.col(time)) if by_time else None, block)
    return between(d, time, value, out, limit, by_time).drop("_rn", "_p", "_n", "_total")


def between(d: DataFrame, time: str, value: str, out: str, limit: int | None = 24, by_time: bool = True) -> DataFrame:
    """d, whose rows have their number `_rn` and the known values `_p` before and `_n` after them (x, v, rn), with the line between these, as `interpolate` gives it."""
    p, n = F.col("_p"), F.col("_n")
    x, px, nx = (seconds(F.col(time)), p["x"], n["x"]) if by_time else (F.col("_rn").cast("double"), p["rn"], n["rn"])
    line = p["v"] + (n["v"] - p["v"]) * (x - px) / (nx - px)
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))
    if limit is not None:
        near = F.coalesce(F.col("_rn") - p["rn"] <= limit, F.lit(False)) | F.coalesce(n["rn"] - F.col("_rn") <= limit, F.lit(False))
        filled = F.when(near, filled)
    return d.withColumn(out, filled)


def gap_lengths_blocks(df: DataFrame, keys: list[str], time: str, value: str, out: str = "gap_hours", block: float = 90 * 86400.0) -> DataFrame:
    """As `gap_lengths`, for series of any length: the rows between the known ones on either side."""
    d = _around_blocks(df, keys, time, value, None, block)
    return gap_between(d, value, out).drop("_rn", "_p", "_n", "_total")


def gap_between(d: DataFrame, value: str, out: str = "gap_hours") -> DataFrame:
    """As `gap_lengths` from the places of the known values on either side of a row and the rows `_total` of its series."""
    size = F.coalesce(F.col("_n.rn"), F.col("_total") + 1) - F.coalesce(F.col("_p.rn"), F.lit(0)) - 1
    return d.withColumn(out, F.when(F.col(value).isNull(), size).otherwise(0).cast("int"))


def leave_one_out(df: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """Time interpolation of each observed point from its neighbours on either side."""
    d, back, ahead = _around(df, keys, time, inclusive=False)
    x = seconds(F.col(time))
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).alias("v")))
    d = d.withColumn("_p", F.last(known, True).over(back)).withColumn("_n", F.last(known, True).over(ahead))
    p, n = F.col("_p"), F.col("_n")
    line = F.when(n["x"] == p["x"], p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (x - p["x"]) / (n["x"] - p["x"]))
    return d.withColumn(out, F.when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))).drop("_rn", "_p", "_n")


def fill_both(df: DataFrame, keys: list[str], time: str, columns: list[str], default: float | None = None) -> DataFrame:
    """Forward, then backward fill; what is left takes the default."""
    d, back, ahead = _around(df, keys, time)
    fill = lambda c: F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead), *([F.lit(default)] if default is not None else []))
    return d.withColumns({c: fill(c) for c in columns}).drop("_rn")


def gap_lengths(df: DataFrame, keys: list[str], time: str, value: str, out: str = "gap_hours") -> DataFrame:
    """Rows of the contiguous missing block that a row lies in, 0 where a value is."""
    w = Window.partitionBy(*keys).orderBy(time)
    missing = F.col(value).isNull()
    d = df.withColumn("_island", F.sum(F.when(missing, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(missing.cast("int")).over(Window.partitionBy(*keys, "_island"))
    return d.withColumn(out, F.when(missing, size).otherwise(0).cast("int")).drop("_island")


def date_ranges(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Distinct days to ranges of consecutive ones: keys, date_from, date_to, days."""
    d = df.select(*keys, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)) if keys else F.row_number().over(Window.orderBy(day)))
    return d.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(day).alias("date_from"), F.max(day).alias("date_to"), F.count("*").alias("days")).drop("_island")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of each key that came last."""
    return keep_one(df, keys, [F.col(sequence).desc()])
