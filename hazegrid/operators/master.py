"""The node-by-hour master table and its repaired hourly spine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import haversine_m
from hazegrid.functions.timeutil import floor_hour, seconds
from hazegrid.operators import ratios as R
from hazegrid.operators.scratch import shared_checkpoint
from hazegrid.operators.series import interpolate_all


def hourly_prefixed(df: DataFrame, prefix: str, time: str = "time") -> DataFrame:
    """Hourly means of all numeric columns, under a prefix."""
    cols = [n for n, t in df.dtypes if n != time and t in ("double", "float", "int", "bigint")]
    return df.groupBy(floor_hour(F.col(time)).alias("timestamp")).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def enrich(stations: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, how: str = "left") -> DataFrame:
    """Station hours with their node, the hour's weather and the city's air; Spark broadcasts the small sides by their size."""
    j = stations.join(node_map, "station_id", how)
    return j.join(weather, "timestamp", how).join(air, "timestamp", how)


def joined(hourly: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """Pivoted and ratio-imputed station hours, interpolated within stations, with node, weather and city columns."""
    wide = R.pivot_hourly(hourly)
    wide = R.impute(wide, R.ratio_table(wide) if ratios is None else ratios)
    pollutants = [c for c in wide.columns if c not in ("station_id", "time")]
    s = wide.select(F.col("time").alias("timestamp"), "station_id", *[F.col(p).alias(f"station_{p}") for p in pollutants])
    s = interpolate_all(s, ["station_id"], "timestamp", {f"station_{p}": f"station_{p}" for p in pollutants})
    return enrich(s, node_map, hourly_prefixed(weather, "weather_"), hourly_prefixed(air, "city_"))


def _numbers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("station_", "weather_", "city_")) and c not in ("station_id", "station_name")]


def medians(rows: DataFrame, exact: bool = True) -> DataFrame:
    """One row: the median of each number column, 0 where it has no value."""
    names = _numbers(rows)
    if exact:
        return exact_medians(rows, names).select(*[F.coalesce(c, F.lit(0.0)).alias(f"_m_{c}") for c in names])
    return rows.agg(*[F.coalesce(F.percentile_approx(c, 0.5, 10000), F.lit(0.0)).alias(f"_m_{c}") for c in names])


def exact_medians(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the exact median of each column, null where it has no value.

    Approximate ranks, right to a thousandth, bound each median half a hundredth to either side; only what lies between the
    bounds is brought together, a row a value, so no task holds a column. rows are read three times.
    """
    ends = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(F.lit(0.495), F.lit(0.505)), 1000).alias(f"_e{i}") for i, c in enumerate(names)])
    d = rows.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)]).crossJoin(F.broadcast(ends))  # one row
    v, lo, hi = ([f(i) for i in range(len(names))] for f in (lambda i: F.col(f"_v{i}"), lambda i: F.col(f"_e{i}")[0], lambda i: F.col(f"_e{i}")[1]))
    size = d.agg(F.array(*[F.count(x) for x in v]).alias("_n"), F.array(*[F.count_if(x < a) for x, a in zip(v, lo)]).alias("_below"))
    inside = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.when((x >= a) & (x <= b), x).alias("v")) for i, (x, a, b) in enumerate(zip(v, lo, hi))]), lambda e: e["v"].isNotNull())
    counted = d.select(F.explode(inside).alias("_s")).select("_s.*").groupBy("i", "v").agg(F.count("*").alias("_c")).crossJoin(F.broadcast(size))  # one row
    past = F.get("_below", F.col("i")) + F.sum("_c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.get("_n", F.col("i"))
    at = lambda k: F.max(F.when((k >= F.col("_past") - F.col("_c")) & (k < F.col("_past")), F.col("v")))
    both = counted.withColumns({"_past": past, "_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}).groupBy("i").agg(at(F.col("_low")).alias("a"), at(F.col("_high")).alias("b"))
    middle = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a median lies beyond its bounds")).cast("double")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b"))
    return both.select("i", middle.alias("m")).agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(c) for i, c in enumerate(names)])


def filled(rows: DataFrame, medians: DataFrame) -> DataFrame:
    rest = _numbers(rows)
    return rows.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in rest}).drop(*medians.columns)


def build(hourly: DataFrame, node_map: DataFrame, weather: DataFrame, air: DataFrame, exact: bool = True) -> DataFrame:
    """Master table: pivoted and ratio-imputed station hours with node, weather and city columns, filled within stations and then by column medians (0 if none)."""
    rows = shared_checkpoint(joined(hourly, node_map, weather, air))  # read for the medians and for the rows
    return filled(rows, medians(rows, exact))


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: the mean of numbers, the smallest non-null of other columns."""
    aggs = [(F.avg(n) if t in ("double", "float") else F.min(n)).alias(n) for n, t in df.dtypes if n not in keys]
    return df.groupBy(*keys).agg(*aggs)


def hourly_spine(df: DataFrame, node: str, time: str, numeric: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Every node at every hour between the first and last of all, numbers interpolated by position and then filled, labels filled."""
    d = dedupe(df.withColumn(time, floor_hour(F.col(time))), [node, time])
    ends = d.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    # windows see observed rows only, each of which then makes the hours up to the next one: nodes by hours are never shuffled
    d = d.crossJoin(F.broadcast(ends)).where(F.col(time).isNotNull())  # one row
    hour = lambda t: F.floor((seconds(t) - seconds(F.col("_lo"))) / 3600).cast("long")
    d = d.withColumn("_rn", hour(F.col(time)))
    w = Window.partitionBy(node)
    up, down = w.orderBy("_rn"), w.orderBy(F.desc("_rn"))
    so_far, from_here, later = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.when(F.col(c).isNotNull() & F.col(node).isNotNull(), F.struct(F.col("_rn").alias("rn"), (F.col(c).cast("double") if c in numeric else F.col(c)).alias("v"))) for c in (*numeric, *labels)}
    d = d.withColumns({f"_p_{c}": F.last(k, True).over(so_far) for c, k in known.items()} | {"_first": F.row_number().over(up) == 1, "_next": F.lead("_rn").over(up)})
    d = d.withColumns({f"_o_{c}": F.last(k, True).over(from_here) for c, k in known.items()} | {f"_n_{c}": F.last(k, True).over(later) for c, k in known.items()})
    d = d.withColumn("_at", F.explode(F.sequence(F.when(F.col("_first"), F.lit(0)).otherwise(F.col("_rn")), F.coalesce(F.col("_next") - 1, hour(F.col("_hi"))))))
    at = F.col("_at")

    def value(c: str) -> Column:
        p, n = F.when(at >= F.col("_rn"), F.col(f"_p_{c}")), F.when(at <= F.col("_rn"), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))
        if c in labels:
            return F.coalesce(p["v"], n["v"])
        line = p["v"] + (n["v"] - p["v"]) * (at - p["rn"]) / (n["rn"] - p["rn"])
        return F.when(p["rn"] == at, p["v"]).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(p["v"], n["v"]))

    return d.select(node, (F.col("_lo") + F.make_dt_interval(hours=at.cast("int"))).cast(d.schema[time].dataType).alias(time), *[value(c).alias(c) for c in known])


def city_repair(air: DataFrame, hourly: DataFrame, meta: DataFrame, columns: dict[str, str], centre: tuple[float, float], power: float = 2.0) -> DataFrame:
    """Missing city hours as the stations' mean weighted by 1 / d^power from the centre, or the mean of those at distance 0.

    columns: city column by station parameter. An hour without a station value stays null.
    """
    m = meta.where("lat is not null and lon is not null").select(F.col("id").alias("station_id"), haversine_m(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])).alias("d"))
    s = hourly.where("value is not null").join(m, "station_id")
    zero = F.col("d") == 0
    w = 1 / F.pow(F.when(~zero, F.col("d")), F.lit(power))
    est = s.groupBy("time", "parameter").agg(F.coalesce(F.avg(F.when(zero, F.col("value"))), F.sum(w * F.col("value")) / F.sum(w)).alias("e"))
    wide = est.groupBy("time").agg(*[F.max(F.when(F.col("parameter") == p, F.col("e"))).alias(f"_e_{c}") for p, c in columns.items()])
    return air.join(wide, "time", "left").withColumns({c: F.coalesce(c, f"_e_{c}") for c in columns.values()}).select(*air.columns)


def needs_rebuild(raw: Sequence[tuple[DataFrame, str]], processed: DataFrame, time: str) -> bool:
    """True if any raw source has an hour beyond the processed table's last; two aggregates reach the driver."""
    tops = [df.agg(F.max(floor_hour(F.col(t)))).first()[0] for df, t in raw]
    done = processed.agg(F.max(floor_hour(F.col(time)))).first()[0]
    tops = [t for t in tops if t is not None]
    return bool(tops) and (done is None or max(tops) > done)


def incremental(master: DataFrame, processed: DataFrame, time: str = "timestamp") -> DataFrame:
    """Master rows after the processed table's last hour."""
    last = processed.agg(F.max(time).alias("_last"))
    return master.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last")
