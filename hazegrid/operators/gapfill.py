"""Gap-fill cascade with lineage, and its back-test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.clean import keep_pollutants
from hazegrid.functions.geo import EARTH_M, haversine_m
from hazegrid.functions.timeutil import floor_hour, seconds
from hazegrid.operators.scratch import Rounds, with_package
from hazegrid.operators.series import between, gap_between, leave_one_out

SERIES = ["parameter", "station_id"]
#: Fixed values of the cascade: confidence, factor of the policy's p90 error, tier.
LINEAGE = {"observed": (1.0, 0.0, "A"), "temporal_linear": (0.85, 1.0, "B"), "spatial_idw": (0.70, 1.15, "B"), "temporal_climatology": (0.55, 1.35, "C"), "station_median": (0.35, 1.60, "C")}
METHODS = ("temporal_linear", "spatial_idw", "temporal_climatology", "station_median", "hybrid_linear_idw")


def hourly_mean(readings: DataFrame, pollutants=("pm10", "pm25", "no2", "so2", "co")) -> DataFrame:
    """Mean of each (hour, station, name, parameter); raw rows are aggregated before any window sees them."""
    r = keep_pollutants(readings, pollutants)
    return r.groupBy("parameter", "station_id", "station_name", floor_hour(F.col("time")).alias("time")).agg(F.avg("value").alias("value"))


def per_station(hourly: DataFrame) -> DataFrame:
    """One value for each (parameter, station, hour): the unweighted mean over station names."""
    return hourly.groupBy("parameter", "station_id", "time").agg(F.avg("value").alias("value"))


def located(meta: DataFrame) -> DataFrame:
    """(station_id, lat, lon) of the stations that have coordinates."""
    return meta.where("lat is not null and lon is not null").select(F.col("id").alias("station_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def times_of(observed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A row a pollutant: its times `_ticks` and how many values each has, `_there`, at the stations `counted` (None: at all)."""
    observed = observed.where("time is not null")
    seen = observed if counted is None else observed.join(counted.select("station_id").withColumn("_in", F.lit(True)), "station_id", "left")
    ticks = seen.groupBy("parameter", "time").agg(F.count("value" if counted is None else F.when(F.col("_in"), F.col("value"))).alias("n"))
    return ticks.groupBy("parameter").agg(F.sort_array(F.collect_list(F.struct("time", "n"))).alias("_t")).select("parameter", F.col("_t.time").alias("_ticks"), F.col("_t.n").alias("_there"))


def series_times(observed: DataFrame) -> DataFrame:
    """observed with `_k`, the known value: its place rn among its pollutant's times, seconds x and value v."""
    place = times_of(observed).select("parameter", F.posexplode("_ticks").alias("_rn", "time")).withColumn("_rn", F.col("_rn") + 1)
    there = F.col("value").isNotNull() & F.col("station_id").isNotNull() & F.col("_rn").isNotNull()
    known = F.when(there, F.struct(F.col("_rn").alias("rn"), seconds(F.col("time")).alias("x"), F.col("value").cast("double").alias("v")))
    return observed.join(place, ["parameter", "time"], "left").withColumn("_k", known)


def series_of(observed: DataFrame) -> DataFrame:
    """A row a series: its `_known` values (rn, x, v; by time) and their median `_med`. `cells` makes the dense rows from these, so that only observed rows are shuffled."""
    return series_times(observed).groupBy(*SERIES).agg(F.sort_array(F.collect_list("_k")).alias("_known"), F.median("value").alias("_med"))


def timed(s: DataFrame, times: DataFrame) -> DataFrame:
    """Rows with their pollutant's times; last, as no shuffle should carry them."""
    return s.join(F.broadcast(times), "parameter")  # a row a pollutant


def cells(s: DataFrame) -> DataFrame:
    """Every series of `series_of`, `timed`, at every time of its pollutant: value, row number `_rn` of `_total`, and the known values `_p` before and `_n` after it, which are a cell's own where it has one. Further columns stay."""
    pairs = F.transform("_known", lambda e, i: F.struct((i == 0).alias("lead"), e.alias("p"), F.get("_known", i + 1).alias("n")))
    none = F.array(F.struct(F.lit(True).alias("lead"), F.get("_known", F.lit(0)).alias("p"), F.get("_known", F.lit(0)).alias("n")))
    return _expand(s.withColumn("_w", F.explode(F.when(F.size("_known") > 0, pairs).otherwise(none))).drop("_known"))


def _expand(ways: DataFrame) -> DataFrame:
    """Cells from rows of a known value p, the next one n and whether p leads its series (`_w`)."""
    p, n, rn = F.col("_w.p"), F.col("_w.n"), F.col("_rn")
    first, last = F.when(F.col("_w.lead"), F.lit(1)).otherwise(p["rn"]), F.coalesce(n["rn"] - 1, F.size("_ticks"))
    d = ways.withColumn("_rn", F.explode(F.sequence(first, last)))
    d = d.withColumns({"time": F.get("_ticks", rn - 1), "_there": F.get("_there", rn - 1), "_total": F.size("_ticks"), "value": F.when(rn == p["rn"], p["v"]), "_p": F.when(rn >= p["rn"], p), "_n": F.when(rn <= p["rn"], p).otherwise(n)})
    return d.drop("_w", "_ticks")


def cells_blocks(observed: DataFrame, block: float = 90 * 86400.0) -> DataFrame:
    """As `cells`, for series of any length: known values find the next one in blocks of `block` seconds, whose first values are carried back over a table of a row a block."""
    s = series_times(observed)
    d = s.where("_k is not null").withColumn("_b", F.floor(F.col("_k.x") / F.lit(float(block))))
    w, along = Window.partitionBy(*SERIES, "_b").orderBy("_k"), Window.partitionBy(*SERIES).orderBy("_b")
    d = d.withColumns({"_next": F.lead("_k").over(w), "_i": F.row_number().over(w)})
    heads = d.groupBy(*SERIES, "_b").agg(F.min("_k").alias("_f")).withColumns({"_after": F.lead("_f").over(along), "_at": F.row_number().over(along)}).drop("_f")
    d = d.join(heads, [*SERIES, "_b"]).select(*SERIES, F.struct(((F.col("_at") == 1) & (F.col("_i") == 1)).alias("lead"), F.col("_k").alias("p"), F.coalesce("_next", "_after").alias("n")).alias("_w"))
    # series without a known value
    bare = s.groupBy(*SERIES).agg(F.count("_k").alias("_c"), F.max("_k").alias("_k")).where("_c = 0").select(*SERIES, F.struct(F.lit(True).alias("lead"), F.col("_k").alias("p"), F.col("_k").alias("n")).alias("_w"))
    return _expand(d.unionByName(bare).transform(timed, times_of(observed)))


def spine(observed: DataFrame) -> DataFrame:
    """Every station of a pollutant at every time at which that pollutant was observed at all."""
    return cells(timed(series_of(observed), times_of(observed))).select("parameter", "station_id", "time", "value")


def pair_distances(meta: DataFrame) -> DataFrame:
    """(a, b, d) metres between different stations that have coordinates."""
    m = meta.where("lat is not null and lon is not null").select("id", "lat", "lon")
    a, b = m.toDF("a", "lat_a", "lon_a"), m.toDF("b", "lat_b", "lon_b")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("d"))


def idw(targets: DataFrame, observed: DataFrame, distances: DataFrame, least: int, out: str = "idw") -> DataFrame:
    """(parameter, station_id, time) of targets with the mean of other stations at that time, weighted 1 / (d^2 + 1), where there are `least`."""
    o = observed.where("value is not null").select("parameter", "time", F.col("station_id").alias("b"), F.col("value").alias("_v"))
    w = 1 / (F.col("d") * F.col("d") + 1)
    near = targets.select("parameter", "time", F.col("station_id").alias("a")).join(o, ["parameter", "time"]).where("a <> b").join(distances, ["a", "b"])
    return near.groupBy("parameter", F.col("a").alias("station_id"), "time").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(out), F.count("*").cast("int").alias("neighbours")).where(f"neighbours >= {least}")


#: Pairs of stations whose distances are taken at a time.
PAIRS = 2**16


def square_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """The squares of `haversine_m` from each first to each second point; for stretches below some 350 km by the series of the squared sine and arcsine, which are exact to the last bits there and take a third of the time."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    x, y = np.subtract.outer(p1, p2) / 2, np.radians(np.subtract.outer(lon1, lon2)) / 2
    close = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= 0.03

    def series(h: np.ndarray, *terms: float) -> np.ndarray:
        out = h * terms[0]
        for t in terms[1:]:
            out += t
            out *= h
        return out

    sines = (lambda a: series(a * a, 2 / 14175, -1 / 315, 2 / 45, -1 / 3, 1.0)) if close else (lambda a: np.sin(a) ** 2)
    h = sines(y)
    h *= np.multiply.outer(np.cos(p1), np.cos(p2))
    h += sines(x)
    h = series(h, 128 / 2079, 128 / 1575, 4 / 35, 8 / 45, 1 / 3, 1.0) if close else np.arcsin(np.sqrt(np.minimum(1.0, h))) ** 2
    h *= (2 * EARTH_M) ** 2
    return h


def _weigh(targets: DataFrame, observed: DataFrame, meta: DataFrame, least: int, out: str, reach: float | None) -> DataFrame:
    """Means of other stations at each target's time weighted 1 / (d^2 + 1), where there are `least`; with a reach, of those within it, and `dropped_share`.

    Targets and observed rows of a pollutant and time meet in one group, where distances are taken block by block: what is
    shuffled and written are those rows, never pairs.
    """
    at = located(meta)
    t = targets.select("parameter", "time", "station_id").join(at, "station_id").select("parameter", "time", "station_id", "lat", "lon").toDF("p", "t", "s", "lat", "lon")
    o = observed.where("value is not null").select("parameter", "time", "station_id", "value").join(at, "station_id").select("parameter", "time", "station_id", "lat", "lon", "value").toDF("p", "t", "s", "lat", "lon", "value")
    names = ["parameter", "station_id", "time", out, "neighbours"] + (["dropped_share"] if reach is not None else [])
    types = {"parameter": t.schema["p"].dataType, "station_id": t.schema["s"].dataType, "time": t.schema["t"].dataType}
    schema = ", ".join(f"`{n}` {types[n].simpleString() if n in types else 'int' if n == 'neighbours' else 'double'}" for n in names)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["lat"].to_numpy(), kind="stable")
        v, ids, lat, lon = (right[c].to_numpy()[order] for c in ("value", "s", "lat", "lon"))
        plain, found = bool(np.isfinite(v).all()), []
        tids, tlat, tlon = (left[c].to_numpy() for c in ("s", "lat", "lon"))
        by_id, rows = np.argsort(ids, kind="stable"), np.argsort(tlat, kind="stable")
        own, past = np.searchsorted(ids[by_id], tids), np.searchsorted(ids[by_id], tids, "right")
        step = max(1, PAIRS // max(1, len(v)))
        for i in range(0, len(rows) if len(v) else 0, step):
            r, lo, hi = rows[i : i + step], 0, len(v)
            if reach is not None:  # an arc is never shorter than its difference of latitudes; a hair more for rounding
                far = np.degrees(reach / EARTH_M) * (1 + 1e-9) + 1e-9
                lo, hi = np.searchsorted(lat, tlat[r[0]] - far), np.searchsorted(lat, tlat[r[-1]] + far, "right")
            w = square_m(tlat[r], tlon[r], lat[lo:hi], lon[lo:hi])
            off = w > reach * reach if reach is not None else None
            w += 1
            np.reciprocal(w, out=w)
            if off is not None:
                w[off] = 0.0
            n = np.count_nonzero(w, axis=1)
            same = np.nonzero(past[r] > own[r])[0]
            for k in range(int((past[r] - own[r]).max(initial=0))):
                at = same[own[r[same]] + k < past[r[same]]]
                j = by_id[own[r[at]] + k] - lo
                at, j = at[(j >= 0) & (j < hi - lo)], j[(j >= 0) & (j < hi - lo)]
                n[at] -= w[at, j] > 0
                w[at, j] = 0.0
            total = w.sum(axis=1)
            weighed = np.einsum("ij,j->i", w, v[lo:hi]) if plain else np.where(w > 0, w * np.where(w > 0, v[lo:hi], 0.0), 0.0).sum(axis=1)
            keep = n >= max(1, least)
            found.append((r[keep], weighed[keep] / total[keep], n[keep], total[keep]))
        r, mean, n, total = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, "int64"), np.empty(0), np.empty(0, "int64"), np.empty(0))
        mine = left.take(pa.array(r))
        columns = {"parameter": mine["p"], "station_id": mine["s"], "time": mine["t"], out: pa.array(mean), "neighbours": pa.array(n.astype("int32"))}
        if reach is not None:
            # the target itself may be among those counted, which only widens the bound
            beyond = (len(v) - n) / (reach * reach + 1)
            columns["dropped_share"] = pa.array(beyond / (total + beyond))
        return pa.table(columns)

    with_package(targets.sparkSession)
    return t.groupBy("p", "t").cogroup(o.groupBy("p", "t")).applyInArrow(group, schema)


def idw_all(targets: DataFrame, observed: DataFrame, meta: DataFrame, least: int, out: str = "idw") -> DataFrame:
    """As `idw` with the distances of all stations in `meta`, which are taken where targets and values meet."""
    return _weigh(targets, observed, meta, least, out, None)


def near_pairs(meta: DataFrame, reach: float) -> DataFrame:
    """(a, b, d) metres between different stations at most `reach` apart, from grid cells: no pair of stations farther than two cells meets.

    Cells are cubes of side `reach` in space, where a chord is never longer than the arc over it, so poles and the date line need no care.
    """
    r = 6371000.0
    lat, lon = F.radians("lat"), F.radians("lon")
    m = meta.where("lat is not null and lon is not null").select("id", "lat", "lon", *[F.floor(r * c / reach).cast("long").alias(n) for n, c in (("cx", F.cos(lat) * F.cos(lon)), ("cy", F.cos(lat) * F.sin(lon)), ("cz", F.sin(lat)))])
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = m
    for c in ("cx", "cy", "cz"):
        around = around.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    a, b = around.withColumnsRenamed({"id": "a", "lat": "lat_a", "lon": "lon_a"}), m.withColumnsRenamed({"id": "b", "lat": "lat_b", "lon": "lon_b"})
    met = a.join(b, ["cx", "cy", "cz"]).where("a <> b")
    return met.select("a", "b", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("d")).where(F.col("d") <= reach)


def idw_within(targets: DataFrame, observed: DataFrame, meta: DataFrame, reach: float, least: int, out: str = "idw") -> DataFrame:
    """As `idw`, from stations at most `reach` metres away, with `dropped_share`: a bound on the share of weight of those farther away.

    A station beyond the reach weighs less than 1 / (reach^2 + 1); how many there are comes from the located stations of the hour.
    """
    return _weigh(targets, observed, meta, least, out, reach)


def climatology(series: DataFrame, value: str) -> DataFrame:
    """series with `clim`: the station's median by (hour, weekday), else by hour, else over all."""
    s = series.withColumns({"_h": F.hour("time"), "_d": F.weekday("time")})
    hd = s.groupBy(*SERIES, "_h", "_d").agg(F.median(value).alias("_hd"))
    # hours and weekdays are few, so the other two medians keep the series' partitioning
    h = s.groupBy(*SERIES, "_h").agg(F.median(value).alias("_hm"))
    every = s.groupBy(*SERIES).agg(F.median(value).alias("_all"))
    j = s.join(hd, [*SERIES, "_h", "_d"], "left").join(h, [*SERIES, "_h"], "left").join(every, SERIES, "left")
    return j.withColumn("clim", F.coalesce("_hd", "_hm", "_all")).drop("_h", "_d", "_hd", "_hm", "_all")


def slot(time: Column) -> Column:
    return F.weekday(time) * 24 + F.hour(time)


def climate(s: DataFrame, limit: int | None = 24) -> DataFrame:
    """Series of `series_of`, `timed`, with `_clim`: for each slot (24 * weekday + hour) what `climatology` gives for the series' interpolated cells."""

    def middle(v: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Median of the values of each slot; NaN is the largest number, and what there is without values."""
        v, n = v[np.lexsort((v, at))], np.bincount(at, minlength=size)
        first = np.cumsum(n) - n
        low, high = ((first + k).clip(max=len(v) - 1) for k in (np.maximum(n - 1, 0) // 2, n // 2))
        return np.where(n == 0, np.nan, np.where(n % 2 == 1, v[low], 0.5 * v[low] + 0.5 * v[high]))

    def one(r: np.ndarray, x: np.ndarray, v: np.ndarray, slots: np.ndarray, t: np.ndarray) -> np.ndarray | None:
        if not len(r):
            return None
        place = np.arange(1, len(t) + 1)
        before, after = np.searchsorted(r, place, "right") - 1, np.searchsorted(r, place, "left")
        p, n, has_p, has_n = before.clip(min=0), after.clip(max=len(r) - 1), before >= 0, after < len(r)
        with np.errstate(all="ignore"):
            line = v[p] + (v[n] - v[p]) * (t - x[p]) / (x[n] - x[p])
        line = np.where(~has_p, v[n], np.where(~has_n | (before == after), v[p], line))
        if limit is not None:
            near = (has_p & (place - r[p] <= limit)) | (has_n & (r[n] - place <= limit))
            line, slots = line[near], slots[near]
        hours, hour = np.arange(168) % 24, middle(line, slots % 24, 24)
        out = np.where(np.bincount(slots % 24, minlength=24)[hours] > 0, hour[hours], middle(line, np.zeros(len(line), "int64"), 1)[0])
        return np.where(np.bincount(slots, minlength=168) > 0, middle(line, slots, 168), out)

    @F.arrow_udf("array<double>")
    def medians(rn: pa.Array, x: pa.Array, v: pa.Array, slots: pa.Array, t: pa.Array) -> pa.Array:
        parts = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (rn, x, v, slots, t)]
        return pa.array([one(*[c[o[i] : o[i + 1]] for c, o in parts]) for i in range(len(rn))], pa.list_(pa.float64()))

    with_package(s.sparkSession)
    slots, t = F.transform("_ticks", lambda c: slot(c).cast("long")), F.transform("_ticks", seconds)
    return s.withColumn("_clim", medians(F.col("_known.rn"), F.col("_known.x"), F.col("_known.v"), slots, t))


def cascade(hourly: DataFrame, meta: DataFrame, policy: DataFrame, *, use_idw: bool = False, reach: float | None = None, limit: int = 24, run_id: str = "run", values: bool = True) -> DataFrame:
    """The derived layer: every spine cell with value, method, confidence, uncertainty, source count, tier and gap length.

    policy: (parameter, p90); pollutants without a policy are left out. reach: metres within which stations count for use_idw (None: all). Cells that nothing fills have a null value.
    Without values all columns but `value` are as with them: what fills a cell follows from where values are, and no mean or median is taken.
    """
    observed = per_station(hourly).join(F.broadcast(policy.select("parameter")), "parameter", "left_semi")  # a row a pollutant
    names = hourly.groupBy("station_id").agg(F.min("station_name").alias("station_name"))
    at = located(meta).select("station_id", F.lit(True).alias("_at")) if use_idw else None
    s = series_of(observed).join(names, "station_id", "left").join(F.broadcast(policy), "parameter")
    s = (s if at is None else s.join(at, "station_id", "left")).transform(timed, times_of(observed, at))
    some = F.col("_med").isNotNull()
    if not use_idw:
        s = climate(s, limit) if values else s
        c = between(cells(s), "time", "value", "lin", limit)
        c = c.withColumn("neighbours", F.lit(None).cast("int"))
        c = c.withColumn("clim", F.get("_clim", slot(F.col("time")))) if values else c
        far, usual = F.lit(False), F.col("clim").isNotNull() if values else some
    elif not values and reach is None:
        # a hole's neighbours are the located stations with a value at its time
        s = s.withColumn("_any", some | F.coalesce(F.col("_at") & F.exists("_there", lambda n: n >= 2), F.lit(False)))
        c = between(cells(s), "time", "value", "lin", limit)
        c = c.withColumn("neighbours", F.when(F.col("lin").isNull() & F.col("_at") & (F.col("_there") >= 2), F.col("_there")).cast("int"))
        far, usual = F.col("neighbours").isNotNull(), F.col("_any")
    else:
        c = between(cells(s), "time", "value", "lin", limit)
        holes = c.where("lin is null")
        spatial = idw_all(holes, observed, meta, 2) if reach is None else idw_within(holes, observed, meta, reach, 2).drop("dropped_share")
        # the medians and the rows read it four times
        c = Rounds(hourly.sparkSession).put("spine", c.join(spatial, [*SERIES, "time"], "left").withColumn("_so_far", F.coalesce("lin", "idw")))
        c = climatology(c, "_so_far")
        far, usual = F.col("idw").isNotNull(), F.col("clim").isNotNull()
    c = gap_between(c, "value", "gap_hours")
    order = (("observed", F.col("value").isNotNull(), "value"), ("temporal_linear", F.col("lin").isNotNull(), "lin"), ("spatial_idw", far, "idw"), ("temporal_climatology", usual, "clim"), ("station_median", some, "_med"))

    def pick(what) -> Column:
        out = None
        for method, hit, column in order:
            if column in c.columns or not values:
                out = F.when(hit, what(method, column)) if out is None else out.when(hit, what(method, column))
        return out

    return c.select(
        "station_id", "time", *([pick(lambda m, v: F.col(v)).alias("filled")] if values else []), "parameter", F.col("value").alias("observed_value"),
        pick(lambda m, v: F.lit(m)).alias("impute_method"), pick(lambda m, v: F.lit(LINEAGE[m][0])).alias("impute_confidence"),
        pick(lambda m, v: F.lit(0.0) if m == "observed" else F.col("p90") * LINEAGE[m][1]).alias("impute_uncertainty_abs"),
        pick(lambda m, v: F.col("neighbours") if m == "spatial_idw" else F.lit(1)).alias("impute_source_count"),
        pick(lambda m, v: F.lit(LINEAGE[m][2])).alias("impute_tier"), "gap_hours", F.col("value").isNull().alias("is_imputed"), F.lit(run_id).alias("impute_run_id"), "station_name",
    ).withColumnRenamed("filled", "value")


#: Locations of holes that a task takes together, observed locations whose distances from them it holds, locations of a tile, tiles that fewer locations make, and observations that a tile holds.
NEAR, FAR, TILE, TILES, HELD = 2**8, 2**12, 2**12, 32, 2**23
#: A column is a pollutant's number and the number of its time in one.
TIMES = 2**24


def _products(far: tuple, near: tuple, cells: tuple, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights times values and of weights (columns by near locations), over `cells`: the order of observations by block of FAR locations and column, with their location, value, column, and the runs of equal ones."""
    (lat, lon), (who, value, at, starts) = far, cells
    total, weight = np.zeros((columns, len(near[0]))), np.zeros((columns, len(near[0])))
    w, block, rows = np.empty((min(FAR, len(lat)), len(near[0]))), -1, max(1, PAIRS // len(near[0]))
    most = int(np.diff(starts).max(initial=0))
    met, pair = np.empty((most, len(near[0]))), np.ones((2, most))
    for lo, hi in zip(starts[:-1], starts[1:]):
        if who[lo] // FAR != block:
            block = who[lo] // FAR
            first, last = block * FAR, min(len(lat), (block + 1) * FAR)
            for i in range(first, last, rows):
                h = square_m(lat[i : min(last, i + rows)], lon[i : min(last, i + rows)], *near)
                h += 1
                np.reciprocal(h, out=w[i - first : i - first + len(h)])
        n = hi - lo
        np.take(w, who[lo:hi] - first, axis=0, out=met[:n], mode="clip")
        pair[0, :n] = value[lo:hi]
        t, s = pair[:, :n] @ met[:n]
        total[at[lo]] += t
        weight[at[lo]] += s
    return total, weight


def _hole_means(observed: DataFrame, meta: DataFrame, kinds: DataFrame, limit: int, least: int) -> DataFrame:
    """(_pi, _rn, station_id, value, neighbours): means over all stations with a value at that time, weighted 1 / (d^2 + 1), at the located stations' cells with no value within `limit` rows, where there are `least`. kinds: (parameter, _pi).

    Stations are taken by location. A tile has the series of some locations and all observations of some times: a distance is
    taken once for a pair of locations and all times of a tile, and cells without a value appear in the result only.
    """
    at = located(meta)
    known = series_times(observed).join(at, "station_id").join(F.broadcast(kinds), "parameter")  # a row a pollutant
    value, rn = F.col("_k").isNotNull(), F.col("_k.rn")
    size = known.agg(F.count("_k").alias("cells"), F.max(rn).alias("last"), F.count_distinct("lat", "lon").alias("places")).first()
    span = max(limit, -(-(size["last"] or 1) // max(1, -(-size["cells"] // HELD))))
    chunks, tiles = -(-(size["last"] or 1) // span), max(1, -(-size["places"] // TILE), min(TILES, -(-size["places"] // NEAR)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    column = (F.col("_pi") * TIMES + rn).cast("int")
    seen = known.where(value).groupBy(F.floor((rn - 1) / span).cast("int").alias("_c"), "lat", "lon").agg(F.collect_list(F.struct(column.alias("at"), F.col("_k.v").alias("v"))).alias("_o"))
    seen = seen.select(every(tiles).alias("_b"), "_c", "lat", "lon", F.lit(None).cast(at.schema["station_id"].dataType).alias("station_id"), F.lit(None).cast("int").alias("_pi"), F.col("_o.at").alias("at"), F.col("_o.v").alias("v"))
    series = known.groupBy("_pi", "station_id", "lat", "lon").agg(F.collect_list(rn.cast("int")).alias("_rns")).withColumn("_c", every(chunks))
    mine = F.filter("_rns", lambda r: (r > F.col("_c") * span - limit) & (r <= (F.col("_c") + 1) * span + limit))
    series = series.select(F.pmod(F.xxhash64("lat", "lon"), F.lit(tiles)).cast("int").alias("_b"), "_c", "lat", "lon", "station_id", "_pi", mine.alias("at"), F.lit(None).cast("array<double>").alias("v"))

    def flat(lists: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Which row each value of the lists is in, and the values."""
        lists = lists.combine_chunks()
        return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)

    def places(rows: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Which location each row has, and the locations."""
        xy, which = np.unique(np.stack([rows["lat"].to_numpy(), rows["lon"].to_numpy()]), axis=1, return_inverse=True)
        return which.ravel(), (xy[0], xy[1])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        here = pa.compute.is_valid(rows["_pi"])
        far, near = rows.filter(pa.compute.invert(here)), rows.filter(here)
        if not far.num_rows or not near.num_rows:
            return
        where, ends = places(far)
        row, at = flat(far["at"], "int32")
        _, v = flat(far["v"], "float64")
        names, at = np.unique(at, return_inverse=True)
        count, who = np.bincount(at), where[row]
        order = np.lexsort((at, who // FAR))
        who, v, at = who[order], v[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(who // FAR) != 0) | (np.diff(at) != 0), [True]]))
        spot, spots = places(near)
        near = near.take(pa.array(np.argsort(spot, kind="stable")))
        spot = np.sort(spot)
        for i in range(0, len(spots[0]), NEAR):
            total, weight = _products(ends, (spots[0][i : i + NEAR], spots[1][i : i + NEAR]), (who, v, at, starts), len(names))
            lo, hi = np.searchsorted(spot, [i, i + NEAR])
            kind = near["_pi"].slice(lo, hi - lo).to_numpy()
            for pi in np.unique(kind):
                a, b = np.searchsorted(names, [pi * TIMES, (pi + 1) * TIMES])
                ids, times = lo + np.flatnonzero(kind == pi), names[a:b] - pi * TIMES
                step = max(1, (PAIRS * 2) // max(1, b - a))
                for k in range(0, len(ids) if b > a else 0, step):
                    some = near.take(pa.array(ids[k : k + step]))
                    j, r = flat(some["at"], "int64")
                    close = np.zeros((some.num_rows, b - a + 1), "int64")
                    np.add.at(close, (j, np.searchsorted(times, r - limit)), 1)
                    np.add.at(close, (j, np.searchsorted(times, r + limit, "right")), -1)
                    j, c = np.nonzero((np.cumsum(close[:, :-1], axis=1) == 0) & (count[a:b] >= least))
                    mean = total[a + c, spot[ids[k + j]] - i] / weight[a + c, spot[ids[k + j]] - i]
                    out = [pa.array(np.full(len(j), pi, "int32")), pa.array(times[c].astype("int32")), some["station_id"].combine_chunks().take(pa.array(j)), pa.array(mean), pa.array(count[a + c].astype("int32"))]
                    yield pa.RecordBatch.from_arrays(out, ["_pi", "_rn", "station_id", "value", "neighbours"])

    with_package(observed.sparkSession)
    kind = at.schema["station_id"].dataType.simpleString()
    # tiles are few rows and much work: as many tasks as hold one each, which Spark would join by size
    dealt = seen.unionByName(series).repartition(max(4 * tiles * chunks, int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_b", "_c")
    return dealt.groupBy("_b", "_c").applyInArrow(tile, f"_pi int, _rn int, station_id {kind}, value double, neighbours int")


def spatial_fills(hourly: DataFrame, meta: DataFrame, policy: DataFrame, limit: int = 24) -> DataFrame:
    """The cells of the cascade that neighbours fill, with their values; nothing else is computed."""
    observed = per_station(hourly).join(F.broadcast(policy.select("parameter")), "parameter", "left_semi")  # a row a pollutant
    kinds = times_of(observed).join(policy, "parameter").withColumn("_pi", F.row_number().over(Window.orderBy("parameter")) - 1)  # a row a pollutant
    means = _hole_means(observed, meta, kinds.select("parameter", "_pi"), limit, 2).join(F.broadcast(kinds), "_pi")
    confidence, factor, tier = LINEAGE["spatial_idw"]
    return means.select(F.get("_ticks", F.col("_rn") - 1).alias("time"), "station_id", "value", "parameter", F.lit(confidence).alias("impute_confidence"), (F.col("p90") * factor).alias("impute_uncertainty_abs"), F.col("neighbours").alias("impute_source_count"), F.lit(tier).alias("impute_tier"))


def summary(derived: DataFrame) -> DataFrame:
    """Rows by parameter, method, tier and whether imputed."""
    return derived.groupBy("parameter", "impute_method", "impute_tier", "is_imputed").agg(F.count("*").alias("rows"))


def totals(derived: DataFrame, by: list[str]) -> DataFrame:
    """Rows, imputed rows and mean confidence for each combination of `by` and all its totals, in one pass; `level` is the grouping id, 0 for single combinations."""
    return derived.rollup(*by).agg(F.count("*").alias("rows"), F.count_if("is_imputed").alias("imputed"), F.avg("impute_confidence").alias("confidence"), F.grouping_id().alias("level"))


def unresolved(derived: DataFrame) -> DataFrame:
    return derived.where("impute_method is null").withColumn("missing_reason", F.lit("no_valid_imputation_source"))


def sample_points(observed: DataFrame, n: int, order: Column, share: Column | None = None) -> DataFrame:
    """n observed points of each pollutant in a fixed order; `share` may thin them by hash before the ranking."""
    o = observed.where("value is not null")
    o = o.where(share) if share is not None else o
    return o.withColumn("_rn", F.row_number().over(Window.partitionBy("parameter").orderBy(order, "station_id", "time"))).where(F.col("_rn") <= n).drop("_rn")


def backtest(observed: DataFrame, samples: DataFrame, meta: DataFrame, reach: float | None = None) -> DataFrame:
    """(pollutant, station_id, time, method, truth, pred): each sampled point predicted by each method from the others, spatially from stations within `reach` metres (None: all).

    Climatology and station medians include the point itself. A pollutant with fewer than two located stations has no rows.
    """
    located = meta.where("lat is not null and lon is not null").select(F.col("id").alias("station_id"))
    enough = observed.join(located, "station_id", "left_semi").groupBy("parameter").agg(F.countDistinct("station_id").alias("n")).where("n >= 2").select("parameter")
    # only the series of sampled points, and only values of their times, go through the shuffles
    series, times = samples.select(*SERIES).distinct(), samples.select("parameter", "time").distinct()
    own = observed.join(series, SERIES, "left_semi")
    s = climatology(leave_one_out(own.where("value is not null"), SERIES, "time", "value", "lin"), "value")
    med = own.groupBy(*SERIES).agg(F.median("value").alias("med"))
    keys = [*SERIES, "time"]
    there = observed.join(times, ["parameter", "time"], "left_semi")
    p = samples.select(*keys, "value").join(s.select(*keys, "lin", "clim"), keys, "left").join(med, SERIES, "left").join(F.broadcast(enough), "parameter", "left_semi")
    p = p.join(idw_all(p, there, meta, 1) if reach is None else idw_within(p, there, meta, reach, 1).drop("dropped_share"), keys, "left")
    hybrid = F.when(F.col("lin").isNotNull() & F.col("idw").isNotNull(), 0.6 * F.col("lin") + 0.4 * F.col("idw")).otherwise(F.coalesce("lin", "idw"))
    preds = {"temporal_linear": F.col("lin"), "spatial_idw": F.col("idw"), "temporal_climatology": F.col("clim"), "station_median": F.col("med"), "hybrid_linear_idw": hybrid}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("pred")) for m, c in preds.items()]))
    return p.select(F.col("parameter").alias("pollutant"), "station_id", "time", F.col("value").alias("truth"), rows.alias("r")).select("pollutant", "station_id", "time", "truth", "r.*")


def scores(predictions: DataFrame) -> DataFrame:
    """Error metrics of each (pollutant, method)."""
    ae = F.abs(F.col("pred") - F.col("truth"))
    scale = predictions.groupBy("pollutant", "method").agg(F.greatest(F.median(F.abs("truth")), F.lit(1e-6)).alias("_scale"), F.count("*").alias("sample_count"))
    m = predictions.where("pred is not null").groupBy("pollutant", "method").agg(
        F.count("*").alias("predicted_count"), F.avg(ae).alias("mae"), F.sqrt(F.avg(ae * ae)).alias("rmse"),
        (100 * F.avg(ae / F.greatest(F.abs("truth"), F.lit(1e-6)))).alias("mape_pct"),
        (100 * F.avg(2 * ae / F.greatest(F.abs("truth") + F.abs("pred"), F.lit(1e-6)))).alias("smape_pct"), F.percentile(ae, F.lit(0.9)).alias("p90_abs_error"),
    )
    j = scale.join(m, ["pollutant", "method"], "left")
    return j.select("pollutant", "method", "sample_count", F.coalesce("predicted_count", F.lit(0)).alias("predicted_count"), (F.coalesce("predicted_count", F.lit(0)) / F.col("sample_count")).alias("coverage"), "mae", "rmse", "mape_pct", "smape_pct", (F.col("mae") / F.col("_scale")).alias("normalized_mae"), "p90_abs_error")


def composite() -> Column:
    return F.col("normalized_mae") + 0.6 * F.col("smape_pct") / 100 + 0.25 * (1 - F.col("coverage"))


def policy(scored: DataFrame) -> DataFrame:
    """Best and second method of each pollutant by the composite score, then RMSE."""
    s = scored.where("mae is not null").withColumn("composite", composite())
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("pollutant").orderBy("composite", "rmse", "method")))
    best, second = s.where("rn = 1"), s.where("rn = 2").select("pollutant", F.col("method").alias("fallback_method"))
    return best.select("pollutant", F.col("method").alias("primary_method"), F.col("p90_abs_error").alias("primary_p90_abs_error"), F.col("smape_pct").alias("primary_smape_pct")).join(second, "pollutant", "left")


def ranking(scored: DataFrame) -> DataFrame:
    """Methods over all pollutants, best first."""
    s = scored.where("mae is not null").withColumn("composite", composite())
    return s.groupBy("method").agg(F.avg("composite").alias("avg_composite"), F.avg("coverage").alias("avg_coverage"), F.avg("normalized_mae").alias("avg_nmae"), F.avg("smape_pct").alias("avg_smape"), F.countDistinct("pollutant").alias("pollutants")).orderBy("avg_composite", "avg_nmae")
