"""Fusion of point readings onto edges, and wind-directed spread along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions import physics
from hazegrid.functions.geo import to_utm
from hazegrid.functions.timeutil import floor_hour  # noqa: F401
from hazegrid.operators.graph import midpoint, with_bearing
from hazegrid.operators.scratch import Rounds

CENTRE = (12.9716, 77.5946)


def snapshot_points(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, wind_speed, wind_dir, points): the city's point, always, and the sensor's, if its payload is there.

    snapshots: snapshot_id and structs weather, air and sensor (null if absent). Missing readings are 0, unreadable
    coordinates the city centre.
    """
    num = lambda s, c, d=0.0: F.coalesce(F.col(s)[c].try_cast("double"), F.lit(d))

    def point(s: str, names: tuple[str, str, str]) -> Column:
        x, y = to_utm(num(s, "lat", CENTRE[0]), num(s, "lon", CENTRE[1]))
        return F.struct(x.alias("x"), y.alias("y"), *[num(s, c).alias(n) for c, n in zip(names, ("no2", "so2", "pm2_5"))])

    city, sensor = point("air", ("nitrogen_dioxide", "sulphur_dioxide", "pm2_5")), point("sensor", ("no2", "so2", "pm2_5"))
    points = F.when(F.col("sensor").isNotNull(), F.array(city, sensor)).otherwise(F.array(city))
    return snapshots.select("snapshot_id", num("weather", "wind_speed_10m", 0.2).alias("wind_speed"), num("weather", "wind_direction_10m").alias("wind_dir"), points.alias("points"))


def fuse(edges: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(snapshot_id, u, v, no2, so2, pm2_5, toxicity, x, y): each snapshot's points at each edge's middle, weighted 1 / (d^2 + 1).

    Points are an array of their snapshot, folded in place: edges by snapshots are the result itself, and nothing is shuffled for it.
    """
    # nodes meet distinct edges only
    e = with_bearing(edges.select("u", "v").distinct(), nodes.dropDuplicates(["osmid"]))
    mx, my = midpoint()
    j = at_points(e.select("u", "v", "bearing_deg", mx.alias("x"), my.alias("y")).crossJoin(points))
    return j.select("snapshot_id", "u", "v", *FUSED, "x", "y")


#: What fusion gives for each edge.
FUSED = ("no2", "so2", "pm2_5", "toxicity")


def at_points(rows: DataFrame) -> DataFrame:
    """Rows with a place (x, y), bearing_deg and a snapshot's points and wind, with no2, so2, pm2_5 and toxicity there. Points are weighed once and folded in one pass."""
    names = ("no2", "so2", "pm2_5")
    weight = lambda p: 1 / (F.pow(F.col("x") - p["x"], 2) + F.pow(F.col("y") - p["y"], 2) + 1)
    weighed = F.transform("points", lambda p: F.struct(weight(p).alias("w"), *[p[c].alias(c) for c in names]))
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("w", *names)])
    sums = F.aggregate(weighed, none, lambda a, p: F.struct((a["w"] + p["w"]).alias("w"), *[(a[c] + p["w"] * p[c]).alias(c) for c in names]))
    # a city's point and a sensor's, as snapshots have, are weighed by compiled expressions, longer arrays by the fold
    few = F.size("points") <= 2
    one, two = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    j = rows.withColumns({"_w1": F.when(few, weight(one)), "_w2": F.when(few, F.when(two.isNotNull(), weight(two)).otherwise(0.0)), "_sums": F.when(~few, sums)})
    pair = lambda c: (F.col("_w1") * one[c] + F.when(two.isNotNull(), F.col("_w2") * two[c]).otherwise(0.0)) / (F.col("_w1") + F.col("_w2"))
    j = j.withColumns({c: F.when(few, pair(c)).otherwise(F.col("_sums")[c] / F.col("_sums")["w"]) for c in names}).drop("_sums", "_w1", "_w2")
    base = F.greatest(F.lit(0.0), F.col("no2") + F.col("so2") + F.col("pm2_5"))
    return j.withColumn("toxicity", base * physics.wind_factor(F.col("wind_speed"), F.col("wind_dir"), F.col("bearing_deg")))


def incoming_mean(state: DataFrame, degree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, upstream): for each node, the mean state of its incoming edges over its in-degree."""
    m = state.groupBy(*keys, "v").agg(F.avg("s").alias("_m"))
    return m.join(degree, "v").select(*keys, F.col("v").alias("u"), (F.col("_m") / F.greatest(F.lit(1), F.col("in_degree"))).alias("upstream"))


def propagate(state: DataFrame, edges: DataFrame, wind: DataFrame, steps: int = 2, *, keys: list[str] | None = None, sigma: float = 35.0, cone: float = 75.0, alpha: float = 0.35, damping: float = 0.6, rounds: Rounds | None = None) -> DataFrame:
    """State (keys, u, v, s) after wind-directed message passing along edges (u, v, length, bearing_deg, building_density).

    wind: keys with wind_speed and wind_dir. Each step aggregates the incoming edges to one row a node, joins it on u and
    damps the change; values stay within 0 and 500. A step reads the one before twice, so each is written and read back.
    """
    keys = keys or []
    damping = max(0.05, min(1.0, damping))
    degree = edges.groupBy("v").agg(F.count("*").alias("in_degree"))
    attrs = edges.select("u", "v", F.coalesce("length", F.lit(100.0)).alias("length"), F.coalesce("bearing_deg", F.lit(0.0)).alias("bearing_deg"), F.coalesce("building_density", F.lit(0.5)).alias("density"))
    d = state.join(attrs, ["u", "v"])
    # one row for each key of `wind`, or one in all
    d = d.join(wind, keys) if keys else d.crossJoin(F.broadcast(wind))
    bearing, wd = F.col("bearing_deg"), F.col("wind_dir")
    delta = F.abs(F.pmod(bearing - wd + 180.0, F.lit(360.0)) - 180.0)
    sy, sz = physics.sigmas(F.col("length"))
    ew = physics.street_wind(F.greatest(F.lit(0.2), F.col("wind_speed")), F.col("density"))
    d = d.select(*keys, "u", "v", "s", "density", physics.diffusion_weight(bearing, wd, None, sigma, cone).alias("dw"), ew.alias("ew"), physics.plume(F.lit(1.0), F.abs(F.sin(F.radians(delta)) * F.col("length")), ew, sy, sz).alias("unit_plume"))
    rounds = rounds or Rounds(state.sparkSession)
    for _ in range(max(1, steps)):
        d = rounds.put("state", d)
        up = incoming_mean(d.select(*keys, "v", "s"), degree, keys)
        j = d.join(up, [*keys, "u"], "left")
        s, dw = F.col("s"), F.col("dw")
        raw = physics.canyon(s + dw * F.greatest(F.lit(0.1), s) * F.col("unit_plume") + alpha * F.coalesce("upstream", F.lit(0.0)) * dw, F.col("density"), F.col("ew"))
        new = F.greatest(F.lit(0.0), F.least(F.lit(500.0), (1 - damping) * s + damping * raw))
        d = j.withColumn("s", new).drop("upstream")
    return d.select(*keys, "u", "v", "s")


def spread_over(edges: DataFrame, wind: DataFrame, start: Column, steps: int = 2, *, key: str = "snapshot_id", sigma: float = 35.0, cone: float = 75.0, alpha: float = 0.35, damping: float = 0.6, rounds: Rounds | None = None) -> DataFrame:
    """As `propagate` for each row of `wind` (key, wind_speed, wind_dir and others), without storing or shuffling edges by keys: rows of edges by wind with the state `s`, which is `start` (not null) at first.

    edges: one row a (u, v), with length, bearing_deg, building_density and others. Each step stores its means, a row a node
    with a map by key; the state of an edge is computed anew from the means of the steps so far, where the edge meets them.
    """
    rounds = rounds or Rounds(edges.sparkSession)
    damping = max(0.05, min(1.0, damping))
    x = rounds.put("edges", edges)
    length, bearing, density = F.coalesce("length", F.lit(100.0)), F.coalesce("bearing_deg", F.lit(0.0)), F.coalesce("building_density", F.lit(0.5))
    wd = F.col("wind_dir")
    delta = F.abs(F.pmod(bearing - wd + 180.0, F.lit(360.0)) - 180.0)
    sy, sz = physics.sigmas(length)
    ew = physics.street_wind(F.greatest(F.lit(0.2), F.col("wind_speed")), density)

    def state(means: list[DataFrame]) -> DataFrame:
        d = x
        for m in means:
            d = d.join(m, "u", "left")
        d = d.crossJoin(F.broadcast(wind))  # a row a snapshot
        d = d.withColumns({"s": start, "_dw": physics.diffusion_weight(bearing, wd, None, sigma, cone), "_ew": ew, "_plume": physics.plume(F.lit(1.0), F.abs(F.sin(F.radians(delta)) * length), ew, sy, sz)})
        for k in range(len(means)):
            s, dw, up = F.col("s"), F.col("_dw"), F.coalesce(F.col(f"_up{k}")[F.col(key)], F.lit(0.0))
            raw = physics.canyon(s + dw * F.greatest(F.lit(0.1), s) * F.col("_plume") + alpha * up * dw, density, F.col("_ew"))
            d = d.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(500.0), (1 - damping) * s + damping * raw)))
        return d.drop("_dw", "_ew", "_plume", *[f"_up{k}" for k in range(len(means))])

    means: list[DataFrame] = []
    for k in range(max(1, steps)):
        m = state(means).groupBy(F.col("v").alias("u"), key).agg((F.avg("s") / F.count("*")).alias("_m"))
        means.append(rounds.put(f"up{k}", m.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct(key, "_m"))).alias(f"_up{k}"))))
    return state(means)


def training_rows(fused: DataFrame, target: DataFrame) -> DataFrame:
    """Edge features of each snapshot with the propagated target; missing values are 0."""
    j = fused.join(target.withColumnRenamed("s", "target"), ["snapshot_id", "u", "v"], "left")
    return j.select("snapshot_id", "u", "v", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("no2", "so2", "pm2_5", "toxicity", "target")])


def cell_means(df: DataFrame, x: str, y: str, value: str, side: float) -> DataFrame:
    """Mean and count of a value in each square cell, with the smallest and largest mean of all for a colour scale."""
    m = df.groupBy(F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return m.crossJoin(F.broadcast(m.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))))


def advect(grid: DataFrame, dt: float = 300.0, cell: float = 100.0) -> DataFrame:
    """One step of transport on grids (grid_id, r, c, concentration, wind_u, wind_v): central differences inside, one-sided at the rims."""

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy("grid_id", across).orderBy(along)
        a, b = F.lag("concentration").over(w), F.lead("concentration").over(w)
        here = F.col("concentration")
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2).when(b.isNotNull(), b - here).when(a.isNotNull(), here - a).otherwise(0.0) / cell

    d = grid.withColumn("_dx", slope("c", "r")).withColumn("_dy", slope("r", "c"))
    return d.select("grid_id", "r", "c", F.greatest(F.lit(0.0), F.col("concentration") - dt * (F.col("wind_u") * F.col("_dx") + F.col("wind_v") * F.col("_dy"))).alias("concentration"))
