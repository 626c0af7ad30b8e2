"""Queries of the road graph, fusion, spread and geometry operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hazegrid.functions import geo, physics
from hazegrid.operators import diffusion as D
from hazegrid.operators import graph as GR
from hazegrid.plans.registry import query, r6

ENDS = {"ee": "SELECT e.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, ((degrees(atan2(b.y - a.y, b.x - a.x)) % 360) + 360) % 360 AS bearing FROM road_edges e JOIN road_nodes a ON a.osmid = e.u JOIN road_nodes b ON b.osmid = e.v"}
SIMPLE = ENDS | {"se": "SELECT u, v, arg_min(length, key) AS length, arg_min(bearing, key) AS bearing, arg_min(building_density, key) AS bd, arg_max(length, key) AS seed, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2 FROM ee GROUP BY u, v"}
ANGLE = "abs(((({a} - {b} + 180) % 360) + 360) % 360 - 180)"


def edges(t):
    return GR.with_bearing(t.road_edges(), t.road_nodes())


def simple(t):
    # nodes meet distinct edges only
    e = t.road_edges().groupBy("u", "v").agg(*[F.min_by(c, "key").alias(c) for c in ("length", "building_density")], F.max_by("length", "key").alias("seed"))
    return GR.with_bearing(e, t.road_nodes())


@query("m3_edge_bearing", "road_nodes road_edges", "SELECT u, v, key, round(bearing, 6) AS bearing_deg FROM ee", ENDS)
def _(t):
    return edges(t).select("u", "v", "key", *r6("bearing_deg"))


@query("m4_edge_midpoint", "road_nodes road_edges", "SELECT u, v, key, round(CASE WHEN key = 0 THEN (x1 + x1 + 4) / 2 ELSE (x1 + x2) / 2 END, 6) AS mx, round((y1 + CASE WHEN key = 0 THEN y1 ELSE y2 END) / 2, 6) AS my FROM ee", ENDS)
def _(t):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    e = edges(t).withColumn("geometry", F.when(F.col("key") == 0, F.array(p(F.col("x1"), F.col("y1")), p(F.lit(0.0), F.lit(0.0)), p(F.col("x1") + 4, F.col("y1")))))
    mx, my = GR.midpoint(F.col("geometry"))
    return e.select("u", "v", "key", mx.alias("mx"), my.alias("my")).select("u", "v", "key", *r6("mx", "my"))


@query("m1_haversine", "station_meta", "SELECT a.id AS a, b.id AS b, round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS d, true AS forms_agree FROM station_meta a JOIN station_meta b ON b.id = a.id + 1")
def _(t):
    m = t.station_meta()
    j = m.select(F.col("id").alias("a"), F.col("lat").alias("p"), F.col("lon").alias("q")).join(m.select(F.col("id").alias("b"), "lat", "lon"), F.col("b") == F.col("a") + 1)
    one, two = geo.haversine_m(F.col("p"), F.col("q"), F.col("lat"), F.col("lon")), geo.haversine_atan2_m(F.col("p"), F.col("q"), F.col("lat"), F.col("lon"))
    return j.select("a", "b", F.round(one, 3).alias("d"), (F.abs(one - two) < 1e-6).alias("forms_agree"))


def _utm_sql() -> str:
    east, north = "eta", "xi"
    for j, a in enumerate(geo._ALPHA, 1):
        east += f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        north += f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = f"{0.9996 * geo._RADIUS!r}::DOUBLE"
    return f"SELECT id, round(500000 + {k} * ({east}), 3) AS x, round({k} * ({north}), 3) AS y, true AS round_trip FROM (SELECT id, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM (SELECT id, radians(lon - 75) AS d, sinh(atanh(sin(radians(lat))) - {geo._E!r}::DOUBLE * atanh({geo._E!r}::DOUBLE * sin(radians(lat)))) AS t FROM station_meta))"


@query("m2_utm", "station_meta", _utm_sql())
def _(t):
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    m = t.station_meta().withColumns({"x": x, "y": y})
    lat, lon = geo.from_utm(F.col("x"), F.col("y"))
    return m.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), ((F.abs(lat - F.col("lat")) < 1e-8) & (F.abs(lon - F.col("lon")) < 1e-8)).alias("round_trip"))


@query("m5_m6_diffusion_weight", "road_nodes road_edges", f"SELECT u, v, key, round(d, 6) AS diff, round(CASE WHEN d <= 75 THEN exp(-(d * d) / 2450) ELSE 0 END, 6) AS plain, round(CASE WHEN t <= 75 THEN exp(-(t * t) / 2450) ELSE 0 END, 6) AS tunnelled FROM (SELECT *, CASE WHEN building_density > 0.7 THEN {ANGLE.format(a='bearing', b='(CASE WHEN d = 0 THEN 40 WHEN d < 180 THEN (40 + 0.85::DOUBLE * d) % 360 ELSE ((40 - 0.85::DOUBLE * (360 - d)) % 360 + 360) % 360 END)')} ELSE d END AS t FROM (SELECT *, {ANGLE.format(a='bearing', b='40')} AS d FROM ee))", ENDS)
def _(t):
    b, w = F.col("bearing_deg"), F.lit(40.0)
    e = edges(t).select("u", "v", "key", geo.angle_difference_deg(b, w).alias("diff"), physics.diffusion_weight(b, w).alias("plain"), physics.diffusion_weight(b, w, F.col("building_density")).alias("tunnelled"))
    return e.select("u", "v", "key", *r6("diff", "plain", "tunnelled"))


@query("m7_m8_wind", "weather_hourly", f"SELECT time, round(greatest(0.2, (1 + 0.15::DOUBLE * s) * exp(-pow({ANGLE.format(a='120', b='d')} / 45, 2))), 6) AS factor, round(s * sin(radians(d)), 6) AS u, round(s * cos(radians(d)), 6) AS v, round(greatest(0.2, sqrt(pow(s * sin(radians(d)), 2) + pow(s * cos(radians(d)), 2))), 6) AS speed FROM (SELECT time, wind_speed_10m AS s, wind_direction_10m AS d FROM weather_hourly)")
def _(t):
    s, d = F.col("wind_speed_10m"), F.col("wind_direction_10m")
    u, v = physics.wind_components(s, d)
    return t.weather_hourly().select("time", physics.wind_factor(s, d, F.lit(120.0)).alias("factor"), u.alias("u"), v.alias("v"), physics.wind_state(u, v)[0].alias("speed")).select("time", *r6("factor", "u", "v", "speed"))


STAB = "CASE WHEN w < 2 THEN CASE WHEN night THEN 'F' WHEN coalesce(sun, 0) < 200 THEN 'E' ELSE 'A' END WHEN w < 3 THEN CASE WHEN night THEN 'E' WHEN coalesce(sun, 0) < 200 THEN 'D' WHEN sun < 400 THEN 'B' ELSE 'A' END WHEN w < 5 THEN CASE WHEN night OR coalesce(sun, 0) < 200 THEN 'D' WHEN sun < 400 THEN 'C' ELSE 'B' END WHEN w < 6 THEN CASE WHEN NOT night AND coalesce(sun, 0) >= 400 THEN 'C' ELSE 'D' END ELSE 'D' END"


@query("m9_m13_stability_plume", "weather_hourly", f"SELECT time, cls, round(sy, 6) AS sy, round(sz, 6) AS sz, round(20 / (2 * pi() * ew * sy * sz) * exp(-64 / (2 * sy * sy)) * exp(-4 / (2 * sz * sz)), 6) AS plume, round(ew, 6) AS street, round(10 * (1 + 0.6::DOUBLE * 0.8::DOUBLE + 0.15::DOUBLE * greatest(0, 1 - least(1, ew / 3))), 6) AS canyon, CASE WHEN hour(time) % 2 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS z0 FROM (SELECT *, greatest(2, 100 * CASE cls WHEN 'A' THEN 0.27 WHEN 'B' THEN 0.24 WHEN 'C' THEN 0.22 WHEN 'D' THEN 0.20 WHEN 'E' THEN 0.14 ELSE 0.10 END::DOUBLE) AS sy, greatest(1, 100 * CASE cls WHEN 'A' THEN 0.20 WHEN 'B' THEN 0.12 WHEN 'C' THEN 0.08 WHEN 'D' THEN 0.06 WHEN 'E' THEN 0.03 ELSE 0.016 END::DOUBLE) AS sz, greatest(0.2, w * (1 - 0.55::DOUBLE * 0.8::DOUBLE)) AS ew FROM (SELECT time, w, {STAB} AS cls FROM (SELECT time, wind_speed_10m AS w, CASE WHEN hour(time) % 5 <> 0 THEN hour(time) * 30 END AS sun, hour(time) >= 20 AS night FROM weather_hourly)))")
def _(t):
    w, h = F.col("wind_speed_10m"), F.hour("time")
    d = t.weather_hourly().select("time", w, physics.stability_class(w, F.when(h % 5 != 0, h * 30), h >= 20).alias("cls"))
    sy, sz = physics.sigmas(F.lit(100.0), F.col("cls"))
    ew = physics.street_wind(w, F.lit(0.8))
    d = d.select("time", "cls", sy.alias("sy"), sz.alias("sz"), physics.plume(F.lit(20.0), F.lit(8.0), ew, sy, sz).alias("plume"), ew.alias("street"), physics.canyon(F.lit(10.0), F.lit(0.8), ew).alias("canyon"), physics.roughness(F.when(h % 2 == 0, "Urban").otherwise("moon")).alias("z0"))
    return d.select("time", "cls", *r6("sy", "sz", "plume", "street", "canyon"), "z0")


@query("m14_dose", "road_edges commuters", "SELECT id, round(40 * CASE mode WHEN 'cyclist' THEN 3.5 WHEN 'jogger' THEN 1.2 ELSE 0.6 END::DOUBLE * distance_tolerance_m / 6 / 3600, 6) AS dose FROM commuters")
def _(t):
    mode = F.when(F.col("mode") == "cyclist", "cycling").when(F.col("mode") == "jogger", "walking").otherwise(F.col("mode"))
    return t.commuters().select("id", physics.dose(F.lit(40.0), F.col("distance_tolerance_m") / 6, mode).alias("dose")).select("id", *r6("dose"))


@query("m15_elevation", "road_nodes", "SELECT osmid, round(800 + 200 * (y - (SELECT min(y) FROM road_nodes)) / ((SELECT max(y) FROM road_nodes) - (SELECT min(y) FROM road_nodes)), 6) AS elevation_m FROM road_nodes")
def _(t):
    return GR.elevation(t.road_nodes()).select("osmid", *r6("elevation_m"))


DENS = {"dn": "SELECT user_id AS station_id, date_trunc('hour', ts)::TIMESTAMP AS time, count(*) AS n FROM events GROUP BY ALL", "bl": "SELECT station_id, avg(n) AS b FROM dn GROUP BY 1"}


@query("m16_traffic_excess", "", "SELECT station_id, time, round(CASE WHEN n > 1.5::DOUBLE * b THEN greatest(0, n - b) ELSE 0 END, 6) AS excess, round(10 + 2 * CASE WHEN n > 1.5::DOUBLE * b THEN greatest(0, n - b) ELSE 0 END, 6) AS conc FROM dn JOIN bl USING (station_id)", DENS)
def _(t):
    from hazegrid.functions.timeutil import floor_hour

    n = t.raw("events").groupBy(F.col("user_id").alias("station_id"), floor_hour(F.col("ts")).alias("time")).agg(F.count("*").alias("n"))
    b = n.groupBy("station_id").agg(F.avg("n").alias("b"))
    x = physics.excess(F.col("n"), F.col("b"), 1.5)
    return n.join(b, "station_id").select("station_id", "time", x.alias("excess"), (10 + 2 * x).alias("conc")).select("station_id", "time", *r6("excess", "conc"))


@query("m17_upwind_flag", "road_nodes road_edges", f"SELECT u, v, key, length > 0 AND {ANGLE.format(a='bearing', b='75')} >= 110 AS upwind FROM ee", ENDS)
def _(t):
    return edges(t).select("u", "v", "key", geo.is_upwind(F.col("bearing_deg"), F.lit(75.0), F.col("length")).alias("upwind"))


@query("m22_point_on_route", "road_nodes", "SELECT osmid, round(x + 10 * 0.5::DOUBLE, 6) AS lat, round(y, 6) AS lon FROM road_nodes")
def _(t):
    p = lambda dx: F.struct((F.col("x") + dx).alias("lat"), F.col("y").alias("lon"))
    n = t.road_nodes().select("osmid", geo.point_on_route(F.array(p(0), p(10), p(20)), F.lit(0.25)).alias("p"))
    return n.select("osmid", "p.*").select("osmid", *r6("lat", "lon"))


@query("a13_graph_audit", "road_nodes road_edges", "SELECT (SELECT count(*) FROM road_nodes) AS nodes, (SELECT count(*) FROM road_nodes WHERE osmid NOT IN (SELECT u FROM road_edges) AND osmid NOT IN (SELECT v FROM road_edges)) AS isolated, count(*) AS edges, min(length) AS min_length, max(length) AS max_length, 0 AS dangling_ends, round(count(*) / ((SELECT count(*) FROM road_nodes) * ((SELECT count(*) FROM road_nodes) - 1)), 6) AS density FROM road_edges")
def _(t):
    a = GR.graph_audit(t.road_nodes(), t.road_edges())
    return a.select("nodes", "isolated", "edges", "min_length", "max_length", "dangling_ends", *r6("density"))


@query("a13_degrees", "road_nodes road_edges", "SELECT osmid, (SELECT count(*) FROM road_edges WHERE u = osmid) + (SELECT count(*) FROM road_edges WHERE v = osmid) AS degree FROM road_nodes")
def _(t):
    return GR.degrees(t.road_nodes(), t.road_edges())


@query("w14_node_index", "road_nodes", "SELECT osmid, row_number() OVER (ORDER BY osmid) - 1 AS node_index FROM road_nodes")
def _(t):
    return GR.index_ids(t.road_nodes(), "osmid", "node_index", 256)


CLASS = "CASE highway WHEN '[''Primary'', ''secondary'']' THEN 'primary' WHEN 'Residential;service' THEN 'residential' ELSE 'tertiary' END"
TABLE = {"ix": "SELECT osmid, row_number() OVER (ORDER BY osmid) - 1 AS i FROM road_nodes", "et": f"SELECT DISTINCT u_idx, v_idx, length, highway AS raw, {CLASS} AS highway FROM (SELECT a.i AS u_idx, b.i AS v_idx, length, highway FROM road_edges JOIN ix a ON a.osmid = u JOIN ix b ON b.osmid = v UNION ALL SELECT b.i, a.i, length, highway FROM road_edges JOIN ix a ON a.osmid = u JOIN ix b ON b.osmid = v) WHERE u_idx <> v_idx"}


@query("c8_edge_table", "road_nodes road_edges", "SELECT u_idx, v_idx, length, highway, CAST(dense_rank() OVER (ORDER BY highway) - 1 AS INTEGER) AS highway_code FROM et", TABLE)
def _(t):
    return GR.edge_table(t.road_edges(), t.road_nodes())


@query("w15_one_hot", "road_nodes road_edges", "SELECT highway, string_agg(CASE WHEN k = code THEN '1' ELSE '0' END, ',' ORDER BY k) AS hot FROM (SELECT highway, dense_rank() OVER (ORDER BY highway) - 1 AS code FROM (SELECT DISTINCT highway FROM et)), (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1", TABLE)
def _(t):
    e = GR.edge_table(t.road_edges(), t.road_nodes()).select("highway", "highway_code").distinct()
    return e.select("highway", F.array_join(F.transform(GR.one_hot(F.col("highway_code"), 3), lambda x: x.cast("int").cast("string")), ",").alias("hot"))


@query("g2_simple_edges", "road_nodes road_edges", "SELECT u, v, arg_min(length, key) AS length, arg_max(highway, key) AS highway FROM road_edges GROUP BY u, v")
def _(t):
    return GR.simple_edges(t.road_edges(), ["length"], ["highway"])


@query("j6_nearest_node", "road_nodes", "SELECT id, arg_min(osmid, (sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)), osmid)) AS tid, round(min(sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2))), 6) AS distance_meters FROM (SELECT o_orderkey AS id, 769000 + o_orderkey * 331 % 32011 AS x, 1419000 + o_custkey * 577 % 36013 AS y FROM orders) p, road_nodes n GROUP BY id")
def _(t):
    p = t.raw("orders").select(F.col("o_orderkey").alias("id"), (769000 + F.col("o_orderkey") * 331 % 32011).cast("double").alias("x"), (1419000 + F.col("o_custkey") * 577 % 36013).cast("double").alias("y"))
    return GR.nearest(p, t.road_nodes().withColumnRenamed("osmid", "tid")).select("id", "tid", *r6("distance_meters"))


@query("j12_sensor_mask", "road_nodes station_meta", "SELECT osmid, osmid IN (SELECT id * 3 FROM station_meta) AS train_mask FROM road_nodes")
def _(t):
    return GR.sensor_mask(t.road_nodes(), t.station_meta().select((F.col("id") * 3).alias("osmid")))


@query("j12_unmatched_sensors", "road_nodes station_meta", "SELECT DISTINCT id * 31 AS osmid FROM station_meta WHERE id * 31 NOT IN (SELECT osmid FROM road_nodes)")
def _(t):
    return GR.unmatched_sensors(t.road_nodes(), t.station_meta().select((F.col("id") * 31).alias("osmid")))


@query("j13_induced_subgraph", "road_nodes road_edges", "SELECT u, v, key, length FROM road_edges WHERE u % 3 <> 0 AND v % 3 <> 0")
def _(t):
    return GR.induced(t.road_edges(), t.road_nodes().where("osmid % 3 <> 0")).select("u", "v", "key", "length")


@query("g4_two_hops", "road_edges station_meta", "SELECT osmid, min(hop) AS hop FROM (SELECT s AS osmid, 0 AS hop FROM sd UNION ALL SELECT u, 1 FROM road_edges JOIN sd ON v = s UNION ALL SELECT a.u, 2 FROM road_edges a JOIN road_edges b ON a.v = b.u JOIN sd ON b.v = s) GROUP BY 1", {"sd": "SELECT DISTINCT id * 3 AS s FROM station_meta"})
def _(t):
    return GR.k_hop(t.road_edges(), t.station_meta().select((F.col("id") * 3).alias("osmid")), 2)


@query("t4_capped_subgraph", "road_nodes road_edges", "SELECT u, v, key FROM road_edges WHERE u IN (SELECT osmid FROM cap) AND v IN (SELECT osmid FROM cap)", {"cap": "SELECT osmid FROM road_nodes ORDER BY osmid * 2654435761 % 1000003, osmid LIMIT 100"})
def _(t):
    n = GR.cap_nodes(t.road_nodes(), 100, F.col("osmid") * 2654435761 % 1000003)
    return GR.induced(t.road_edges(), n).select("u", "v", "key")


HOPS = {"sd": "SELECT DISTINCT id * 3 AS s FROM station_meta", "hp": "SELECT DISTINCT osmid FROM (SELECT s AS osmid FROM sd UNION ALL SELECT u FROM road_edges JOIN sd ON v = s UNION ALL SELECT a.u FROM road_edges a JOIN road_edges b ON a.v = b.u JOIN sd ON b.v = s)", "ix": "SELECT osmid, row_number() OVER (ORDER BY osmid) - 1 AS idx FROM hp"}


@query("g4_relabelled_subgraph", "road_edges station_meta", "SELECT a.idx AS u_idx, b.idx AS v_idx, key, length FROM road_edges JOIN ix a ON a.osmid = u JOIN ix b ON b.osmid = v", HOPS)
def _(t):
    near = GR.k_hop(t.road_edges(), t.station_meta().select((F.col("id") * 3).alias("osmid")), 2)
    return GR.relabel(t.road_edges(), near, ["key", "length"]).select(F.col("u_idx").cast("long").alias("u_idx"), F.col("v_idx").cast("long").alias("v_idx"), "key", "length")


def _lloyd(k: int, rounds: int) -> dict[str, str]:
    out = {"c0": f"SELECT row_number() OVER (ORDER BY r) - 1 AS c, x, y FROM (SELECT x, y, row_number() OVER (ORDER BY osmid % 1000003 * 2654435761 % 1000003, osmid) - 1 AS r FROM road_nodes) WHERE r IN (SELECT i * (SELECT count(*) FROM road_nodes) // {k} FROM range({k}) s(i))"}
    for i in range(rounds + 1):
        out[f"a{i}"] = f"SELECT osmid, any_value(n.x) AS x, any_value(n.y) AS y, arg_min(c, {{'d': pow(n.x - m.x, 2) + pow(n.y - m.y, 2), 'c': c}}) AS c FROM road_nodes n, c{i} m GROUP BY osmid"
        out[f"c{i + 1}"] = f"SELECT o.c, coalesce(m.x, o.x) AS x, coalesce(m.y, o.y) AS y FROM c{i} o LEFT JOIN (SELECT c, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY c) m USING (c)"
    return out


@query("g5_lloyd_edges", "road_nodes road_edges", "SELECT CAST(a.c AS INTEGER) AS cluster, count(*) AS edges, sum(e.length) AS length FROM road_edges e JOIN a5 a ON a.osmid = u JOIN a5 b ON b.osmid = v WHERE a.c = b.c GROUP BY 1", _lloyd(64, 5))
def _(t):
    c = GR.lloyd(t.road_nodes(), 64, 5)
    return GR.inner_edges(t.road_edges(), c).groupBy("cluster").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))


@query("g5_cluster_edges")
def _(t):
    c = GR.spatial_clusters(t.road_nodes(), 8)
    return GR.inner_edges(t.road_edges(), c).groupBy("cluster").agg(F.count("*").alias("edges"))


@query("c7_node_features", "road_nodes air_hourly", "SELECT osmid, round(CASE WHEN pm = 0 THEN 1 ELSE pm END, 6) AS pm10, round(elev, 6) AS elevation_m FROM (SELECT osmid, (SELECT median(pm10) FROM air_hourly WHERE hour(time) = osmid % 24) AS pm0, coalesce(nullif((SELECT median(pm10) FROM air_hourly WHERE hour(time) = osmid % 24), 0), (SELECT median(m) FROM (SELECT (SELECT median(pm10) FROM air_hourly WHERE hour(time) = n.osmid % 24) AS m FROM road_nodes n) WHERE m <> 0)) AS pm, greatest(800, least(1000, 800 + 200 * (y - (SELECT min(y) FROM road_nodes)) / ((SELECT max(y) FROM road_nodes) - (SELECT min(y) FROM road_nodes)))) AS elev FROM road_nodes)")
def _(t):
    from hazegrid.functions.clean import clamp, fill_with_median

    env = GR.feature_medians(t.air_hourly().withColumn("h", F.hour("time").cast("long")), ["h"], ["pm10"])
    n = GR.elevation(t.road_nodes()).withColumn("h", F.col("osmid") % 24).join(env, "h", "left").withColumn("elevation_m", clamp(F.col("elevation_m"), 800.0, 1000.0))
    return fill_with_median(n, ["pm10"]).select("osmid", *r6("pm10", "elevation_m"))


@query("a12_feature_medians", "air_hourly", "SELECT CAST(hour(time) AS INTEGER) AS h, round(median(pm10), 6) AS pm10, round(median(pm2_5), 6) AS pm2_5 FROM air_hourly GROUP BY 1")
def _(t):
    return GR.feature_medians(t.air_hourly().withColumn("h", F.hour("time")), ["h"], ["pm10", "pm2_5"]).select("h", *r6("pm10", "pm2_5"))


def snapshots(t):
    """A snapshot for each weekday: the mean state of its hours."""
    h = t.weather_hourly().join(t.air_hourly(), "time").groupBy(F.weekday("time").cast("long").alias("snapshot_id"))
    h = h.agg(*[F.avg(c).alias(c) for c in ("wind_speed_10m", "wind_direction_10m", "nitrogen_dioxide", "sulphur_dioxide", "pm2_5")])
    return h.select("snapshot_id", F.struct("wind_speed_10m", "wind_direction_10m", F.lit("x").alias("lat"), F.lit("x").alias("lon")).alias("weather"), F.struct("nitrogen_dioxide", "sulphur_dioxide", "pm2_5", F.lit("#city").alias("lat"), F.lit("#city").alias("lon")).alias("air"), F.struct(F.lit("12.95").alias("lat"), F.lit("77.60").alias("lon"), F.lit("11.5").alias("no2"), F.lit("n/a").alias("so2"), F.lit(30.0).alias("pm2_5")).alias("sensor"))


def _xy(lat: float, lon: float) -> tuple[float, float]:
    s = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - geo._E * math.atanh(geo._E * s))
    d = math.radians(lon - 75)
    xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
    k = 0.9996 * geo._RADIUS
    return 500000 + k * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1))), k * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1)))


(CX, CY), (SX, SY) = _xy(*D.CENTRE), _xy(12.95, 77.60)
FUSED = SIMPLE | {
    "sn": "SELECT isodow(time) - 1 AS snapshot_id, avg(w.wind_speed_10m) AS ws, avg(w.wind_direction_10m) AS wd, coalesce(avg(a.nitrogen_dioxide), 0) AS no2, coalesce(avg(a.sulphur_dioxide), 0) AS so2, coalesce(avg(a.pm2_5), 0) AS pm FROM weather_hourly w JOIN air_hourly a USING (time) GROUP BY 1",
    "fz": f"SELECT snapshot_id, u, v, ws, wd, bearing, x, y, (w1 * no2 + w2 * 11.5) / (w1 + w2) AS no2, w1 * so2 / (w1 + w2) AS so2, (w1 * pm + w2 * 30) / (w1 + w2) AS pm2_5 FROM (SELECT *, 1 / (pow(x - {CX!r}::DOUBLE, 2) + pow(y - {CY!r}::DOUBLE, 2) + 1) AS w1, 1 / (pow(x - {SX!r}::DOUBLE, 2) + pow(y - {SY!r}::DOUBLE, 2) + 1) AS w2 FROM (SELECT u, v, bearing, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM se) e, sn)",
    "fused": f"SELECT snapshot_id, u, v, no2, so2, pm2_5, greatest(0, no2 + so2 + pm2_5) * greatest(0.2, (1 + 0.15::DOUBLE * ws) * exp(-pow({ANGLE.format(a='bearing', b='wd')} / 45, 2))) AS toxicity, x, y FROM fz",
}


def fused(t):
    return D.fuse(t.road_edges(), t.road_nodes(), D.snapshot_points(snapshots(t)))


@query("c9_edge_fusion", "road_nodes road_edges weather_hourly air_hourly", "SELECT snapshot_id, u, v, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("no2", "so2", "pm2_5", "toxicity", "x", "y")) + " FROM fused", FUSED)
def _(t):
    return fused(t).select("snapshot_id", "u", "v", *[F.round(c, 4).alias(c) for c in ("no2", "so2", "pm2_5", "toxicity", "x", "y")])


def _step(source: str, name: str) -> dict[str, str]:
    return {
        f"{name}_in": f"SELECT v, avg(s) / (SELECT greatest(1, count(*)) FROM se d WHERE d.v = q.v) AS up FROM {source} q GROUP BY v",
        name: f"SELECT q.u, q.v, greatest(0, least(500, 0.4::DOUBLE * s + 0.6::DOUBLE * (s + dw * greatest(0.1, s) * pl + 0.35::DOUBLE * coalesce(i.up, 0) * dw) * cf)) AS s, dw, pl, cf FROM {source} q LEFT JOIN {name}_in i ON i.v = q.u",
    }


WU, WV = 1.5, 2.0
WS, WD = math.hypot(WU, WV), math.degrees(math.atan2(WV, WU)) % 360
SPREAD = SIMPLE | {
    "st": f"SELECT u, v, seed AS s, CASE WHEN d <= 75 THEN exp(-(d * d) / 2450) ELSE 0 END AS dw, 1 / (2 * pi() * ew * sy * sz) * exp(-pow(sin(radians(d)) * length, 2) / (2 * sy * sy)) * exp(-4 / (2 * sz * sz)) AS pl, 1 + 0.6::DOUBLE * bd + 0.15::DOUBLE * greatest(0, 1 - least(1, ew / 3)) AS cf FROM (SELECT *, {ANGLE.format(a='bearing', b=f'{WD!r}::DOUBLE')} AS d, greatest(2, 0.2::DOUBLE * greatest(1, length)) AS sy, greatest(1, 0.06::DOUBLE * greatest(1, length)) AS sz, greatest(0.2, {WS!r}::DOUBLE * (1 - 0.55::DOUBLE * bd)) AS ew FROM se)",
} | _step("st", "q1") | _step("q1", "q2")


@query("g1_wind_propagation", "road_nodes road_edges", "SELECT u, v, round(s + 1e-7, 4) AS s FROM q2", SPREAD)
def _(t):
    e = simple(t)
    sp, di = physics.wind_state(F.lit(WU), F.lit(WV))
    wind = t.spark.range(1).select(sp.alias("wind_speed"), di.alias("wind_dir"))
    out = D.propagate(e.select("u", "v", F.col("seed").alias("s")), e, wind, 2)
    return out.select("u", "v", F.round(F.col("s") + 1e-7, 4).alias("s"))


def _step_by(source: str, name: str) -> dict[str, str]:
    return {
        f"{name}_in": f"SELECT snapshot_id, v, avg(s) / greatest(1, any_value(d)) * count(*) / count(*) AS up FROM {source} JOIN (SELECT v, count(*) AS d FROM se GROUP BY v) USING (v) GROUP BY snapshot_id, v",
        name: f"SELECT q.snapshot_id, q.u, q.v, greatest(0, least(500, 0.4::DOUBLE * s + 0.6::DOUBLE * (s + dw * greatest(0.1, s) * pl + 0.35::DOUBLE * coalesce(i.up, 0) * dw) * cf)) AS s, dw, pl, cf FROM {source} q LEFT JOIN {name}_in i ON i.snapshot_id = q.snapshot_id AND i.v = q.u",
    }


SPREAD_BY = FUSED | {
    "st": f"SELECT snapshot_id, u, v, 1.0::DOUBLE AS s, CASE WHEN d <= 75 THEN exp(-(d * d) / 2450) ELSE 0 END AS dw, 1 / (2 * pi() * ew * sy * sz) * exp(-pow(sin(radians(d)) * length, 2) / (2 * sy * sy)) * exp(-4 / (2 * sz * sz)) AS pl, 1 + 0.6::DOUBLE * bd + 0.15::DOUBLE * greatest(0, 1 - least(1, ew / 3)) AS cf FROM (SELECT *, {ANGLE.format(a='bearing', b='wd')} AS d, greatest(2, 0.2::DOUBLE * greatest(1, length)) AS sy, greatest(1, 0.06::DOUBLE * greatest(1, length)) AS sz, greatest(0.2, greatest(0.2, ws) * (1 - 0.55::DOUBLE * bd)) AS ew FROM se, sn)",
} | _step_by("st", "q1") | _step_by("q1", "q2")


@query("c10_training_rows", "road_nodes road_edges weather_hourly air_hourly", "SELECT snapshot_id, u, v, " + ", ".join(f"round(f.{c} + 1e-7, 4) AS {c}" for c in ("no2", "so2", "pm2_5", "toxicity")) + ", round(s + 1e-7, 4) AS target FROM fused f JOIN q2 USING (snapshot_id, u, v)", SPREAD_BY)
def _(t):
    mx, my = GR.midpoint()
    e = simple(t).select("u", "v", "length", "bearing_deg", "building_density", mx.alias("x"), my.alias("y"))
    rows = D.at_points(D.spread_over(e, D.snapshot_points(snapshots(t)), F.lit(1.0), 2)).withColumnRenamed("s", "target")
    return rows.select("snapshot_id", "u", "v", *[F.round(F.coalesce(F.col(c), F.lit(0.0)) + 1e-7, 4).alias(c) for c in (*D.FUSED, "target")])


@query("a21_incoming_mean", "road_nodes road_edges", "SELECT v AS u, round(avg(seed) / count(*), 6) AS upstream FROM se GROUP BY v", SIMPLE)
def _(t):
    e = simple(t)
    return D.incoming_mean(e.select("v", F.col("seed").alias("s")), e.groupBy("v").agg(F.count("*").alias("in_degree")), []).select("u", *r6("upstream"))


@query("a23_cell_means", "road_nodes road_edges", "SELECT CAST(floor((x1 + x2) / 2 / 5000) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2 / 5000) AS BIGINT) AS cy, round(avg(length), 6) AS mean, count(*) AS n, round(min(avg(length)) OVER (), 6) AS low, round(max(avg(length)) OVER (), 6) AS high FROM ee GROUP BY 1, 2", ENDS)
def _(t):
    mx, my = GR.midpoint()
    e = edges(t).withColumns({"mx": mx, "my": my})
    return D.cell_means(e, "mx", "my", "length", 5000.0).select("cx", "cy", *r6("mean"), "n", *r6("low", "high"))


@query("g6_plume_listing", "road_nodes road_edges weather_hourly air_hourly", "SELECT u, v, round(max(toxicity), 4) AS toxicity, true AS placed FROM fused GROUP BY u, v", FUSED)
def _(t):
    lat, lon = geo.from_utm(F.col("x"), F.col("y"))
    return fused(t).withColumn("ok", lat.between(12.5, 13.5) & lon.between(77.0, 78.5)).groupBy("u", "v").agg(F.round(F.max("toxicity"), 4).alias("toxicity"), F.bool_and("ok").alias("placed"))


SLOPE = "CASE WHEN lag(concentration) OVER w IS NOT NULL AND lead(concentration) OVER w IS NOT NULL THEN (lead(concentration) OVER w - lag(concentration) OVER w) / 2 WHEN lead(concentration) OVER w IS NOT NULL THEN lead(concentration) OVER w - concentration WHEN lag(concentration) OVER w IS NOT NULL THEN concentration - lag(concentration) OVER w ELSE 0 END / 100"


@query("w19_advection", "grid", "SELECT grid_id, r, c, round(greatest(0, concentration - 300 * (wind_u * dx + wind_v * dy)), 6) AS concentration FROM (SELECT *, " + SLOPE.replace("OVER w", "OVER a") + " AS dx, " + SLOPE.replace("OVER w", "OVER b") + " AS dy FROM grid WINDOW a AS (PARTITION BY grid_id, r ORDER BY c), b AS (PARTITION BY grid_id, c ORDER BY r))")
def _(t):
    return D.advect(t.grid()).select("grid_id", "r", "c", *r6("concentration"))
