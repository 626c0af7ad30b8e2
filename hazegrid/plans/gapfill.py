"""Queries of the gap-fill cascade and its back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.operators import gapfill as G
from hazegrid.operators import series
from hazegrid.plans.registry import query, r6
from hazegrid.sources.adapters import POLLUTANTS, Tables

#: p90 errors that stand for a stored policy.
P90 = {"pm10": 13.7294, "pm25": 8.4725, "no2": 2.4, "so2": 2.0339, "co": 0.2051}


def policy(t: Tables):
    return t.spark.createDataFrame(list(P90.items()), "parameter string, p90 double")


CELLS = {
    "obs": "SELECT parameter, station_id, time, avg(value) AS value FROM hourly GROUP BY ALL",
    "spine": "SELECT t.parameter, s.station_id, t.time, o.value FROM (SELECT DISTINCT parameter, time FROM obs) t JOIN (SELECT DISTINCT parameter, station_id FROM obs) s USING (parameter) LEFT JOIN obs o ON o.parameter = t.parameter AND o.station_id = s.station_id AND o.time = t.time",
    "num": "SELECT *, row_number() OVER w AS rn, epoch(time) AS x FROM spine WINDOW w AS (PARTITION BY parameter, station_id ORDER BY time)",
    "ends": "SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {'x': x, 'v': value, 'rn': rn} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(CASE WHEN value IS NOT NULL THEN {'x': x, 'v': value, 'rn': rn} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM num WINDOW w AS (PARTITION BY parameter, station_id ORDER BY time)",
    "lin": "SELECT parameter, station_id, time, value, CASE WHEN value IS NOT NULL THEN value WHEN NOT (coalesce(rn - p.rn <= 24, false) OR coalesce(n.rn - rn <= 24, false)) THEN NULL WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (x - p.x) / (n.x - p.x) ELSE coalesce(p.v, n.v) END AS lin FROM ends",
}
CASCADE = CELLS | {
    "pol": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in P90.items()) + ") AS t(parameter, p90)",
    "hd": "SELECT parameter, station_id, hour(time) AS h, isodow(time) AS d, median(lin) AS m FROM lin GROUP BY ALL",
    "hh": "SELECT parameter, station_id, hour(time) AS h, median(lin) AS m FROM lin GROUP BY ALL",
    "al": "SELECT parameter, station_id, median(lin) AS m, median(value) AS med FROM lin GROUP BY ALL",
    "isl": "SELECT *, sum(CASE WHEN value IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY parameter, station_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS isl FROM lin",
    "gap": "SELECT *, CASE WHEN value IS NULL THEN count(*) FILTER (value IS NULL) OVER (PARTITION BY parameter, station_id, isl) ELSE 0 END AS gap_hours FROM isl",
    "der": "SELECT g.time, g.station_id, g.parameter, g.value AS observed_value, g.gap_hours, coalesce(g.value, g.lin, hd.m, hh.m, al.m, al.med) AS value, CASE WHEN g.value IS NOT NULL THEN 'observed' WHEN g.lin IS NOT NULL THEN 'temporal_linear' WHEN coalesce(hd.m, hh.m, al.m) IS NOT NULL THEN 'temporal_climatology' WHEN al.med IS NOT NULL THEN 'station_median' END AS impute_method, p90 FROM gap g JOIN pol USING (parameter) LEFT JOIN hd ON hd.parameter = g.parameter AND hd.station_id = g.station_id AND hd.h = hour(g.time) AND hd.d = isodow(g.time) LEFT JOIN hh ON hh.parameter = g.parameter AND hh.station_id = g.station_id AND hh.h = hour(g.time) LEFT JOIN al ON al.parameter = g.parameter AND al.station_id = g.station_id",
}
TIER = "CASE impute_method WHEN 'observed' THEN 'A' WHEN 'temporal_linear' THEN 'B' WHEN 'spatial_idw' THEN 'B' ELSE 'C' END"


@query("a1_hourly_mean", "hourly", "SELECT parameter, station_id, station_name, time, round(value, 6) AS value FROM hourly")
def _(t):
    return G.hourly_mean(t.readings()).select("parameter", "station_id", "station_name", "time", *r6("value"))


def dense(t: Tables):
    """Every series at every time of its pollutant, with the known values on either side."""
    o = G.per_station(G.hourly_mean(t.readings()))
    return G.cells(G.timed(G.series_of(o), G.times_of(o)))


@query("j15_observed_spine", "hourly", "SELECT parameter, count(*) AS cells, count(value) AS observed, count(DISTINCT station_id) AS stations, count(DISTINCT time) AS times FROM spine GROUP BY 1", CELLS)
def _(t):
    s = G.spine(G.per_station(G.hourly_mean(t.readings())))
    return s.groupBy("parameter").agg(F.count("*").alias("cells"), F.count("value").alias("observed"), F.countDistinct("station_id").alias("stations"), F.countDistinct("time").alias("times"))


@query("w1_time_interpolation", "hourly", "SELECT parameter, station_id, time, round(lin, 6) AS lin FROM lin WHERE lin IS NOT NULL", CELLS)
def _(t):
    s = series.between(dense(t), "time", "value", "lin", limit=24)
    return s.where("lin is not null").select("parameter", "station_id", "time", *r6("lin"))


@query("w2_leave_one_out", "hourly", "SELECT parameter, station_id, time, round(CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (x - p.x) / (n.x - p.x) ELSE coalesce(p.v, n.v) END, 6) AS lin FROM (SELECT *, last_value({'x': x, 'v': value}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value({'x': x, 'v': value}) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM (SELECT *, epoch(time) AS x FROM obs) WINDOW w AS (PARTITION BY parameter, station_id ORDER BY time))", CELLS)
def _(t):
    s = series.leave_one_out(G.per_station(G.hourly_mean(t.readings())), G.SERIES, "time", "value", "lin")
    return s.select("parameter", "station_id", "time", *r6("lin"))


@query("w3_positional_interpolation", "hourly", "SELECT parameter, station_id, time, round(CASE WHEN value IS NOT NULL THEN value WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (rn - p.rn) / (n.rn - p.rn) ELSE coalesce(p.v, n.v) END, 6) AS v FROM ends", CELLS)
def _(t):
    s = series.between(dense(t), "time", "value", "v", limit=None, by_time=False)
    return s.select("parameter", "station_id", "time", *r6("v"))


@query("w4_fill_both_ways", "hourly", "SELECT parameter, station_id, time, round(coalesce(p.v, n.v), 6) AS value FROM ends", CELLS)
def _(t):
    s = dense(t).withColumn("value", F.coalesce("_p.v", "_n.v", F.lit(0.0)))
    return s.select("parameter", "station_id", "time", *r6("value"))


@query("w5_gap_lengths", "hourly", "SELECT parameter, station_id, gap_hours, count(*) AS rows FROM gap GROUP BY ALL", CASCADE)
def _(t):
    s = series.gap_between(dense(t), "value")
    return s.groupBy("parameter", "station_id", F.col("gap_hours").cast("long").alias("gap_hours")).agg(F.count("*").alias("rows"))


@query("w1_block_interpolation", "hourly", "SELECT parameter, station_id, time, round(lin, 6) AS lin FROM lin WHERE lin IS NOT NULL", CELLS)
def _(t):
    """Series cut into blocks of five days, as very long ones are."""
    s = series.between(G.cells_blocks(G.per_station(G.hourly_mean(t.readings())), 5 * 86400.0), "time", "value", "lin", limit=24)
    return s.where("lin is not null").select("parameter", "station_id", "time", *r6("lin"))


@query("w5_block_gaps", "hourly", "SELECT parameter, station_id, time, CAST(gap_hours AS INTEGER) AS gap_hours FROM gap", CASCADE)
def _(t):
    s = series.gap_between(G.cells_blocks(G.per_station(G.hourly_mean(t.readings())), 5 * 86400.0), "value")
    return s.select("parameter", "station_id", "time", "gap_hours")


@query("a5_climatology", "hourly", "SELECT parameter, station_id, time, round(coalesce(hd.m, hh.m, al.m), 6) AS clim FROM lin l LEFT JOIN hd ON hd.parameter = l.parameter AND hd.station_id = l.station_id AND hd.h = hour(l.time) AND hd.d = isodow(l.time) LEFT JOIN hh ON hh.parameter = l.parameter AND hh.station_id = l.station_id AND hh.h = hour(l.time) LEFT JOIN al ON al.parameter = l.parameter AND al.station_id = l.station_id".replace("SELECT parameter, station_id, time", "SELECT l.parameter, l.station_id, l.time"), CASCADE)
def _(t):
    o = G.per_station(G.hourly_mean(t.readings()))
    s = G.cells(G.climate(G.timed(G.series_of(o), G.times_of(o)), 24))
    return s.withColumn("clim", F.get("_clim", G.slot(F.col("time")))).select("parameter", "station_id", "time", *r6("clim"))


@query("a6_station_median", "hourly", "SELECT parameter, station_id, round(median(value), 6) AS med FROM obs GROUP BY ALL", CELLS)
def _(t):
    o = G.per_station(G.hourly_mean(t.readings()))
    return o.groupBy("parameter", "station_id").agg(F.round(F.median("value") + 1e-9, 6).alias("med"))


@query("c1_gapfill_cascade", "hourly", f"SELECT time, station_id, parameter, round(value, 6) AS value, round(observed_value, 6) AS observed_value, impute_method, CASE impute_method WHEN 'observed' THEN 1.0 WHEN 'temporal_linear' THEN 0.85 WHEN 'temporal_climatology' THEN 0.55 ELSE 0.35 END::DOUBLE AS impute_confidence, round(p90 * CASE impute_method WHEN 'observed' THEN 0 WHEN 'temporal_linear' THEN 1.0 WHEN 'temporal_climatology' THEN 1.35 ELSE 1.6 END::DOUBLE, 6) AS impute_uncertainty_abs, 1 AS impute_source_count, {TIER} AS impute_tier, gap_hours, impute_method <> 'observed' AS is_imputed, 'run' AS impute_run_id, 'station_' || station_id AS station_name FROM der", CASCADE)
def _(t):
    d = G.cascade(G.hourly_mean(t.readings()), t.station_meta(), policy(t))
    return d.select("time", "station_id", "parameter", *r6("value", "observed_value"), "impute_method", "impute_confidence", *r6("impute_uncertainty_abs"), "impute_source_count", "impute_tier", F.col("gap_hours").cast("long").alias("gap_hours"), "is_imputed", "impute_run_id", "station_name")


@query("c1_imputation_summary", "hourly", f"SELECT parameter, impute_method, {TIER} AS impute_tier, impute_method <> 'observed' AS is_imputed, count(*) AS rows FROM der GROUP BY ALL", CASCADE)
def _(t):
    return G.summary(G.cascade(G.hourly_mean(t.readings()), t.station_meta(), policy(t), values=False))


@query("c1_unresolved", "hourly", "SELECT parameter, count(*) AS rows FROM der WHERE value IS NULL GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM der", CASCADE)
def _(t):
    d = G.cascade(G.hourly_mean(t.readings()), t.station_meta(), policy(t), values=False)
    return G.unresolved(d).groupBy("parameter").agg(F.count("*").alias("rows")).unionAll(d.agg(F.lit("total").alias("parameter"), F.count("*").alias("rows")))


IDW_TABLES = CELLS | {
    "pd": "SELECT a.id AS a, b.id AS b, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d FROM station_meta a JOIN station_meta b ON a.id <> b.id",
    "idw": "SELECT t.parameter, t.station_id, t.time, sum(o.value / (d * d + 1)) / sum(1 / (d * d + 1)) AS idw, count(*) AS neighbours FROM obs t JOIN obs o ON o.parameter = t.parameter AND o.time = t.time AND o.station_id <> t.station_id JOIN pd ON a = t.station_id AND b = o.station_id GROUP BY ALL",
}


@query("j7_spatial_idw", "hourly station_meta", "SELECT parameter, station_id, time, round(idw, 6) AS idw, CAST(neighbours AS INTEGER) AS neighbours FROM idw", IDW_TABLES)
def _(t):
    o = G.per_station(G.hourly_mean(t.readings()))
    return G.idw_all(o, o, t.station_meta(), 1).select("parameter", "station_id", "time", *r6("idw"), "neighbours")


#: The cascade with a limit of 3 rows, and with stations that at least two others surround where that leaves a hole.
WITH_IDW = IDW_TABLES | {
    "lin3": CELLS["lin"].replace("<= 24", "<= 3"),
    "hole": "SELECT l.parameter, l.station_id, l.time, sum(o.value / (d * d + 1)) / sum(1 / (d * d + 1)) AS idw FROM lin3 l JOIN obs o ON o.parameter = l.parameter AND o.time = l.time AND o.station_id <> l.station_id JOIN pd ON a = l.station_id AND b = o.station_id WHERE l.lin IS NULL AND o.value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "far": "SELECT lin3.*, idw, coalesce(lin, idw) AS so_far FROM lin3 LEFT JOIN hole USING (parameter, station_id, time)",
    "cl": "SELECT parameter, station_id, count(so_far) AS any_so_far, count(value) AS any_value FROM far GROUP BY ALL",
    "mt": "SELECT far.parameter, CASE WHEN value IS NOT NULL THEN 'observed' WHEN lin IS NOT NULL THEN 'temporal_linear' WHEN idw IS NOT NULL THEN 'spatial_idw' WHEN any_so_far > 0 THEN 'temporal_climatology' WHEN any_value > 0 THEN 'station_median' END AS impute_method, value IS NULL AS is_imputed FROM far JOIN cl USING (parameter, station_id)",
}


@query("c1_cascade_with_idw", "hourly station_meta", f"SELECT parameter, impute_method, {TIER} AS impute_tier, is_imputed, count(*) AS rows FROM mt GROUP BY ALL", WITH_IDW)
def _(t):
    return G.summary(G.cascade(G.hourly_mean(t.readings()), t.station_meta(), policy(t), use_idw=True, limit=3, values=False))


WITH_IDW_VALUES = WITH_IDW | {
    "hole": WITH_IDW["hole"].replace(" AS idw FROM", " AS idw, count(*) AS n FROM"),
    "pol": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {v}::DOUBLE)" for p, v in P90.items()) + ") AS q(parameter, p90)",
}


@query("c1_idw_values", "hourly station_meta", "SELECT parameter, station_id, time, round(idw, 6) AS value, n AS sources, round(p90 * 1.15::DOUBLE, 6) AS uncertainty FROM far JOIN (SELECT parameter, station_id, time, n FROM hole) USING (parameter, station_id, time) JOIN pol USING (parameter) WHERE value IS NULL AND lin IS NULL", WITH_IDW_VALUES)
def _(t):
    """Cells that neighbours fill: values, source counts and uncertainty."""
    d = G.spatial_fills(G.hourly_mean(t.readings()), t.station_meta(), policy(t), limit=3)
    return d.select("parameter", "station_id", "time", *r6("value"), F.col("impute_source_count").alias("sources"), F.round(F.col("impute_uncertainty_abs") + 1e-9, 6).alias("uncertainty"))


REACH = 6000.0


@query("j7_idw_within_reach", "hourly station_meta", f"SELECT parameter, station_id, time, round(idw, 6) AS idw, CAST(n AS INTEGER) AS neighbours, round((m - n) / {REACH * REACH + 1!r}::DOUBLE / (w + (m - n) / {REACH * REACH + 1!r}::DOUBLE), 6) AS dropped_share FROM nw JOIN (SELECT parameter, time, count(*) AS m FROM obs GROUP BY ALL) USING (parameter, time)", IDW_TABLES | {
    "nw": f"SELECT t.parameter, t.station_id, t.time, sum(o.value / (d * d + 1)) / sum(1 / (d * d + 1)) AS idw, sum(1 / (d * d + 1)) AS w, count(*) AS n FROM obs t JOIN obs o ON o.parameter = t.parameter AND o.time = t.time AND o.station_id <> t.station_id JOIN pd ON a = t.station_id AND b = o.station_id WHERE d <= {REACH!r} GROUP BY ALL",
})
def _(t):
    o = G.per_station(G.hourly_mean(t.readings()))
    return G.idw_within(o, o, t.station_meta(), REACH, 1).select("parameter", "station_id", "time", *r6("idw"), "neighbours", *r6("dropped_share"))


@query("a9_totals", "hourly station_meta", f"SELECT parameter, impute_method, count(*) AS rows, count(*) FILTER (is_imputed) AS imputed, CAST(grouping(parameter, impute_method) AS BIGINT) AS level FROM mt GROUP BY ROLLUP (parameter, impute_method)", WITH_IDW)
def _(t):
    """Rows by pollutant and method with both totals."""
    d = G.cascade(G.hourly_mean(t.readings()), t.station_meta(), policy(t), use_idw=True, limit=3, values=False)
    return G.totals(d, ["parameter", "impute_method"]).select("parameter", "impute_method", "rows", "imputed", F.col("level").cast("long"))


ORDER = "(station_id * 7919 + hour(time) * 104729 + day(time) * 1299709) % 1000003"
BACKTEST = IDW_TABLES | {
    "smp": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY {ORDER}, station_id, time) AS rn FROM obs) WHERE rn <= 400",
    "loo": "SELECT parameter, station_id, time, value, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (x - p.x) / (n.x - p.x) ELSE coalesce(p.v, n.v) END AS lin FROM (SELECT *, last_value({'x': x, 'v': value}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value({'x': x, 'v': value}) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM (SELECT *, epoch(time) AS x FROM obs) WINDOW w AS (PARTITION BY parameter, station_id ORDER BY time))",
    "chd": "SELECT parameter, station_id, hour(time) AS h, isodow(time) AS d, median(value) AS clim FROM obs GROUP BY ALL",
    "med": "SELECT parameter, station_id, median(value) AS med FROM obs GROUP BY ALL",
    "pt": "SELECT s.parameter AS pollutant, s.value AS truth, l.lin, i.idw, c.clim, m.med, CASE WHEN lin IS NOT NULL AND idw IS NOT NULL THEN 0.6::DOUBLE * lin + 0.4::DOUBLE * idw ELSE coalesce(lin, idw) END AS hyb FROM smp s LEFT JOIN loo l USING (parameter, station_id, time) LEFT JOIN idw i USING (parameter, station_id, time) LEFT JOIN chd c ON c.parameter = s.parameter AND c.station_id = s.station_id AND c.h = hour(s.time) AND c.d = isodow(s.time) LEFT JOIN med m ON m.parameter = s.parameter AND m.station_id = s.station_id",
    "pred": "SELECT pollutant, truth, 'temporal_linear' AS method, lin AS pred FROM pt UNION ALL SELECT pollutant, truth, 'spatial_idw', idw FROM pt UNION ALL SELECT pollutant, truth, 'temporal_climatology', clim FROM pt UNION ALL SELECT pollutant, truth, 'station_median', med FROM pt UNION ALL SELECT pollutant, truth, 'hybrid_linear_idw', hyb FROM pt",
    "sc": "SELECT pollutant, method, count(*) AS sample_count, count(pred) AS predicted_count, count(pred) / count(*) AS coverage, avg(abs(pred - truth)) AS mae, sqrt(avg(pow(pred - truth, 2))) AS rmse, 100 * avg(abs(pred - truth) / greatest(abs(truth), 1e-6::DOUBLE)) AS mape_pct, 100 * avg(2 * abs(pred - truth) / greatest(abs(truth) + abs(pred), 1e-6::DOUBLE)) AS smape_pct, avg(abs(pred - truth)) / greatest(median(abs(truth)), 1e-6::DOUBLE) AS normalized_mae, quantile_cont(abs(pred - truth), 0.9) AS p90_abs_error FROM pred GROUP BY ALL",
    "cs": "SELECT *, normalized_mae + 0.6::DOUBLE * smape_pct / 100 + 0.25::DOUBLE * (1 - coverage) AS composite FROM sc WHERE mae IS NOT NULL",
    "rk": "SELECT *, row_number() OVER (PARTITION BY pollutant ORDER BY composite, rmse, method) AS rn FROM cs",
}


def predictions(t: Tables):
    o = G.per_station(G.hourly_mean(t.readings()))
    order = (F.col("station_id") * 7919 + F.hour("time") * 104729 + F.dayofmonth("time") * 1299709) % 1000003
    return G.backtest(o, G.sample_points(o, 400, order), t.station_meta())


@query("w16_sample_points", "hourly", "SELECT parameter, station_id, time, round(value, 6) AS value FROM smp", CELLS | {"smp": BACKTEST["smp"]})
def _(t):
    o = G.per_station(G.hourly_mean(t.readings()))
    order = (F.col("station_id") * 7919 + F.hour("time") * 104729 + F.dayofmonth("time") * 1299709) % 1000003
    return G.sample_points(o, 400, order).select("parameter", "station_id", "time", *r6("value"))


@query("c2_method_scores", "hourly station_meta", "SELECT pollutant, method, sample_count, predicted_count, round(coverage, 6) AS coverage, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape_pct, 3) AS mape_pct, round(smape_pct, 5) AS smape_pct, round(normalized_mae, 6) AS normalized_mae, round(p90_abs_error, 6) AS p90_abs_error FROM sc", BACKTEST)
def _(t):
    s = G.scores(predictions(t))
    return s.select("pollutant", "method", "sample_count", "predicted_count", *r6("coverage", "mae", "rmse"), F.round("mape_pct", 3).alias("mape_pct"), F.round("smape_pct", 5).alias("smape_pct"), *r6("normalized_mae", "p90_abs_error"))


@query("w10_policy", "hourly station_meta", "SELECT b.pollutant, b.method AS primary_method, round(b.p90_abs_error, 6) AS primary_p90_abs_error, round(b.smape_pct, 5) AS primary_smape_pct, f.method AS fallback_method FROM rk b LEFT JOIN rk f ON f.pollutant = b.pollutant AND f.rn = 2 WHERE b.rn = 1", BACKTEST)
def _(t):
    p = G.policy(G.scores(predictions(t)))
    return p.select("pollutant", "primary_method", *r6("primary_p90_abs_error"), F.round("primary_smape_pct", 5).alias("primary_smape_pct"), "fallback_method")


@query("a8_method_ranking", "hourly station_meta", "SELECT method, round(avg(composite), 5) AS avg_composite, round(avg(coverage), 6) AS avg_coverage, round(avg(normalized_mae), 6) AS avg_nmae, round(avg(smape_pct), 5) AS avg_smape, count(DISTINCT pollutant) AS pollutants FROM cs GROUP BY 1", BACKTEST)
def _(t):
    r = G.ranking(G.scores(predictions(t)))
    return r.select("method", F.round("avg_composite", 5).alias("avg_composite"), *r6("avg_coverage", "avg_nmae"), F.round("avg_smape", 5).alias("avg_smape"), "pollutants")


@query("t1_score_report", "hourly station_meta", "SELECT row_number() OVER (ORDER BY pollutant, normalized_mae, smape_pct, coverage DESC, method) AS place, pollutant, method FROM sc", BACKTEST)
def _(t):
    """The report's order; a row a pollutant and method."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("pollutant", "normalized_mae", "smape_pct", F.desc("coverage"), "method"))
    return G.scores(predictions(t)).select(place.alias("place"), "pollutant", "method")
