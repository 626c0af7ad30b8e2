"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import physics


def masked_errors(p: DataFrame, mask: Column) -> DataFrame:
    """MSE, MAE and RMSE over the rows of a mask."""
    e = F.col("pred") - F.col("target")
    return p.where(mask).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def weighted_mse(p: DataFrame) -> DataFrame:
    """MSE weighted by confidence, which is kept within 0.05 and 1."""
    w = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("weight")))
    return p.agg((F.sum(w * F.pow(F.col("pred") - F.col("target"), 2)) / (F.sum(w) + 1e-8)).alias("weighted_mse"))


def upwind_penalty(p: DataFrame, edges: DataFrame, wind_speed: float = 2.0, margin: float = 0.0) -> DataFrame:
    """Mean squared excess of the upwind node's prediction over its pair's, over all (t, upwind edge), weighted by 1 + plume / largest plume.

    p (t, node, pred); edges (u, v, length) that run upwind.
    """
    d = F.greatest(F.lit(1.0), F.col("length"))
    sy, sz = physics.sigmas(d)
    e = edges.withColumn("_plume", physics.plume(F.lit(1.0), F.lit(0.0), F.lit(max(0.2, wind_speed)), sy, sz))
    top = e.agg(F.greatest(F.max("_plume"), F.lit(1e-8)).alias("_top"))
    e = e.crossJoin(F.broadcast(top)).select("u", "v", (1 + F.col("_plume") / F.col("_top")).alias("_w"))
    a, b = p.select("t", F.col("node").alias("u"), F.col("pred").alias("pu")), p.select("t", F.col("node").alias("v"), F.col("pred").alias("pv"))
    j = a.join(e, "u").join(b, ["t", "v"])
    return j.agg(F.coalesce(F.avg(F.pow(F.greatest(F.lit(0.0), F.col("pv") - F.col("pu") - margin), 2) * F.col("_w")), F.lit(0.0)).alias("penalty"))


def fold_stability(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample standard deviation and worst of each metric over folds."""
    return scores.agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.max(m).alias(f"{m}_worst"))])


def circular_mean(direction: str) -> Column:
    """Mean of directions in degrees, within [0, 360)."""
    r = F.radians(direction)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))
