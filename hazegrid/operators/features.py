"""Windowed training sets, time indexes, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.timeutil import seconds


def sliding_windows(df: DataFrame, node: str, time: str, features: list[str], target: str, width: int, stride: int = 1, contiguous: bool = False) -> DataFrame:
    """(node, start, label_time, x, y): `width` consecutive rows of a node and the next row's target; with contiguous, only where the hours are whole.

    A node of T rows gives T - width windows before the stride.
    """
    w = Window.partitionBy(node).orderBy(time)
    ahead = w.rowsBetween(0, width - 1)
    d = df.select(node, time, F.col(time).alias("start"), F.lead(target, width).over(w).alias("y"), F.lead(time, width).over(w).alias("label_time"), F.collect_list(F.struct(*features)).over(ahead).alias("x"), (F.row_number().over(w) - 1).alias("_i"))
    d = d.where(F.col("label_time").isNotNull() & F.col("y").isNotNull() & (F.size("x") == width))
    if stride > 1:
        d = d.where(F.col("_i") % stride == 0)
    if contiguous:
        d = d.where(seconds(F.col("label_time")) - seconds(F.col("start")) == 3600 * width)
    return d.select(node, "start", "label_time", "x", "y")


def time_index(df: DataFrame, time: str) -> DataFrame:
    """(time, t): distinct times numbered from 0; only the distinct times are ranked."""
    return df.select(time).distinct().withColumn("t", (F.dense_rank().over(Window.orderBy(time)) - 1).cast("int"))


def split_by_share(df: DataFrame, time: str, share: float = 0.8) -> DataFrame:
    """df with t and split: train for the first share of the distinct times, else test."""
    idx = time_index(df, time)
    n = idx.agg(F.count("*").alias("_n"))
    return df.join(idx, time).crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("t") < F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_n")


def split_blocks(df: DataFrame, time: str, block: int = 14 * 24, width: int = 0) -> DataFrame:
    """df with t and split: test is the last block of times, validation the one before, train the rest; `reaches` marks rows that may feed the next block's windows."""
    idx = time_index(df, time)
    n = idx.agg(F.count("*").alias("_n"))
    d = df.join(idx, time).crossJoin(F.broadcast(n))
    test, val = F.col("_n") - block, F.col("_n") - 2 * block
    return d.withColumn("split", F.when(F.col("t") >= test, "test").when(F.col("t") >= val, "val").otherwise("train")).withColumn("reaches", ((F.col("t") >= test - width) & (F.col("t") < test)) | ((F.col("t") >= val - width) & (F.col("t") < val))).drop("_n")


def blocked_folds(df: DataFrame, time: str, folds: int = 3, block: int = 14 * 24, least_train: int = 45 * 24) -> DataFrame:
    """(fold, train_end, test_start, test_end) in time indexes: test blocks from the end back, each with enough before it."""
    n = time_index(df, time).agg(F.count("*").alias("n"))
    f = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    start = F.col("n") - F.col("fold") * block
    return f.select("fold", start.alias("train_end"), start.alias("test_start"), (start + block).alias("test_end")).where(F.col("train_end") >= least_train)


def assign_folds(df: DataFrame, time: str, plan: DataFrame) -> DataFrame:
    """df with fold and part (train or test) for each fold that uses the row; the plan has a few rows."""
    d = df.join(time_index(df, time), time)
    return d.join(F.broadcast(plan), F.col("t") < F.col("test_end")).withColumn("part", F.when(F.col("t") < F.col("train_end"), "train").otherwise("test")).drop("train_end", "test_start", "test_end")


def cap_per_cluster(windows: DataFrame, cluster: str, n: int, order) -> DataFrame:
    """At most n windows of each cluster in a fixed pseudo-random order."""
    return windows.withColumn("_rn", F.row_number().over(Window.partitionBy(cluster).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")
