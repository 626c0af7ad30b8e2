"""Windows by blocks of time, with carried ends, equal the windows of whole series."""

import random

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import series


def frame(spark):
    rng, rows = random.Random(2), []
    for key in ("a", "b", None, "empty", "one"):
        t = 0
        for i in range({"empty": 30, "one": 1}.get(key, 120)):
            t += rng.choice([1, 1, 1, 2, 40])
            known = key != "empty" and rng.random() < (0.05 if key == "b" else 0.4)
            rows.append((key, t, float(rng.randint(0, 99)) if known else None))
    return spark.createDataFrame(rows, "k string, h int, v double").select("k", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)").alias("t"), "v")


def rows(df):
    return sorted(((r.k or "", r.t, None if r.o is None else round(r.o, 9)) for r in df.select("k", "t", "o").collect()), key=str)


@pytest.mark.parametrize(("limit", "by_time"), [(None, True), (None, False), (3, True)])
@pytest.mark.parametrize("hours", [5, 1000])
def test_interpolation(spark, limit, by_time, hours):
    d = frame(spark)
    assert rows(series.interpolate_blocks(d, ["k"], "t", "v", "o", limit=limit, by_time=by_time, block=hours * 3600.0)) == rows(series.interpolate(d, ["k"], "t", "v", "o", limit=limit, by_time=by_time))


def test_gaps(spark):
    d = frame(spark)
    assert rows(series.gap_lengths_blocks(d, ["k"], "t", "v", "o", block=7 * 3600.0)) == rows(series.gap_lengths(d, ["k"], "t", "v", "o"))


def test_one_long_series_fills_many_tasks(spark):
    """A series of a million hours; the same columns as the input come out."""
    d = spark.range(1_000_000).select(F.lit("a").alias("k"), F.expr("timestamp_ntz'1900-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT))").alias("t"), F.when(F.xxhash64("id") % 50 == 0, (F.col("id") % 97).cast("double")).alias("v"))
    made = series.interpolate_blocks(d, ["k"], "t", "v", "o", limit=None)
    assert made.columns == ["k", "t", "v", "o"]
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 1_000_000 and len(sizes) > 1 and max(r["count"] for r in sizes) < 600_000
    plain = series.interpolate(d.where("t < '1920-01-01'"), ["k"], "t", "v", "o", limit=None)
    both = made.where("t < '1919-12-01'").join(plain.select("t", F.col("o").alias("w")), "t")
    assert both.where("NOT (o <=> w OR abs(o - w) < 1e-9)").count() == 0 and both.count() > 100_000
