"""Exact medians from bounds and counted values against Spark's own, which brings a column into one task."""

import random

from pyspark.sql import functions as F

from hazegrid.operators import master


def test_exact_medians(spark):
    r = random.Random(3)
    for n in (1, 2, 3, 4, 101, 5000):
        rows = [(r.gauss(0, 1), float(r.randrange(3)), r.choice([None, 1.0, 7.5]), None, r.choice([float("inf"), 2.0, float("nan"), -3.0])) for _ in range(n)]
        d = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3).localCheckpoint()
        want = d.agg(*[F.median(c).alias(c) for c in d.columns]).first()
        assert str(master.exact_medians(d, d.columns).first()) == str(want), n


def test_no_task_reads_a_column(spark):
    """What is brought together is a hundredth of the values."""
    d = spark.range(200_000, numPartitions=4).select(F.rand(1).alias("city_a"), F.rand(2).alias("city_b")).localCheckpoint()
    plan = master.medians(d)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    assert tuple(master.medians(d).first()) == tuple(d.agg(F.median("city_a"), F.median("city_b")).first())
