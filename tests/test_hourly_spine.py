"""The hourly spine against windows over the dense rows."""

import datetime
import random

from pyspark.sql import functions as F

from hazegrid.operators import master, series


def test_spine_equals_windows_over_all_hours(spark):
    r, day = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(hours=h, minutes=r.randrange(60)), r.choice([None, r.random()]), r.choice([None, r.random()]), r.choice([None, "a", "b"])) for s in range(8) for h in r.sample(range(90), 9)]
    df = spark.createDataFrame(rows, "node long, time timestamp_ntz, x double, y double, name string").localCheckpoint()
    d = master.dedupe(df.withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz")), ["node", "time"])
    hours = d.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("time"))
    want = d.select("node").distinct().crossJoin(hours).join(d, ["node", "time"], "left")
    for c in "xy":
        want = series.interpolate(want, ["node"], "time", c, c, limit=None, by_time=False)
    want = series.fill_both(want, ["node"], "time", ["name"])
    got = master.hourly_spine(df, "node", "time", ["x", "y"], ["name"])
    plain = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select("node", "time", "x", "y", "name").collect())
    assert plain(got) == plain(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("Generate explode(sequence", 1)[0].count("Exchange") == 0
