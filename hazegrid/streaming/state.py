"""Streaming jobs with state: the newest payloads of each stream, and the road state that they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazegrid.functions import physics
from hazegrid.operators import diffusion
from hazegrid.operators.graph import midpoint
from hazegrid.operators.scratch import Rounds, drop_table, with_package
from hazegrid.streaming.streams import latest

KEPT = "stream STRING, ts TIMESTAMP, event_id LONG, payload STRING"


def _newest(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n newest rows of one stream, each event once."""
    return rows.sort_values(["ts", "event_id"], ascending=False, kind="stable").drop_duplicates("event_id").head(n)


class _Newest(StatefulProcessor):
    """List state of the n newest payloads of a stream; with `idle`, a stream that has been silent for so long in event time is forgotten."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts TIMESTAMP, event_id LONG, payload STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(list(self.kept.get()), columns=["ts", "event_id", "payload"])] if self.kept.exists() else []
        for batch in rows:  # a batch at a time, so that no more than n and a batch are held
            held = [_newest(pd.concat([*held, batch[["ts", "event_id", "payload"]]]), self.n)]
        now = held[0]
        self.kept.put([tuple(r) for r in now.itertuples(index=False)])
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
            self.handle.registerTimer(int(now["ts"].max().timestamp() * 1000) + self.idle)
        yield now.assign(stream=key[0])[["stream", "ts", "event_id", "payload"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        # a row without an event tells the sink that the stream is gone
        yield pd.DataFrame({"stream": [key[0]], "ts": [pd.NaT], "event_id": [None], "payload": [None]})

    def close(self) -> None:
        pass


def newest(payloads: DataFrame, n: int = 30, idle: str | None = None) -> DataFrame:
    """The n newest payloads of each stream that a micro-batch changed (update mode), late and repeated ones in their place.

    Each Arrow batch is cut to its own n newest a stream before the shuffle, so a hot stream sends few rows to its task.
    idle (such as "7 days") needs a watermark on ts.
    """
    spark = with_package(payloads.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [_newest(g, n) for _, g in b.groupby("stream")]
            if parts:
                yield pd.concat(parts)

    fewer = payloads.where("stream is not null and ts is not null").select("stream", "ts", "event_id", "payload")
    if idle is None:  # a watermark would be lost on the way through Python
        fewer = fewer.mapInPandas(cut, KEPT)
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    return fewer.groupBy("stream").transformWithStateInPandas(_Newest(n, idle_ms), KEPT, "Update", "None" if idle is None else "EventTime")


def newest_into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: replaces the changed streams in a table by stream. A repeated epoch writes the same rows again."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream").parquet(path)

    return run


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEPT).parquet(path).where("event_id is not null")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


WEATHER = "wind_speed_10m DOUBLE, wind_direction_10m DOUBLE, lat STRING, lon STRING"
AIR = "nitrogen_dioxide DOUBLE, sulphur_dioxide DOUBLE, pm2_5 DOUBLE, lat STRING, lon STRING"
SENSOR = "no2 STRING, so2 STRING, pm2_5 STRING, lat STRING, lon STRING"
TOPICS = {"weather": ("weather:live", WEATHER), "air": ("airquality:live", AIR), "sensor": ("sensors:live", SENSOR)}


def snapshot(newest_payloads: DataFrame) -> DataFrame:
    """One row with the newest weather, air and sensor payloads as structs, null where a topic has none."""
    one = newest_payloads.agg(*[F.max_by("payload", F.when(F.col("stream") == topic, F.struct("ts", "event_id"))).alias(k) for k, (topic, _) in TOPICS.items()])
    return one.select(F.lit(0).cast("long").alias("snapshot_id"), *[F.from_json(k, kind).alias(k) for k, (_, kind) in TOPICS.items()])


def road_state(simple: DataFrame, state: DataFrame, steps: int = 2) -> tuple[DataFrame, Rounds]:
    """(u, v, no2, so2, pm2_5, toxicity, spread): the newest payloads fused onto the edges and spread along them with the wind.

    simple: one row a (u, v), with the ends of `graph.with_bearing`, length and building_density. Fused edges are stored once, and
    only means by node are shuffled after that. The second value holds the tables of the steps, to be closed once the first is written.
    """
    points = diffusion.snapshot_points(snapshot(state))
    mx, my = midpoint()
    edges = simple.select("u", "v", "length", "bearing_deg", "building_density", mx.alias("x"), my.alias("y"))
    fused = diffusion.at_points(edges.crossJoin(F.broadcast(points))).select("u", "v", "length", "bearing_deg", "building_density", *diffusion.FUSED)  # one row
    turn = F.radians("wind_dir")
    speed, direction = physics.wind_state(F.col("wind_speed") * F.sin(turn), F.col("wind_speed") * F.cos(turn))
    rounds = Rounds(simple.sparkSession)
    rows = diffusion.spread_over(fused, points.select("snapshot_id", speed.alias("wind_speed"), direction.alias("wind_dir")), F.col("toxicity"), steps, rounds=rounds)
    return rows.select("u", "v", *diffusion.FUSED, F.col("s").alias("spread")), rounds


def refresh_roads(edges: DataFrame, nodes: DataFrame, simple: DataFrame, path: str, steps: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over payloads: the road state after each epoch, as version v{epoch} below path/roads.

    The newest payload of each topic is carried from version to version (path/newest). An epoch reads the version before its
    own and overwrites its own, so one that is repeated, also after a crash in the middle, gives the same tables; two versions
    are kept. The graph is static and read anew each time, so its files may be replaced between epochs. Of it only `simple` is
    read, the distinct edges with their ends.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, f"{path}/newest") if v < epoch]
        got = batch.select("stream", "ts", "event_id", "payload")
        both = got if not before else spark.read.schema(KEPT).parquet(f"{path}/newest/v{before[-1]}").unionByName(got)
        top = latest(both.select("stream", "ts", "event_id", F.struct("event_id", "payload").alias("payload")))
        top.select("stream", "ts", "payload.event_id", "payload.payload").coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/v{epoch}")
        roads, rounds = road_state(simple, spark.read.schema(KEPT).parquet(f"{path}/newest/v{epoch}"), steps)
        roads.write.mode("overwrite").parquet(f"{path}/roads/v{epoch}")
        rounds.close()
        for old in [v for v in versions(spark, f"{path}/roads") if v < epoch - 1]:
            drop_table(spark, f"{path}/newest/v{old}")
            drop_table(spark, f"{path}/roads/v{old}")

    return run


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole road state."""
    return spark.read.parquet(f"{path}/roads/v{versions(spark, f'{path}/roads')[-1]}")
