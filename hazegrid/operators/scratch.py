"""Where long lineages are cut: tables and checkpoints in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def with_package(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers will find this package where the driver found it, installed or not."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. It keeps its plan's size estimate, so loops that join a table with itself use Rounds instead."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_table(spark: SparkSession, at: str) -> None:
    """Deletes a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """Tables of a loop's rounds, written as Parquet and read back, so that plans and size estimates start afresh each round.

    A table is deleted once two newer ones of its name are written: the newest may be computed from the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.names = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        mine = self.names.setdefault(name, [])
        path = f"{self.at}/{name}-{len(mine)}"
        df.write.parquet(path)
        mine.append(path)
        if len(mine) > 2:
            drop_table(self.spark, mine[-3])
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Deletes all tables; what was computed from them must be written by then."""
        drop_table(self.spark, self.at)
