"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROOT = str(Path(__file__).resolve().parents[2])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def drop_table(spark: SparkSession, at: str) -> None:
    """Deletes a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads neither recompute df nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of whole texts that go to a Python worker at a time; Spark's own 10,000 may be a hundred megabytes on either side.
BATCH_ROWS = 2000
#: Bytes of a batch, whose rows may be blobs of megabytes; Spark's own limit is many times that, and both sides hold a batch.
BATCH_BYTES = 1 << 23


def with_path(df: DataFrame) -> DataFrame:
    """df, whose workers will find this package where the driver found it, installed or not, and get small batches."""
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow for a function of one batch, which may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = batch(b)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # workers serve later stages too

    return with_path(df).mapInArrow(run, schema)


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and all other characters as they are."""
    return text.encode().translate(_LOWER)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space (0x20, 0x09-0x0D), about `size` bytes at a time, so that a long text needs no long list."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + size)
        while to < end and data[to] not in b" \t\n\r\x0b\x0c":
            step = data[to : to + 4096]
            gap = min((i for i in (step.find(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=len(step))
            to += gap
        words = data[at:to].split()
        if words:
            yield words
        at = to


def uniform(key, seed: int):
    """A number in [0, 1) from a key's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


#: Ids that are broadcast at most, about 100 MB in memory; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs, all columns, without the rows whose id is in gone (id); rows without an id stay. Few ids are broadcast, so that no text is shuffled."""
    gone = cut(gone.select(F.col("id").alias(free_name(docs))).distinct())
    if gone.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti")
    return docs.join(gone, docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti")


def free_name(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    name = "id"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
