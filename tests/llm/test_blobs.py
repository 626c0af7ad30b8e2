"""Memory of tasks that gather dealt rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hazegrid.llm import line_dedup
from hazegrid.llm.blobs import gather, pack
from hazegrid.llm.common import map_rows


def batches(parts, n):
    r = np.random.default_rng(3)
    for _ in range(parts):
        key = np.sort(r.integers(0, 1 << 20, n, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.array([pack([key, *(key * np.uint64(k) for k in (3, 5, 7, 9, 11))])], pa.binary())], ["bucket", "blob"])


def test_a_bucket_is_held_once():
    given = list(batches(8, 1 << 16))
    whole = 8 * (1 << 16) * 6 * 8
    tracemalloc.start()
    (cols,) = gather(iter(given), ["u8"] * 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(cols[0].astype(np.int64)) >= 0).all() and all((c == cols[0] * np.uint64(k)).all() for c, k in zip(cols[1:], (3, 5, 7, 9, 11)))
    assert most < 2 * whole  # held, joined and sorted copies were three


def test_hot_rows_are_asked_for_again_after_as_many_more():
    asked = []

    def hot(cols):
        asked.append(len(cols[0]))
        return cols

    (cols,) = gather(batches(8, 1000), ["u8"] * 5, most=1500, hot=hot)
    assert len(cols[0]) == 8000 and asked == [2000, 4000, 6000, 8000]


def test_lists_of_which_nothing_is_left():
    assert not list(line_dedup._Lists([np.zeros(0, k) for k in ("u8", *line_dedup._POSTING)], 1, 0.8).pairs())


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = map_rows(rows, lambda b: pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]), "n long").collect()
    assert max(r.n for r in sizes) < 10 << 20
