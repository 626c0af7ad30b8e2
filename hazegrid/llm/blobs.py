"""Numbers dealt by key in compressed blobs: the same shuffle as a row a number, in a fraction of its bytes.

`deal` turns rows into columns of numbers whose first is a key below 2**KEY, cuts the key range into buckets of about `per`
rows, and shuffles one blob a bucket and flush. `gather` streams the buckets of a partition, one at a time, in order of key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_path

KEY = 40
#: Rows that a task holds before it writes its blobs.
FLUSH = 1 << 19


def pack(cols: list[np.ndarray]) -> bytes:
    """Columns of one length, byte plane by byte plane; the first ascends and is stored as differences."""
    first = cols[0].astype(np.uint64)
    first[1:] -= cols[0][:-1]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (first, *cols[1:])]
    return len(first).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), dtype=np.uint8)
    out, at = [], 0
    for kind in ("u8", *kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of all parts in order of the first; the parts are emptied column by column, so that no second copy of all is held."""
    cols = []
    for _ in range(len(parts[0])):
        cols.append(np.concatenate([p.pop(0) for p in parts]))
    parts.clear()
    return placed(cols, np.argsort(cols[0], kind="stable"))


def placed(cols: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """Rows `at` of the columns, in place of them."""
    for i in range(len(cols)):
        cols[i] = cols[i][at]
    return cols


def deal(rows: DataFrame, make: Callable[[pa.RecordBatch], list[np.ndarray]], kinds: list[str], total: int, per: int = 1 << 20, step: int = 10_000) -> DataFrame:
    """(bucket, blob) dealt by bucket and in its order; `make` gives the key (uint64) and columns of `kinds` of at most `step` rows, `total` in all."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(min(1 << 22, max(3 * parts, -(-total // per))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cols = merged(held)
            bucket = (cols[0] * np.uint64(buckets)) >> np.uint64(KEY)
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = [*start[1:].tolist(), len(bucket)]
            blobs = [pack([c[a:b] for c in cols]) for a, b in zip(start.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in (x.slice(at, step) for x in batches for at in range(0, x.num_rows, step)):
            cols = [np.asarray(c).astype(k, copy=False) for c, k in zip(make(b), ("u8", *kinds))]
            if len(cols[0]):
                held.append(cols)
                n += len(cols[0])
            if n >= FLUSH:
                yield flush()
                n = 0
        if n:
            yield flush()

    return with_path(rows).mapInArrow(run, "bucket int, blob binary").repartition(max(parts, -(-buckets // 64)), "bucket").sortWithinPartitions("bucket")


def gather(batches: Iterator[pa.RecordBatch], kinds: list[str], most: int = 1 << 21, hot: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of each bucket, in order of key; the caller may empty the list. Where more than `most` rows come together, `hot` may take some away; it is asked again when as many more have come."""
    now, held, n, full = None, [], 0, most

    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now:
                if held:
                    yield merged(held)
                now, n, full = bucket, 0, most
            held.append(unpack(blob.as_py(), kinds))
            n += len(held[-1][0])
            if n > full and hot is not None:
                held = [hot(merged(held))]
                n = len(held[0][0])
                full = n + most
    if held:
        yield merged(held)


def bits_of(table: DataFrame, bits: int, places: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A filter of `bits` bits (a multiple of 32,768) set where `places(batch)` says; bits / 8 bytes reach the driver."""
    chunk = 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(places(b))
            if len(at):
                part = at // chunk
                start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                low = (at % chunk).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array([low[x:y].tobytes() for x, y in zip(start.tolist(), [*start[1:].tolist(), len(at)])], pa.binary())], ["part", "low"])

    def join(t: pa.Table) -> pa.Table:
        hit = np.zeros(chunk, dtype=np.uint8)
        hit[np.frombuffer(b"".join(t["low"].to_pylist()), dtype=np.uint16)] = 1
        return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(hit, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in with_path(table).mapInArrow(run, "part long, low binary").groupBy("part").applyInArrow(join, "part long, bits binary").collect():
        out[r["part"] * chunk // 8 : (r["part"] + 1) * chunk // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def room(n: int, most: int = 1 << 27) -> int:
    """Bits of a filter for n entries: 16 an entry, 16 MB at most, whatever the input; a fuller one lets more through and loses nothing."""
    return min(most, max(1 << 15, 1 << int(16 * n).bit_length()))


