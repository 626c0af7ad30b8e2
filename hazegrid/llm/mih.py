"""Approximate nearest neighbours by multi-index hashing (operator 1).

Rotations learned on a bounded sample turn each vector into a binary code (the signs of the rotated coordinates). Codes are
split into 16-bit substrings and every substring is indexed in each shard of rows. A code within `radius` bits of a query's
is, by the pigeonhole, within a small share of the radius on some substring: probing the buckets within those shares
retrieves every code within the radius. What remains after the full Hamming distance is reranked by the inner product in
double precision. A shard with fewer than k codes within the radius is probed again with a wider one.

The queries are a stated part of the rows, and meet the rows in blocks: each pair of a shard and a query block is one group
of bounded size. Their best k are merged in groups of at most 64 lists.

Vectors that are null, zero, hold null or non-finite components, or have another length than the sample's most common one
take no part, neither as queries nor as rows. Rows that repeat an id are one row, the one whose vector sorts first. Equal
scores rank by the smaller id. A query is never its own neighbour; with fewer than k other rows all are returned. Empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, uniform

BITS, SUB = 256, 16
#: Rows of a shard and queries of a block.
SHARD, BLOCK = 2048, 4096


@dataclass
class Model:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions by BITS
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """BITS signs a row, packed in bytes."""
        return np.packbits((x - self.mean) @ self.rotations > 0, axis=1, bitorder="little")


def _rotation(x: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """An orthogonal matrix that brings rows close to their signs, by alternating least squares from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return r


def fit(x: np.ndarray, k: int = 20, cover: float = 98.0) -> Model:
    """From a sample: rotations, and the radius that holds `cover` per cent of the sample's own k nearest neighbours."""
    x = np.unique(x, axis=0)
    mean = x.mean(axis=0)
    wide = -(-BITS // x.shape[1])
    r = np.concatenate([_rotation(x - mean, seed) for seed in range(wide)], axis=1)[:, :BITS]
    m = Model(mean, r, BITS)
    if len(x) > 10 * k:
        q = np.arange(0, len(x), max(1, len(x) // 400))
        near = x[q] @ x.T
        near[np.arange(len(q)), q] = -np.inf
        top = np.argpartition(-near, k, axis=1)[:, :k]
        c = m.codes(x).view(np.uint64)
        m.radius = int(np.percentile(np.bitwise_count(c[q][:, None, :] ^ c[top]).sum(axis=2), cover))
    return m


def _shares(radius: int) -> list[int]:
    """Probing radius of each substring, so that a code within the radius lies within one of them."""
    m = BITS // SUB
    share, rest = divmod(radius, m)
    return [share if i <= rest else share - 1 for i in range(m)]


def search_shard(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, radius: int, k: int, step: int = 256) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the best k of a shard: (query id, ids, scores)."""
    out = []
    subs, q_subs = codes.view(np.uint16), q_codes.view(np.uint16)
    words, q_words = codes.view(np.uint64), q_codes.view(np.uint64)
    index = [np.unique(subs[:, i], return_inverse=True) for i in range(subs.shape[1])]  # each substring's buckets
    for at in range(0, len(q), step):
        todo, wide = np.arange(at, min(at + step, len(q))), radius
        while len(todo):
            hits = np.zeros((len(todo), len(ids)), dtype=bool)
            for i, share in enumerate(_shares(wide)):
                if share >= 0:
                    values, bucket = index[i]
                    hits |= (np.bitwise_count(q_subs[todo, i][:, None] ^ values[None, :]) <= share)[:, bucket]
            hits &= query_ids[todo][:, None] != ids[None, :]
            # the full distance of what was probed, and of nothing else
            row, col = np.nonzero(hits)
            for a in range(0, len(row), 1 << 16):
                r, c = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
                hits[r, c] = np.bitwise_count(q_words[todo[r]] ^ words[c]).sum(axis=1, dtype=np.int64) <= wide
            enough = (hits.sum(axis=1) >= min(k, max(0, len(ids) - 1))) | (wide >= BITS)
            row, col = np.nonzero(hits & enough[:, None])
            score = np.empty(len(row))
            for a in range(0, len(row), 1 << 16):
                score[a : a + (1 << 16)] = (x[col[a : a + (1 << 16)]] * q[todo[row[a : a + (1 << 16)]]]).sum(axis=1)
            order = np.lexsort((ids[col], -score, row))
            bounds = np.searchsorted(row[order], np.arange(len(todo) + 1))
            for i in np.flatnonzero(enough).tolist():
                best = order[bounds[i] : bounds[i + 1]][:k]
                if len(best):
                    out.append((int(query_ids[todo[i]]), ids[col[best]], score[best]))
            todo, wide = todo[~enough], min(BITS, wide + 2 * SUB)
    return out


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty, have no null or non-finite component, and are not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The best k of each (query_id, grp) from lists of structs (s: minus score, id)."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k)
    return lists.groupBy("query_id", "grp").agg(best.alias("best"))


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, sample_rows: int = 4096, seed: int = 9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query row: query_id, rank from 1, id, score. `sample_rows` bounds what the model is fitted on."""
    plain = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("v")))
    counts = plain.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, id long, score double"
    if counts is None or not counts.q:
        return vectors.sparkSession.createDataFrame([], empty)
    plain = plain.where(F.size("v") == counts.d)
    sample = plain.where(uniform(F.col("id"), seed) < 1.2 * sample_rows / counts.n).select("v").limit(sample_rows).collect()
    model = fit(np.array([r.v for r in sample], dtype=np.float64) if sample else np.eye(counts.d), k)
    shards, blocks = max(1, -(-counts.n // SHARD)), max(1, -(-counts.q // BLOCK))

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        v = b.column(1)
        x = v.values.to_numpy()[v.offsets[0].as_py() :].reshape(-1, counts.d)[: len(v)]
        return pa.RecordBatch.from_arrays([b.column(0), v, b.column(2), pa.array([c.tobytes() for c in model.codes(x)], pa.binary())], ["id", "v", "is_query", "code"])

    coded = cut(map_rows(plain, code, "id long, v array<double>, is_query boolean, code binary"))
    hashed = F.xxhash64("id")
    rows = coded.select("id", "v", "code", F.pmod(hashed, F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = coded.where("is_query").select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("code").alias("q_code"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("q_shard"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("q_block"))
    radius = model.radius

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = t.column(1).combine_chunks()
        x = v.values.to_numpy()[v.offsets[0].as_py() :][: len(t) * counts.d].reshape(-1, counts.d)
        ids, codes = t.column(0).to_numpy(), np.frombuffer(b"".join(t.column(2).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
        if len(np.unique(ids)) < len(ids):  # rows of one id meet here, as they are dealt by it
            order = np.lexsort((*x.T[::-1], ids))
            order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
            ids, x, codes = ids[order], x[order], codes[order]
        return ids, x, codes

    schema = pa.schema([("query_id", pa.int64()), ("grp", pa.int64()), ("best", pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        shard = left["shard"][0].as_py()
        found = search_shard(*arrays(left), *arrays(right), radius, k)
        if not found:
            return schema.empty_table()
        ends = np.cumsum([0] + [len(f[1]) for f in found]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(-np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["s", "id"])
        return pa.Table.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(np.full(len(found), shard // 64)), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)

    best = rows.groupBy("shard", "block").cogroup(queries.groupBy("q_shard", "q_block")).applyInArrow(one, "query_id long, grp long, best array<struct<s:double,id:long>>")
    while shards > 1:
        best = _merge(best, k)
        shards = -(-shards // 64)
        best = best.withColumn("grp", F.floor(F.col("grp") / 64).cast("long"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))
