"""Nearest neighbours and progressive JPEG on small inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.llm import jpeg, mih


def brute(rows, queries, k):
    out = {}
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, v in queries:
        s = (x * np.array(v)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = ids[order].tolist()
    return out


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict = {}
    for r in mih.search(e, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in e.collect()]
    want = brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [0.5, 0.5]), (40, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "shard": F.lit(2)})
    got = [(r.query_id, r["rank"], r.id, r.score) for r in mih.search(d, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (0, 4, 10, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 10, 0.5)]
    assert mih.search(d.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    m = mih.Model(np.zeros(64), np.concatenate([mih._rotation(x, s) for s in range(4)], axis=1), 120)
    c = m.codes(x)
    far = np.bitwise_count(c.view(np.uint64)[:5, None, :] ^ c.view(np.uint64)[None, :, :]).sum(axis=2)
    for radius in (90, 105, 120):
        found = mih.search_shard(np.arange(400), x, c, np.arange(1000, 1005), x[:5], c[:5], radius, 400)
        for q, ids, _ in found:
            inside = set(np.flatnonzero(far[q - 1000] <= radius).tolist())
            assert inside <= set(ids.tolist())
    assert sum(s + 1 for s in mih._shares(105)) == 106


def test_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.4, 0.1]), (2, [0.3, 0.0]), (2, [0.3, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in mih.search(d, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.4), (0, 2, 2, 0.3)]


def test_many_shards_merge(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(900)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in mih.search(d, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 5)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


TEXTS = [None, "", "a", "x" * 64, "x" * 65, "\x00\x01\x02\xff" * 40, "naïve 中文 " * 300, "a\n" * 3000]


def test_payload_comes_back_and_equal_texts_are_equal():
    payloads = [jpeg.payload(t)[0] for t in [*TEXTS, *TEXTS[::-1]]]
    assert all(p and len(p) % 64 == 0 for p in payloads)
    media = jpeg.encode_batch(payloads)
    assert media == media[::-1] and media[2] == jpeg.encode_batch([payloads[2]])[0]
    parsed, co = jpeg.coefficients(media)
    assert [jpeg.stored(p, co, len(x)) for p, x in zip(parsed, payloads)] == payloads
    features = [jpeg.feature(jpeg.tensor(p, jpeg.samples(parsed, co))) for p in parsed]
    assert features == features[::-1] and features[2] == jpeg.feature(jpeg.decode_batch([media[2]])[0])


def test_transform_against_the_definition():
    rng = np.random.default_rng(3)
    co = np.zeros((3, 64), dtype=np.int16)
    co[:, :10] = rng.integers(-60, 60, (3, 10))
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    for block, got in zip(co, jpeg.planes(co, np.full(64, 2))):
        f = np.zeros(64)
        f[jpeg.ZIGZAG] = block * 2
        f = f.reshape(8, 8)
        want = np.array([[128 + sum(c(u) * c(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
        assert np.abs(np.clip(want, 0, 255) - got).max() <= 0.51


def _write(co, scans, h=8, w=8):
    """A one-part progressive picture of one row of blocks, its bits written plainly, with full refinement of zero coefficients."""
    ac = [(r << 4 | n, 7) for r in range(16) for n in (1, 2, 3)] + [(0x00, 7), (0xF0, 7)]
    code = jpeg._canonical(ac)
    dc = jpeg._canonical(jpeg._DC)
    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    out = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [1] * 64)) + jpeg._segment(0xC2, frame) + jpeg._table_segment(0, jpeg._DC) + jpeg._table_segment(0x10, ac)
    for first, last, high, low in scans:
        bits, pred = "", 0
        put = lambda v, n: format(v, f"0{n}b") if n else ""
        for b in co:
            if first == 0:
                if high:
                    bits += str(int(b[0]) >> low & 1)
                    continue
                v = (int(b[0]) >> low) - pred
                pred += v
                n = abs(v).bit_length()
                bits += put(*dc[n]) + put(v if v >= 0 else v + (1 << n) - 1, n)
                continue
            point = lambda v: (abs(int(v)) >> low) * (1 if v >= 0 else -1)
            run, fix, k = 0, "", first
            ends = [k for k in range(first, last + 1) if (abs(point(b[k])) == 1 if high else point(b[k]))]
            stop = ends[-1] if ends else first - 1
            while k <= last:
                v = point(b[k])
                if high and abs(v) > 1:
                    fix += str(abs(v) & 1)
                elif v == 0:
                    run += 1
                    if run == 16 and k < stop:
                        bits += put(*code[0xF0]) + fix
                        run, fix = 0, ""
                else:
                    n = abs(v).bit_length()
                    bits += put(*code[run << 4 | n]) + (put(v if v > 0 else v + (1 << n) - 1, n) if not high else str(int(v > 0))) + fix
                    run, fix = 0, ""
                k += 1
            if run or fix:
                bits += put(*code[0]) + fix
        bits += "1" * (-len(bits) % 8)
        data = int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        out += jpeg._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + data
    return out + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_refinement_of_any_coefficients(seed):
    rng = np.random.default_rng(seed)
    co = np.where(rng.random((5, 64)) < 0.3, rng.integers(-7, 8, (5, 64)), 0)
    co[:, 0] = rng.integers(-100, 100, 5)
    media = _write(co, [(0, 0, 0, 1), (1, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)], 8, 40)
    parsed, got = jpeg.coefficients([media])
    assert (got == co).all()
    assert jpeg.decode_batch([media])[0].shape == (8, 40, 3)


def test_documents_and_tensors(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"id": F.lit(0), "media": F.lit("x")})
    rows = {r.doc_id: r for r in jpeg.store_documents(d, keep_media=True, keep_tensor=True).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert jpeg.decode_batch([bytes(r.media)])[0].tobytes() == bytes(r.rgb) and len(r.rgb) == 3 * r.height * r.width
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    m = spark.createDataFrame([(1, bytearray(rows[6].media)), (2, None), (3, bytearray(b"junk"))], "k long, m binary")
    t = {r.k: r for r in jpeg.rgb_tensors(m, id_col="k", media_col="m").collect()}
    assert len(t[1].rgb) == 3 * t[1].height * t[1].width and t[2].rgb is None and t[3].height is None
    assert jpeg.store_documents(d.where("false")).count() == 0
