"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

Two fingerprints within `radius` bits share a value that lies within half the radius of both. So each distinct fingerprint
emits every variant within half the radius, the variants are shuffled, and those that meet are verified. With blocks=1 the
ball is taken over all 64 bits (2,081 variants for radius 4), and whatever meets on a variant is linked. With blocks=2
the pigeonhole comes first: fingerprints within 4 bits are within 2 bits on one 32-bit half, so each half emits its variants
within 1 bit (66 in all), and pairs that meet are verified on all 64 bits. Both give the same links; 2 is used, as 2,081
rows a document do not fit the disk at hand. Where more than `group_limit` fingerprints meet on one half, those
fingerprints take the way of blocks=1, whose links are a star per variant: linear in the group, and exact.

`similar_documents` is the form for word shingles and a Jaccard similarity: a fingerprint of 768 bits over the set of
five-word shingles, in twenty-four blocks of 32 bits whose variants within 1 bit are shuffled. Sets that meet on a block and lie within
`wide` bits in all are candidates, and each link is verified on the whole shingle sets, so none is below the similarity. As
candidates, a group of sets that met first gives a spanning forest by distance; once that is verified, each of its sets gives
the nearest few that are still in other components, and twice as many from round to round until no set has any left that was
not tried. Sets that met by chance, with none of their group within `wide` bits, are dropped after the first pass. The search is approximate: two sets of similarity 0.8 meet with a chance of
about 0.95, of 0.85 with 0.99, of 0.9 with 0.999; equal sets always do.

Nulls are empty texts; texts without words have fingerprint zero and are linked like any other (for shingles: with each other).
Repeated texts share one fingerprint or set, so thousands of copies cost one; ties go to the smaller id. Texts of any length are
read whole, a megabyte at a time. An empty table gives an empty result; other columns are ignored, whatever their names, and
kept by `keep_one`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import KEY, bits_of, deal, gather, has, room
from .common import cut, lower_ascii, map_rows, shared_dir, without_ids, word_blocks
from .components import components
from .words import mix, word_hashes

_BITS = 64
#: Of the fingerprint over shingle sets: blocks, bits of each, and words of 64 bits that hold them all.
_BLOCKS, _WIDTH, _WORDS = 24, 32, 12


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles, repeats included."""
    data = lower_ascii(text or "")
    ones, n = np.zeros(_BITS, dtype=np.int64), 0
    hash64, before, total = xxhash.xxh64_intdigest, [], 0

    def add(values: list[int]) -> None:
        nonlocal ones, n
        ones += np.unpackbits(np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(values)

    for block in word_blocks(data):
        total += len(block)
        block = before + block
        if len(block) >= words:
            joined = b" ".join(block)
            ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            add([hash64(joined[a:b], seed) for a, b in zip(starts[: len(block) - words + 1].tolist(), ends[words - 1 :].tolist())])
        before = block[len(block) - words + 1 :] if words > 1 and len(block) >= words else block if len(block) < words else []
    if 0 < total < words:
        add([hash64(b" ".join(before), seed)])
    if not n:
        return 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return map_rows(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), run, "id long, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of that many bits with at most `flips` ones."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def _runs(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(cols[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))))
    return start, np.diff(np.concatenate((start, [len(cols[0])])))


def _connect(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what pairs within the radius connect."""
    out, label = [], np.arange(len(fps))
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate([np.zeros(0, np.uint64), *a]).view(np.int64), np.concatenate([np.zeros(0, np.uint64), *b]).view(np.int64)
    p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])


def links(fps: DataFrame, radius: int = 4, blocks: int = 2, group_limit: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect whatever pairs within `radius` bits connect."""
    if _BITS % blocks:
        raise ValueError("blocks must divide 64")
    if blocks == 1 and radius % 2:
        raise ValueError("the whole ball needs an even radius")
    width = _BITS // blocks
    masks = _masks(width, (radius // blocks + 1) // 2)
    # a fingerprint becomes many rows, so they are spread by number, which no later plan undoes
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    total = fps.count() * len(masks) * blocks

    def balls(b: pa.RecordBatch) -> list[np.ndarray]:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        variants = [(((fp >> np.uint64(k * width)) & np.uint64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF))[:, None] ^ masks).ravel() for k in range(blocks)]
        each = np.tile(np.repeat(fp, len(masks)), blocks)
        if blocks == 1:
            return [mix(variants[0], 0xA0761D6478BD642F) >> np.uint64(64 - KEY), each, variants[0]]
        return [np.concatenate([v << np.uint64(KEY - width) | np.uint64(k) for k, v in enumerate(variants)]), each]

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fp, variant in gather(batches, ["u8", "u8"]):
            order = np.lexsort((fp, variant))
            fp, (start, n) = fp[order], _runs(variant[order])
            first = np.repeat(fp[start], n)
            yield _pairs([first[fp != first]], [fp[fp != first]])

    if blocks == 1:  # what shares a variant within half of an even radius is within the radius
        return deal(spread, balls, ["u8", "u8"], total, step=512).mapInArrow(stars, "a long, b long").distinct()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of groups; fingerprints of groups over the limit come back as pairs with themselves."""
        known: set[int] = set()
        spilt: list[np.ndarray] = []

        def hot(cols: list[np.ndarray]) -> list[np.ndarray]:
            key, n = np.unique(cols[0], return_counts=True)
            known.update(key[n > group_limit].tolist())
            mine = np.isin(cols[0], np.fromiter(known, np.uint64, len(known)))
            spilt.append(cols[1][mine])
            return [c[~mine] for c in cols]

        for cols in gather(batches, ["u8"], hot=hot):
            key, fp = hot(cols) if known else cols
            start, n = _runs(key)
            two = start[n == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a, b = [fp[two[near]]], [fp[two[near] + 1]]
            for at, size in zip(start[n > 2].tolist(), n[n > 2].tolist()):
                group = fp[at : at + size]
                if size > group_limit:
                    spilt.append(group)
                elif got := _connect(group, radius):
                    i, j = np.array(got).T
                    a.append(group[i])
                    b.append(group[j])
            yield _pairs(a + spilt, b + spilt)
            spilt.clear()

    out = cut(deal(spread, balls, ["u8"], total).mapInArrow(met, "a long, b long"))
    over = out.where("a = b").select(F.col("a").alias("fp")).distinct()
    out = out.where("a != b")
    if not over.isEmpty():
        out = out.unionAll(links(over, radius, 1))
    return out.distinct()


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, blocks: int = 2, group_limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links, itself included)."""
    marked = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(classes.where("least is not null"), radius, blocks, group_limit)
    # nodes are the smallest ids of fingerprints, so that a component's number is its smallest id
    side = lambda k: classes.select(F.col("fp").alias(k), F.col("least").alias(f"{k}_id"))
    nodes = components(found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    per_fp = classes.join(nodes.withColumnRenamed("node", "least"), "least", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return marked.join(per_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; fewer words are one shingle, none the empty set."""
    w = word_hashes(lower_ascii(text or ""))[1]
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n], 0xD6E8FEB86659FD93)
    return np.unique(h)


def _set_key(s: np.ndarray) -> int:
    return int(mix(mix(s, 0xFF51AFD7ED558CCD).sum(dtype=np.uint64)[None] ^ np.uint64(len(s)), 0x9FB21C651E98DF25).view(np.int64)[0])


def set_fingerprint(s: np.ndarray) -> bytes:
    """Of a set of shingles: a bit is 1 if it is set in over half the hashes. _BLOCKS x _WIDTH bits are used, the rest are 0."""
    out = np.zeros(64 * _WORDS, dtype=bool)
    for k in range(_WORDS):
        h, ones = mix(s + np.uint64(k), 0xC4CEB9FE1A85EC53), np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[64 * k : 64 * k + 64] = 2 * ones > len(h)
    out[_BLOCKS * _WIDTH :] = False
    return np.packbits(out, bitorder="little").tobytes()


_MEMBER = ["u4", "u4", "u4", "i8", "i8", "i8", *["u8"] * _WORDS]


def _sets(plain: DataFrame, words: int) -> DataFrame:
    """(id, a: key of the set, n, fp), written once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(_set_key(s), len(s), set_fingerprint(s)) for s in (shingles(x.as_py(), words) for x in b.column(1))]
        a, n, fp = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary())], ["id", "a", "n", "fp"])

    spark = plain.sparkSession
    at = f"{shared_dir(spark)}/shingles-{uuid.uuid4().hex}"
    map_rows(plain, run, "id long, a long, n long, fp binary").write.parquet(at)
    return spark.read.parquet(at)


def _meetings(sets: DataFrame) -> DataFrame:
    """(g, short) of groups of at least two sets that share a variant of a block; `short` is 40 bits of the set's key."""
    masks = _masks(_WIDTH, 1)
    spread = sets.select("short", "fp").repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "short")

    def balls(b: pa.RecordBatch) -> list[np.ndarray]:
        bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, 8 * _WORDS), axis=1, bitorder="little")[:, : _BLOCKS * _WIDTH]
        value = bits.reshape(-1, _BLOCKS, _WIDTH).astype(np.uint64) @ (np.uint64(1) << np.arange(_WIDTH, dtype=np.uint64))
        key = (value[:, :, None] ^ masks) << np.uint64(KEY - _WIDTH) | np.arange(_BLOCKS, dtype=np.uint64)[:, None]
        return [key.ravel(), np.repeat(b.column(0).to_numpy(), _BLOCKS * len(masks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, short in gather(batches, ["u8"]):
            start, n = _runs(key)
            more = np.repeat(n > 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(key[more].view(np.int64)), pa.array(short[more].view(np.int64))], ["g", "short"])

    return deal(spread, balls, ["u8"], sets.count() * _BLOCKS * len(masks), step=1024).mapInArrow(run, "g long, short long")


def _candidates(met: DataFrame, block: int, threshold: float, wide: int, nearest: int) -> DataFrame:
    """Pairs (x, y) of sets of one group and different labels within `wide` bits: a spanning forest of each group, or with `nearest` that many of each set.
    Rows with x = y are sets: of a forest, with their group g, those that have any other within `wide` bits; else those that have more than `nearest`.
    met (g, a, n, fp, label). Groups longer than `block` are dealt as pairs of blocks, so no task holds more than two blocks of one group."""
    sizes = met.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    dealt = met.join(sizes.select("g", "blocks"), "g").withColumn("k", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", F.least("k", "other").alias("k1"), F.greatest("k", "other").alias("k2"), "k", "n", "a", "label", "fp")

    def member(b: pa.RecordBatch) -> list[np.ndarray]:
        g, k1, k2, k, n, a, label = (c.to_numpy() for c in b.columns[:7])
        pair = np.where(k2 > 0, (k1.astype(np.uint64) << np.uint64(20)) + k2.astype(np.uint64), np.uint64(0))
        key = mix(g.view(np.uint64) ^ mix(pair, 0xA0761D6478BD642F), 0xD6E8FEB86659FD93) >> np.uint64(64 - KEY)
        fp = np.frombuffer(b"".join(b.column(7).to_pylist()), dtype=np.uint64).reshape(-1, _WORDS)
        return [key, k1 != k2, k, n, g, a, label, *fp.T]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cross, k, n, g, a, label, *fp in gather(batches, _MEMBER):
            fp, n = np.stack(fp, axis=1), n.astype(np.int64)
            start, size = _runs(key)
            xs, ys, noted = [], [], np.zeros(len(a), bool)

            def far(i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Of places j those that may be similar to i, and how far they are."""
                ok = (label[j] != label[i]) & (np.minimum(n[i], n[j]) >= np.ceil(threshold * np.maximum(n[i], n[j]) - 1e-9)) & ((cross[i] == 0) | (k[j] != k[i]))
                j = j[ok]
                d = np.bitwise_count(fp[j] ^ fp[i]).sum(axis=1, dtype=np.int64)
                return j[d <= wide], d[d <= wide]

            two = start[size == 2]
            if len(two):
                ok = (label[two] != label[two + 1]) & ((cross[two] == 0) | (k[two] != k[two + 1])) & (np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1) <= wide) & (np.minimum(n[two], n[two + 1]) >= np.ceil(threshold * np.maximum(n[two], n[two + 1]) - 1e-9))
                xs.append(a[two[ok]])
                ys.append(a[two[ok] + 1])
                if not nearest:
                    noted[two[ok]] = noted[two[ok] + 1] = True
            for lo, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                if nearest:
                    for i in range(lo, lo + m):
                        j, d = far(i, np.arange(lo, lo + m))
                        noted[i] = len(j) > nearest
                        j = j[np.argsort(d, kind="stable")[:nearest]]
                        xs.append(np.full(len(j), a[i]))
                        ys.append(a[j])
                    continue
                best, who, todo, i = np.full(m, 1 << 30), np.zeros(m, np.int64), np.ones(m, bool), 0
                for _ in range(m - 1):
                    todo[i] = False
                    j, d = far(lo + i, lo + np.flatnonzero(todo))
                    noted[j] = True  # every pair is seen once, from the side that is done first
                    noted[lo + i] |= len(j) > 0
                    j -= lo
                    closer = d < best[j]
                    best[j[closer]], who[j[closer]] = d[closer], i
                    rest = np.flatnonzero(todo)
                    i = int(rest[np.argmin(best[rest])])
                    if best[i] < 1 << 30:
                        xs.append(a[[lo + who[i]]])
                        ys.append(a[[lo + i]])
            if xs:
                b = _pairs([x.view(np.uint64) for x in xs], [y.view(np.uint64) for y in ys])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], ["x", "y", "g"])
            own = pa.array(a[noted])
            yield pa.RecordBatch.from_arrays([own, own, pa.nulls(len(own), pa.int64()) if nearest else pa.array(g[noted])], ["x", "y", "g"])

    return deal(dealt, member, _MEMBER, met.count()).mapInArrow(run, "x long, y long, g long").distinct()


def _verified(pairs: DataFrame, plain: DataFrame, once: DataFrame, words: int, t: float) -> DataFrame:
    """The pairs (x, y) whose whole sets have the similarity."""
    used = cut(pairs.select(F.explode(F.array("x", "y")).alias("a")).distinct().join(once.select("a", "least"), "a").select("least", "a"))
    bits = room(used.count())
    place = lambda ids: (mix(ids.astype(np.int64).view(np.uint64), 0xA0761D6478BD642F) & np.uint64(bits - 1)).astype(np.int64)
    hit = plain.sparkSession.sparkContext.broadcast(bits_of(used, bits, lambda b: place(b.column(0).to_numpy())))

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.flatnonzero(has(hit.value, place(b.column(0).to_numpy(zero_copy_only=False)))).tolist()
        texts = [b.column(1)[i].as_py() or "" for i in at]
        press = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([_set_key(shingles(x, words)) for x in texts], pa.int64()), pa.array([press.compress(lower_ascii(x)) for x in texts], pa.binary())], ["least", "a", "s"])

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, open_ = [], zstandard.ZstdDecompressor()
        for p, q in zip(b.column(2), b.column(3)):
            p, q = (shingles(open_.decompress(v.as_py()).decode(), words) for v in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= t * (len(p) + len(q) - both) - 1e-9)
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["x", "y"])

    found = map_rows(plain, whole, "least long, a long, s binary").join(used, ["least", "a"], "left_semi").groupBy("a").agg(F.min("s").alias("s"))
    side = lambda k: found.select(F.col("a").alias(k), F.col("s").alias(f"{k}s"))
    return map_rows(pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "xs", "ys"), check, "x long, y long")


def similar_documents(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, wide: int = 168, block: int = 2048, nearest: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with an id: id, component_id (the smallest id reachable over verified links, itself included)."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null")
    every = _sets(plain, words)
    once = cut(every.groupBy("a").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    sets = once.where("n > 0").withColumn("short", F.shiftrightunsigned("a", 64 - KEY))
    met = cut(_meetings(sets).join(sets.select("short", "a", "n", "fp"), "short").select("g", "a", "n", "fp"))
    side = lambda k: once.select(F.col("a").alias(k), F.col("least").alias(f"{k}_id"))

    def groups(found: DataFrame) -> DataFrame:
        """(a, component): nodes are the smallest ids of sets."""
        nodes = components(found.join(side("x"), "x").join(side("y"), "y").select(F.col("x_id").alias("a"), F.col("y_id").alias("b")))
        return cut(once.select("a", "least").join(nodes.withColumnRenamed("node", "least"), "least", "left").select("a", F.coalesce("component", "least").alias("component")))

    first = cut(_candidates(met.withColumn("label", F.col("a")), block, threshold, wide, 0))
    tried = first.where("x <> y").select("x", "y")
    met = cut(met.join(first.where("x = y").select("g", F.col("x").alias("a")), ["g", "a"], "left_semi"))
    found = cut(_verified(tried, plain, once, words, threshold))
    named = groups(found)
    while True:
        got = cut(_candidates(met.join(named.withColumnRenamed("component", "label"), "a"), block, threshold, wide, nearest))
        more = cut(got.where("x <> y").select("x", "y").join(tried, ["x", "y"], "left_anti"))
        if not more.isEmpty():
            found, tried = found.unionAll(cut(_verified(more, plain, once, words, threshold))), tried.unionAll(more)
            named = groups(found)
        if got.where("x = y").isEmpty():  # all that are left in other components have been tried
            break
        nearest *= 2
    return every.select("id", "a").join(named, "a").select(F.col("id").alias(id_col), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those whose near-duplicate group (`similar_documents`) has a smaller id; rows without an id stay, of rows with one id all or none do."""
    groups = similar_documents(docs, id_col=id_col, text_col=text_col, **options)
    return without_ids(docs, groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")), id_col)
