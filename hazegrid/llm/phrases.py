"""Phrase collocation mining (operator 13): counts of word sequences in weighted acyclic automata.

Texts are lower-cased (A-Z) and split into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into words at spaces and tabs. For each language
n counts all words, f(p) all places of a phrase p within pieces. Candidates are phrases of 2 to `longest` words with f >= least.
A cut after k words scores floor(1000 * f(p) * n / (f(first k) * f(rest))); the lowest cut counts, ties to the smaller k. A
candidate goes if a longer one that contains it is as frequent; as counts never rise with length, that longer one may be taken
to have one word more.

1. A part is at least as frequent as its whole, so hashes of words, then of pairs of frequent words, then of longer runs of
   frequent pairs are counted (packed, by key range), and a filter keeps what may reach `least`. A filter only ever lets too
   much through: its keys may collide, and beyond 2**30 bits (128 MB, some 67 million keys) it fills up, which costs work and
   changes no result.
2. Each shard sorts the phrases that pass and builds count transducers from them, one for each range of the first word: minimal
   acyclic automata in which the i-th phrase, in order, has the i-th count.
3. Transducers of one range are united, counts added, in two rounds, so that no task takes all shards. One walk along a phrase
   gives the counts of all its beginnings; its next edges tell whether a longer phrase is as frequent.
4. The frequent phrases are dealt by ranges of their last word into transducers of reversed phrases, whose walks give the counts
   of all ends. Both walks together score every cut; no part is looked up by a join.

A phrase is told from others by 128 bits of two hashes within a batch of text, and by its words everywhere else. Null texts are
empty, null languages `und`; texts of any length are read in pieces, with four words of overlap where no separator comes.
Repeated rows count each time. Empty tables give empty results. Only the two columns are read, so others can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import KEY, bits_of, has, pack, unpack
from .common import cut, lower_ascii, with_path
from .words import PIECE, _power, mix

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = 2
_BREAKS, _GAPS = [b".", b",", b";", b":", b"!", b"?", b"\n", b"\r", b"\x0b", b"\x0c"], [b" ", b"\t"]
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (131, 132)]
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Text that is hashed at a time, keys and phrases that a shard holds before it writes them.
BUFFER, FLUSH_KEYS, FLUSH_PHRASES = PIECE - 1, 1 << 22, 300_000
#: Bits of the widest filter.
MOST_BITS = 1 << 30


# ---- automata ----------------------------------------------------------------------------------------------------------------


class CountTransducer:
    """A minimal acyclic automaton over words that maps phrases to counts: the i-th accepted phrase, in order, has the i-th count."""

    def __init__(self, final: list[bool], edges: list[tuple[tuple[bytes, int], ...]], counts: list[int]):
        self.final, self.edges, self.counts = final, edges, counts  # a state's targets come before it; the last one is the start
        below: list[int] = []
        self.steps: list[dict[bytes, tuple[int, int]]] = []
        for end, out in zip(final, edges):
            n, steps = int(end), {}
            for word, to in out:
                steps[word] = (to, n)
                n += below[to]
            below.append(n)
            self.steps.append(steps)

    @classmethod
    def build(cls, entries: Iterable[tuple[tuple[bytes, ...], int]]) -> CountTransducer:
        """From phrases in ascending order, each once: what a new phrase no longer shares is closed, and states with equal futures become one."""
        final, edges, counts, known = [], [], [], {}

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(final)
                final.append(node[0])
                edges.append(key[1])
            return known[key]

        path: list[list] = [[False, []]]
        before: tuple[bytes, ...] = ()
        for words, count in entries:
            same = 0
            while same < min(len(before), len(words)) and before[same] == words[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((before[len(path) - 1], close(node)))
            path.extend([False, []] for _ in words[same:])
            path[-1][0] = True
            counts.append(count)
            before = words
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], close(node)))
        # the start closes last, as a state of its own
        final.append(path[0][0])
        edges.append(tuple(path[0][1]))
        return cls(final, edges, counts)

    def items(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """All phrases in order, with their counts."""
        at, todo = 0, [((), len(self.final) - 1)]
        while todo:
            words, state = todo.pop()
            if self.final[state]:
                yield words, self.counts[at]
                at += 1
            todo.extend((words + (w,), to) for w, to in reversed(self.edges[state]))

    def walk(self, words: tuple[bytes, ...]) -> tuple[list[int], bool]:
        """(counts of all beginnings of an accepted phrase, the last its own; whether a phrase of one word more has the same count)."""
        state, at, out = len(self.final) - 1, 0, []
        for w in words:
            state, skip = self.steps[state][w]
            at += skip
            out.append(self.counts[at] if self.final[state] else 0)
        return out, any(self.final[to] and self.counts[at + skip] == out[-1] for to, skip in self.steps[state].values())

    @classmethod
    def union(cls, several: list[CountTransducer]) -> CountTransducer:
        """Phrases of all, counts added."""

        def added() -> Iterator[tuple[tuple[bytes, ...], int]]:
            now, n = None, 0
            for words, count in heapq.merge(*(t.items() for t in several)):
                if words != now:
                    if now is not None:
                        yield now, n
                    now, n = words, 0
                n += count
            if now is not None:
                yield now, n

        return cls.build(added())

    def to_bytes(self) -> bytes:
        labels = sorted({w for out in self.edges for w, _ in out})
        place = {w: i for i, w in enumerate(labels)}
        flat = [x for out in self.edges for x in out]
        parts = [b" ".join(labels), np.array(self.final, np.uint8), np.array([len(out) for out in self.edges], np.uint32), np.array([place[w] for w, _ in flat], np.uint32), np.array([t for _, t in flat], np.uint32), np.array(self.counts, np.int64)]
        parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(len(p).to_bytes(5, "little") for p in parts) + b"".join(parts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountTransducer:
        data = zstandard.ZstdDecompressor().decompress(blob)
        at, parts = 30, []
        for i in range(6):
            n = int.from_bytes(data[5 * i : 5 * i + 5], "little")
            parts.append(data[at : at + n])
            at += n
        labels = parts[0].split(b" ")
        final, size, label, to = (np.frombuffer(p, k).tolist() for p, k in zip(parts[1:5], (np.uint8, np.uint32, np.uint32, np.uint32)))
        pairs = iter(zip((labels[i] for i in label), to))
        return cls([bool(x) for x in final], [tuple(next(pairs) for _ in range(n)) for n in size], np.frombuffer(parts[5], np.int64).tolist())


# ---- text to hashed runs of words --------------------------------------------------------------------------------------------


def _words_in(data: bytes) -> int:
    return int(np.count_nonzero(np.diff(np.concatenate(([True], _CLASS[np.frombuffer(data, np.uint8)] > 0)).astype(np.int8)) == -1))


def _pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(part of a text, words at its start that the part before has had); parts end at separators where they can, else between words."""
    at = back = skip = 0
    while at < len(data):
        to = at + BUFFER
        if to < len(data):
            end = max(data.rfind(c, at, to) for c in _BREAKS) + 1 or max(data.rfind(c, at + 1, to) for c in _GAPS)
            to = end if end > at else min((i for c in (*_BREAKS, *_GAPS) if (i := data.find(c, to)) >= 0), default=len(data))
        yield data[back:to], skip
        at = to
        if data[to - 1 : to] in _BREAKS:
            back, skip = to, 0
        else:
            before = data[back:to].rsplit(None, 4)
            back += len(before[0]) if len(before) == 5 else 0
            skip = _words_in(data[back:to])


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
    """(language, lower-cased text, words to skip): short texts of a language together, long ones in parts."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
        data = lower_ascii(text.as_py()) if text.is_valid else b""
        if len(data) > BUFFER // 2:
            for part, skip in _pieces(data):
                yield lang, part, skip
            continue
        if size.get(lang, 0) + len(data) + 1 > BUFFER:
            yield lang, b"\n".join(held.pop(lang)), 0
            size[lang] = 0
        held.setdefault(lang, []).append(data)
        size[lang] = size.get(lang, 0) + len(data) + 1
    for lang, those in held.items():
        yield lang, b"\n".join(those), 0


class _Runs:
    """Words of a chunk and hashes of their runs; a run lies within a piece and ends after the words to skip."""

    def __init__(self, lang: str, data: bytes, skip: int, which: int = 0):
        b = np.frombuffer(data, dtype=np.uint8)
        kind = _CLASS[b]
        edge = np.diff(np.concatenate(([True], kind > 0, [True])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(b) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[which][b] * up[: len(b)])))
        self.words = mix((sums[self.end] - sums[self.start]) * down[self.start], 0xD6E8FEB86659FD93)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] if len(self.start) else self.start
        self.skip, self.seed = skip, np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), which))
        self.hashes = [mix(self.words ^ self.seed, 0xD6E8FEB86659FD93)]

    def of(self, k: int) -> np.ndarray:
        """Hash of the run of k words from each word on; those that leave the piece hold anything."""
        while len(self.hashes) < k:
            j, last = len(self.hashes), self.hashes[-1]
            self.hashes.append(mix(last[: max(0, len(self.words) - j)] * _STEP + self.words[j:], 0xC2B2AE3D27D4EB4F))
        return self.hashes[k - 1]

    def fits(self, k: int) -> np.ndarray:
        n = max(0, len(self.words) - k + 1)
        out = self.piece[:n] == self.piece[k - 1 :] if n else np.zeros(0, bool)
        out[: max(0, self.skip - k + 1)] = False  # all of it was read before
        return out


def _may(runs: _Runs, k: int, filters: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Runs of k words that may be frequent: within a piece, and no part that the filters (of 1, 2 and 3 or more words) know is rare."""
    ok = runs.fits(k)
    n = len(ok)
    for j in range(1, k + 1):
        if n and (f := min(j, 3) - 1) < len(filters):
            bits, width = filters[f]
            known = has(bits, (runs.of(j) >> np.uint64(64 - width)).astype(np.int64))
            for a in range(k - j + 1):
                ok &= known[a : a + n]
    return ok


# ---- what may be frequent ----------------------------------------------------------------------------------------------------


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return with_path(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def _filter(texts: DataFrame, sizes: range, filters: list, least: int) -> tuple[np.ndarray, int, int]:
    """(bits, log2 of their number, keys): a filter of the hashes of runs of `sizes` words that come `least` times or more."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, given = 3 * parts, spark.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = given.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            return key[at], np.minimum(np.add.reduceat(n, at), least).astype(np.uint32) if len(at) else n

        def flush(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            bucket = (key * np.uint64(buckets)) >> np.uint64(KEY)
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            blobs = [pack([key[a:b], n[a:b]]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(key)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        size = 0
        for b in batches:
            for lang, data, skip in _chunks(b):
                runs = _Runs(lang, data, skip)
                for k in sizes:
                    key, n = np.unique(runs.of(k)[_may(runs, k, filters)] >> np.uint64(64 - KEY), return_counts=True)
                    held.append((key, n.astype(np.uint32)))
                    size += len(key)
                if size > FLUSH_KEYS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > FLUSH_KEYS // 2:
                        yield flush(*held[0])
                        held, size = [], 0
        if held:
            key, n = summed()
            if len(key):
                yield flush(key, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return key[at], np.minimum(np.add.reduceat(n, at), least).astype(np.uint32)

        def done() -> pa.RecordBatch:
            key, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least].astype(np.int64))], ["key"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now:
                    if held:
                        yield done()
                    now, held, size = bucket, [], 0
                held.append(tuple(unpack(blob.as_py(), ["u4"])))
                size += len(held[-1][0])
                if size > 2 * FLUSH_KEYS:
                    held = [summed()]
                    size = len(held[0][0])
        if held:
            yield done()

    dealt = texts.mapInArrow(count, "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    keys = cut(with_path(dealt).mapInArrow(add, "key long"))
    n = keys.count()
    width = min(MOST_BITS, max(1 << 15, 1 << int(16 * n).bit_length())).bit_length() - 1
    bits = bits_of(keys, 1 << width, lambda b: b.column(0).to_numpy() >> (KEY - width))
    return bits, width, n


# ---- phrases -----------------------------------------------------------------------------------------------------------------


def _range(word: bytes, ranges: int) -> int:
    return (xxhash.xxh64_intdigest(word) * ranges) >> 64


def _shards(texts: DataFrame, filters: list, longest: int, ranges: int, salts: int) -> DataFrame:
    """(lang, part, salt, words, blob): a count transducer for each range of the first word; part -1 has the number of words."""
    given = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, salt = given.value, TaskContext.get().partitionId() % salts
        total: dict[str, int] = {}
        found: dict[str, dict[bytes, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, phrases in found.items():
                dealt: dict[int, list] = {}
                for p, n in phrases.items():
                    words = tuple(p.split(b" "))
                    dealt.setdefault(_range(words[0], ranges), []).append((words, n))
                for part, entries in dealt.items():
                    yield _row(lang, part, salt, 0, CountTransducer.build(sorted(entries)).to_bytes())
            found.clear()

        for b in batches:
            for lang, data, skip in _chunks(b):
                runs, other = _Runs(lang, data, skip), _Runs(lang, data, skip, 1)
                total[lang] = total.get(lang, 0) + max(0, len(runs.words) - skip)
                mine = found.setdefault(lang, {})
                for k in range(1, longest + 1):
                    at = np.flatnonzero(_may(runs, k, filters))
                    if not len(at):
                        continue
                    h1, h2 = runs.of(k)[at], other.of(k)[at]
                    order = np.lexsort((h2, h1))
                    h1, h2 = h1[order], h2[order]
                    first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
                    n = np.diff(np.concatenate((first, [len(h1)])))
                    where = at[order[first]]
                    for a, z, c in zip(runs.start[where].tolist(), runs.end[where + k - 1].tolist(), n.tolist()):
                        p = data[a:z]
                        if k > 1:
                            p = b" ".join(p.split())
                        mine[p] = mine.get(p, 0) + c
            if sum(map(len, found.values())) > FLUSH_PHRASES:
                yield from flush()
        yield from flush()
        for lang, n in total.items():
            yield _row(lang, -1, salt, n, None)

    return texts.mapInArrow(run, "lang string, part int, salt int, words long, blob binary")


def _row(lang: str, part: int, salt: int, words: int, blob: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([words], pa.int64()), pa.array([blob], pa.binary())], ["lang", "part", "salt", "words", "blob"])


def _united(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, CountTransducer]]:
    """Transducers of rows in order of keys, united 32 at a time."""
    now, held = None, []
    for b in batches:
        for *key, blob in zip(*(b.column(k).to_pylist() for k in keys), b.column("blob").to_pylist()):
            if tuple(key) != now:
                if held:
                    yield now, CountTransducer.union(held)
                now, held = tuple(key), []
            held.append(CountTransducer.from_bytes(blob))
            if len(held) == 32:
                held = [CountTransducer.union(held)]
    if held:
        yield now, CountTransducer.union(held)


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best `top` phrases (all if None), by score, a (both descending) and phrase."""
    spark = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filters: list[tuple[np.ndarray, int]] = []
    keys = 0
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        bits, width, n = _filter(texts, sizes, filters, least)
        filters.append((bits, width))
        keys += n
    ranges = max(parts, -(-keys // 20_000))
    salts = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    shards = cut(_shards(texts, filters, longest, ranges, salts))
    total = shards.where("part < 0").groupBy("lang").agg(F.sum("words").alias("n"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part, salt), t in _united(batches, ["lang", "part", "salt"]):
            yield _row(lang, part, salt, 0, t.to_bytes())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _), t in _united(batches, ["lang", "part"]):
            rows = []
            for words, n in t.items():
                if n >= least:
                    counts, longer = t.walk(words)
                    rows.append({"lang": lang, "phrase": b" ".join(words), "firsts": counts, "longer": longer, "last": _range(words[-1], ranges)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("firsts", pa.list_(pa.int64())), ("longer", pa.bool_()), ("last", pa.int32())]))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            ends = [tuple(reversed(r["phrase"].split(b" "))) for r in held]
            t = CountTransducer.build(sorted((w, r["firsts"][-1]) for w, r in zip(ends, held)))
            rows = []
            for w, r in zip(ends, held):
                if len(w) > 1:
                    counts, longer = t.walk(w)
                    if not (longer or r["longer"]):
                        rows.append({"lang": r["lang"], "phrase": r["phrase"].decode(), "a": r["firsts"][-1], "firsts": r["firsts"][:-1], "rests": counts[-2::-1]})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("firsts", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))]))

        for b in batches:
            for r in b.to_pylist():
                if (r["lang"], r["last"]) != now:
                    if held:
                        yield done()
                    now, held = (r["lang"], r["last"]), []
                held.append(r)
        if held:
            yield done()

    packed = "lang string, part int, salt int, words long, blob binary"
    once = with_path(shards.where("part >= 0").repartition(parts, "lang", "part", "salt").sortWithinPartitions("lang", "part", "salt")).mapInArrow(unite, packed)
    fronts = with_path(once.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part")).mapInArrow(walk, "lang string, phrase binary, firsts array<long>, longer boolean, last int")
    both = with_path(fronts.repartition(parts, "lang", "last").sortWithinPartitions("lang", "last")).mapInArrow(back, "lang string, phrase string, a long, firsts array<long>, rests array<long>")
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = f"array_min(transform(firsts, (l, i) -> named_struct('score', CAST((CAST(1000 AS DECIMAL(4, 0)) * {big('a')} * {big('n')}) DIV ({big('l')} * {big('rests[i]')}) AS BIGINT), 'k', i, 'l', l, 'r', rests[i])))"
    scored = both.join(total, "lang").withColumn("c", F.expr(cuts)).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = "ORDER BY score DESC, a DESC, phrase"
    if top is not None:  # a language may hold most phrases, so its best are taken in parts first
        scored = scored.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {parts}) {order})")).where(F.col("rank") <= top).drop("rank")
    out = scored.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int, longest: int, top: int) -> str:
    """The query's rows over the table documents, for DuckDB: all runs of words counted as text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM w, range(1, {longest + 1}) ks(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, k, phrase, a, j AS cut, array_to_string(g[1:j], ' ') AS p1, array_to_string(g[j + 1:], ' ') AS p2 FROM f, range(1, {longest}) j(j) WHERE j < k),
c AS (SELECT x.lang, x.phrase, x.a, y.a AS l, z.a AS r, n.n, (1000::HUGEINT * x.a * n.n) // (y.a::HUGEINT * z.a) AS score, cut
  FROM x JOIN n ON n.lang = x.lang JOIN f y ON y.lang = x.lang AND y.phrase = x.p1 JOIN f z ON z.lang = x.lang AND z.phrase = x.p2),
s AS (SELECT lang, phrase, a, n, arg_min({{'l': l, 'r': r, 'score': score}}, {{'score': score, 'cut': cut}}) AS b FROM c GROUP BY lang, phrase, a, n),
i AS (SELECT DISTINCT lang, a, array_to_string(g[b:b + m - 1], ' ') AS phrase FROM f, range(2, {longest}) ms(m), range(1, {longest}) bs(b) WHERE m < k AND b + m - 1 <= k),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = s.lang AND i.phrase = s.phrase AND i.a = s.a)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY (b).score DESC, a DESC, phrase) AS rank, phrase, a, (b).l AS l, (b).r AS r, n, (b).score::BIGINT AS score FROM o)
SELECT * FROM q WHERE rank <= {top}"""
