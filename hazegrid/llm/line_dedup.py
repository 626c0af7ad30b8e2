"""Line dedup by an exact set-similarity join (operator 2).

A line is the set of its words (between ASCII white space, A-Z lower-cased). Words are put in one global order by rarity;
two sets with Jaccard similarity of at least `threshold` then share a word in their prefixes of |x| - ceil(t|x|) + 1 words.
Prefix words are shuffled; lines that meet on one pass the length filter, the positional filter and a parity sketch (whose
bits cannot differ in more places than the sets do), and what is left is verified on the words themselves. A line is removed
if any earlier line, in order of (document id, line number), is similar to it.

Rarity comes from a table of `buckets` counts over all words of all documents; it fixes only the order, so words that share a
bucket cost time and lose nothing. A word that more than `limit` lines have in their prefixes is split: sets that share k words
also share them in prefixes of k - 1 more words, so its lines are dealt again by two words, then by three, and lists that are
still longer by pairs of blocks. No list in a task is longer than about twice the limit, and no pair is lost.

Each line is verified against its closest earlier candidates first, one a list; a line that this leaves open, and that has
others, against all of them.

Lines with fewer than `min_words` different words (blank ones too) are kept and remove nothing, as are lines with fewer than
`short[0]` different words that also have fewer than `short[1]` bytes. A null text has no lines and stays null; a row without
an id is left as it is. Rows that repeat a document id are one document with equal line numbers; an exact repeat of a line at
an equal place counts once. A text of any length is read whole, about a megabyte at a time. An empty table gives an empty
result. Other columns are kept by `dedup_lines`, whatever their names, and ignored by the rest.

Sets are found equal by two 64-bit sums over 48-bit word hashes, and a pair of one size with equal 128-bit sketches and 32-bit
tags is taken for such: at these widths an error is to be expected once in about 10**10 nearly equal pairs. All other links
are verified on the words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import KEY, bits_of, deal, gather, has, pack, placed, room, unpack
from .common import cut, lower_ascii, map_rows, shared_dir, with_path
from .words import mix, word_hashes

#: A word's number is 6 bits of rarity and 48 of its hash; a line within a piece of work takes the 10 bits above. Of the hash, 40 bits are its key.
_HASH, _LINES = 48, 10
#: Words stored beyond the prefix, for lists that are split.
_MORE = 2
_POSTING = ["u4", "u4", "u4", "i8", "u4", "u4", "u8", "u8"]


class Lines:
    """Sets of words of lines, of one text or several joined by newlines."""

    def __init__(self, rarity: np.ndarray, threshold: float, min_words: int, short: tuple[int, int] = (0, 0)):
        self.rarity, self.t, self.min, self.short = rarity.astype(np.uint64) << np.uint64(_HASH), threshold, min_words, short
        self.shift = np.uint64(65 - len(rarity).bit_length())

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(line, word number) of the distinct words of each line, rarest first."""
        line, h = word_hashes(data)
        number = self.rarity[h >> self.shift] | (h >> np.uint64(64 - _HASH))
        out_line, out, at = [], [], 0
        while at < len(line):
            first = line[at]
            to = int(np.searchsorted(line, first + (1 << _LINES)))
            key = np.sort(((line[at:to] - first).astype(np.uint64) << np.uint64(64 - _LINES)) | number[at:to])
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            out_line.append((key >> np.uint64(64 - _LINES)).astype(np.int64) + first)
            out.append(key & np.uint64((1 << (64 - _LINES)) - 1))
            at = to
        return (np.concatenate(out_line), np.concatenate(out)) if out else (line, number)

    def sets(self, data: bytes) -> dict[str, np.ndarray]:
        """Per line that takes part: line, start and size in `number`, two set hashes and the parity sketch of 128 bits."""
        line, number = self.words(data)
        start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((start, [len(line)])))
        if not len(start):
            return {"line": start, "start": start, "size": size, "a": number, "b": number, "sketch": number, "sketch2": number, "number": number}
        h = mix(number & np.uint64((1 << _HASH) - 1), 0xFF51AFD7ED558CCD)
        a, b = np.add.reduceat(h, start), np.add.reduceat(mix(h, 0xC4CEB9FE1A85EC53), start)
        bit = np.uint64(1) << (h >> np.uint64(58))
        half = (h & np.uint64(1)) == 1
        sketch, sketch2 = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), start) for x in (half, ~half))
        keep = size >= self.min
        if self.short[1]:
            ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
            length = np.diff(np.concatenate(([-1], ends, [len(data)]))) - 1
            keep &= (size >= self.short[0]) | (length[line[start]] >= self.short[1])
        return {"line": line[start][keep], "start": start[keep], "size": size[keep], "a": mix(a ^ size.astype(np.uint64), 0x9FB21C651E98DF25)[keep], "b": b[keep], "sketch": sketch[keep], "sketch2": sketch2[keep], "number": number}


def _reach(size: np.ndarray, t: float) -> np.ndarray:
    """Length of the prefixes of sets; 0 for those so small that only an equal set is similar."""
    length = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
    length[np.ceil(t * (size + 1) - 1e-9) > size] = 0
    return length


def _blocks(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts joined by newlines, about `size` bytes together: (row, first line) of each text, and the bytes."""
    rows, firsts, parts, total, lines = [], [], [], 0, 0
    for i, x in enumerate(b.column(1)):
        text = x.as_py()
        if text is None:
            continue
        data = lower_ascii(text)
        rows.append(i)
        firsts.append(lines)
        parts.append(data)
        total += len(data)
        lines += data.count(b"\n") + 1
        if total >= size:
            yield np.array(rows), np.array(firsts), b"\n".join(parts)
            rows, firsts, parts, total, lines = [], [], [], 0, 0
    if rows:
        yield np.array(rows), np.array(firsts), b"\n".join(parts)


def rarities(plain: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket of words its class of rarity, 0 (rarest) to 63, half an octave each, from counts over all texts. `buckets` numbers reach the driver."""
    shift, chunk = np.uint64(65 - buckets.bit_length()), min(buckets, 4096)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(buckets, dtype=np.uint64), [], 0

        def add() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=buckets).astype(np.uint64)

        for b in batches:
            for _, _, data in _blocks(b):
                held.append((word_hashes(data)[1] >> shift).astype(np.int32))
                n += len(held[-1])
                if n > 1 << 21:
                    add()
                    held, n = [], 0
        add()
        used = [i for i in range(0, buckets, chunk) if total[i : i + chunk].any()]
        if used:
            at = np.arange(chunk, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([pack([at, total[i : i + chunk]]) for i in used], pa.binary())], ["at", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpack(x, ["u8"])[1] for x in t["n"].to_pylist())
        return pa.table({"at": t["at"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(buckets, dtype=np.uint64)
    for r in with_path(plain).mapInArrow(count, "at long, n binary").groupBy("at").applyInArrow(add, "at long, n binary").collect():
        total[r["at"] : r["at"] + chunk] = np.frombuffer(r["n"], dtype=np.uint64)
    return np.minimum(63, 2 * np.log2(np.maximum(1, total).astype(np.float64))).astype(np.uint8)


def _line_table(plain: DataFrame, rarity, threshold: float, min_words: int, short: tuple[int, int]) -> DataFrame:
    """Every line that takes part: id, line, two set hashes, sketch, size, prefix length, and the keys of its first words, 5 bytes each. Written once, read by all later steps."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, out, words = b.column(0).to_numpy(zero_copy_only=False), [], []
        work = Lines(rarity.value, threshold, min_words, short)
        for rows, firsts, data in _blocks(b):
            s = work.sets(data)
            of = np.searchsorted(firsts, s["line"], side="right") - 1
            n = _reach(s["size"], threshold)
            out.append((ids[rows[of]], s["line"] - firsts[of], *[s[k].view(np.int64) for k in ("a", "b", "sketch", "sketch2")], s["size"], n))
            stored = np.where(n > 0, np.minimum(n + _MORE, s["size"]), 0)
            row = np.repeat(np.arange(len(n)), stored)
            ends = np.cumsum(stored)
            key = (s["number"][s["start"][row] + np.arange(len(row)) - np.repeat(ends - stored, stored)] & np.uint64((1 << _HASH) - 1)) >> np.uint64(_HASH - KEY)
            flat = key.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            words += [flat[5 * x : 5 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())] if len(ends) else []
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 8
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(words, pa.binary())], ["id", "line", "a", "b", "sketch", "sketch2", "size", "n", "words"])

    spark = plain.sparkSession
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    map_rows(plain, run, "id long, line long, a long, b long, sketch long, sketch2 long, size long, n long, words binary").write.parquet(at)
    return spark.read.parquet(at)


def _keys(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _prefixes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, key) of the prefix words of rows, of the earliest row of each set in the batch."""
    ids, line, a, n = _numbers(b, "id", "line", "a", "n")
    order = np.lexsort((line, ids))
    _, once = np.unique(a[order], return_index=True)
    once = order[once]
    once = once[n[once] > 0]
    parts = b.column(b.schema.get_field_index("words"))
    n = n[once]
    row = np.repeat(once, n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), _keys([parts[i].as_py()[: 5 * k] for i, k in zip(once.tolist(), n.tolist())])


def _posting(b: pa.RecordBatch, row: np.ndarray, position: np.ndarray, key: np.ndarray, side: np.ndarray | None = None) -> list[np.ndarray]:
    ids, line, a, size, one, two = (c[row] for c in _numbers(b, "id", "line", "a", "size", "sketch", "sketch2"))
    return [key, size, position, np.zeros(len(row)) if side is None else side, ids, line, (a & 0xFFFFFFFF), one.view(np.uint64), two.view(np.uint64)]


class _Lists:
    """Lists of lines by key, sizes ascending in each; of equal sets at one place the earliest line. `cols` are emptied."""

    def __init__(self, cols: list[np.ndarray], depth: int, t: float):
        key, size, position, side, ids, line, tag, one, two = cols
        order = np.lexsort((line, ids, tag, two, one, side, position, size, key))
        fresh = np.zeros(max(0, len(order) - 1), dtype=bool)
        for c in (key, size, position, side, one, two, tag):
            c = c[order]
            fresh |= c[1:] != c[:-1]
        order = order[np.concatenate(([True], fresh))[: len(order)]]
        del key, size, position, side, ids, line, tag, one, two, c
        self.key, self.size, self.position, self.side, self.id, self.line, self.tag, self.one, self.two = placed(cols, order)
        cols.clear()
        self.size, self.position, self.line = (c.astype(np.int64) for c in (self.size, self.position, self.line))
        self.depth, self.t = depth, t

    def only(self, keep: np.ndarray) -> None:
        for name in ("key", "size", "position", "side", "id", "line", "tag", "one", "two"):
            setattr(self, name, getattr(self, name)[keep])

    def longer(self, limit: int) -> np.ndarray:
        """Places of lists of more than `limit` lines."""
        start = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((start, [len(self.key)])))
        return np.repeat(n > limit, n)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(later, earlier, bits apart) of the pairs of one list that pass all filters."""
        n, at, gap, t = len(self.key), np.arange(len(self.key)), 0, self.t
        while len(at):
            gap += 1
            at = at[at + gap < n]
            # sizes ascend, so no later place fits where this one does not
            at = at[(self.key[at] == self.key[at + gap]) & (self.size[at] >= np.ceil(t * self.size[at + gap] - 1e-9))]
            i, j = at, at + gap
            both = self.size[i] + self.size[j]
            least = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
            ok = (np.minimum(self.size[i] - self.position[i], self.size[j] - self.position[j]) + self.depth - 1 >= least) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
            i, j, most = i[ok], j[ok], (both - 2 * least)[ok]
            apart = np.bitwise_count(self.one[i] ^ self.one[j]).astype(np.int64) + np.bitwise_count(self.two[i] ^ self.two[j])
            same = (apart == 0) & (self.tag[i] == self.tag[j]) & (self.size[i] == self.size[j])
            ok = (apart <= most) & ~same
            if ok.any():
                i, j, apart = i[ok], j[ok], apart[ok]
                swap = (self.id[i] > self.id[j]) | ((self.id[i] == self.id[j]) & (self.line[i] > self.line[j]))
                yield np.where(swap, i, j), np.where(swap, j, i), apart


_FOUND = "xi long, xl long, apart long, yi long, yl long, more boolean"


def _search(batches: Iterator[pa.RecordBatch], t: float, depth: int, limit: int, wanted) -> Iterator[pa.RecordBatch]:
    """For each line of each list its closest earlier candidate and whether there are more; of lines that `wanted` marks, all of them.
    Lists over the limit come back as (id, line, -1, key, position)."""

    def out(xi, xl, apart, yi, yl, more) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(c).astype(np.int64)) for c in (xi, xl, apart, yi, yl)), pa.array(np.asarray(more, dtype=bool))], ["xi", "xl", "apart", "yi", "yl", "more"])

    spilt: list[pa.RecordBatch] = []
    known: set[int] = set()

    def hot(cols: list[np.ndarray]) -> list[np.ndarray]:
        key, n = np.unique(cols[0], return_counts=True)
        known.update(key[n > limit].tolist())
        mine = np.isin(cols[0], np.fromiter(known, np.uint64, len(known)))
        spilt.append(out(cols[4][mine], cols[5][mine], np.full(mine.sum(), -1), cols[0][mine].view(np.int64), cols[2][mine], np.zeros(mine.sum())))
        return [c[~mine] for c in cols]

    for cols in gather(batches, _POSTING, hot=hot if limit else None):
        if known:
            cols = hot(cols)
        yield from spilt
        spilt.clear()
        p = _Lists(cols, depth, t)
        if limit and (far := p.longer(limit)).any():
            yield out(p.id[far], p.line[far], np.full(far.sum(), -1), p.key[far].view(np.int64), p.position[far], np.zeros(far.sum()))
            p.only(~far)
        n = len(p.key)
        best, who, count = np.full(n, 1 << 30), np.full(n, -1), np.zeros(n, dtype=np.int64)
        mine = None if wanted is None else wanted(p.id, p.line)
        for late, early, apart in p.pairs():
            if mine is not None:
                x, y = late[mine[late]], early[mine[late]]
                if len(x):
                    yield out(p.id[x], p.line[x], np.zeros(len(x)), p.id[y], p.line[y], np.zeros(len(x)))
                continue
            # a line is the later one of at most two pairs of one distance between places
            for part in (late == np.minimum(late, early), late > early):
                x, y, d = late[part], early[part], apart[part]
                count[x] += 1
                closer = d < best[x]
                best[x[closer]], who[x[closer]] = d[closer], y[closer]
        x = np.flatnonzero(who >= 0)
        if len(x):
            y = who[x]
            yield out(p.id[x], p.line[x], best[x], p.id[y], p.line[y], count[x] > 1)


def _place(ids: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.int64).view(np.uint64), 0xA0761D6478BD642F) & np.uint64(bits - 1)).astype(np.int64)


def _key_place(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.astype(np.uint64), 0xA0761D6478BD642F) & np.uint64(bits - 1)).astype(np.int64)


def _next_key(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix((key << np.uint64(20)) ^ mix(more, 0xA0761D6478BD642F), 0xD6E8FEB86659FD93) >> np.uint64(64 - KEY)


def _candidates(every: DataFrame, t: float, limit: int, only=None, wanted=None) -> DataFrame:
    """Candidates of all lists; `only(keys)` may leave keys out, and `wanted(ids, lines)` marks the lines that want all of theirs."""
    total = every.agg(F.sum("n")).first()[0] or 0

    def first(b: pa.RecordBatch) -> list[np.ndarray]:
        row, position, key = _prefixes(b)
        if only is not None:
            keep = only(key)
            row, position, key = row[keep], position[keep], key[keep]
        return _posting(b, row, position, key)

    def found(dealt: DataFrame, depth: int, limit: int) -> DataFrame:
        return cut(dealt.mapInArrow(lambda it: _search(it, t, depth, limit, wanted), _FOUND))

    lines = every.where("n > 0").select("id", "line", "a", "n", "words", "sketch", "sketch2", "size")
    out = found(deal(lines, first, _POSTING, total), 1, limit)
    parts, depth = [out.where("apart >= 0")], 1
    hot = out.where("apart < 0")
    # below 0.7 some sets have too few words for lists of three
    while not hot.isEmpty():
        hot = hot.select(F.col("xi").alias("id"), F.col("xl").alias("line"), F.col("yi").alias("key"), F.col("yl").alias("position")).distinct()
        if depth <= _MORE and t >= 0.7:
            depth += 1

            def longer(b: pa.RecordBatch, depth=depth) -> list[np.ndarray]:
                n, key, position = _numbers(b, "n", "key", "position")
                parts = b.column(b.schema.get_field_index("words")).to_pylist()
                have = np.minimum(n + depth - 1, np.array([len(p) // 5 for p in parts], dtype=np.int64))
                more = np.maximum(0, have - position - 1)
                row = np.repeat(np.arange(len(n)), more)
                at = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more) + position[row] + 1
                begin = np.cumsum([0, *[len(p) // 5 for p in parts[:-1]]])
                return _posting(b, row, at, _next_key(key[row].view(np.uint64), _keys(parts)[begin[row] + at]))

            out = found(deal(hot.join(lines, ["id", "line"]), longer, _POSTING, total), depth, limit)
            parts.append(out.where("apart >= 0"))
            hot = out.where("apart < 0")
            continue
        # pairs of blocks of about `limit` lines
        blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit)).cast("long").alias("blocks"))
        dealt = hot.join(blocks, "key").withColumn("k", F.pmod(F.xxhash64("id", "line"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(lines, ["id", "line"])

        def paired(b: pa.RecordBatch) -> list[np.ndarray]:
            key, position, k, other = _numbers(b, "key", "position", "k", "other")
            pair = np.minimum(k, other).view(np.uint64) * np.uint64(1 << 24) + np.maximum(k, other).view(np.uint64) + np.uint64(1)
            return _posting(b, np.arange(len(key)), position, _next_key(key.view(np.uint64), pair), np.where(k == other, 0, np.where(k < other, 1, 2)))

        parts.append(found(deal(dealt, paired, _POSTING, total), depth, 0))
        break
    for x in parts[1:]:
        parts[0] = parts[0].unionAll(x)
    return parts[0]


def similar_lines(docs: DataFrame, *, threshold: float = 0.8, min_words: int = 5, short: tuple[int, int] = (0, 0), buckets: int = 1 << 20, limit: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to remove: (id, line), the line counted from 0. `limit` is the longest list that one task compares as it is."""
    share = docs.sparkSession.sparkContext.broadcast
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null and text is not null")
    rarity = share(rarities(plain, buckets))
    every = _line_table(plain, rarity, threshold, min_words, short)
    met = _candidates(every, threshold, limit)
    tries = cut(met.groupBy("xi", "xl").agg(F.collect_set(F.struct("yi", "yl")).alias("ys"), F.max("more").alias("more")))
    tried = tries.select("xi", "xl", F.explode("ys").alias("y")).select("xi", "xl", "y.yi", "y.yl")
    late = cut(_verified(tried, plain, threshold))
    undecided = cut(tries.where("more").select("xi", "xl").join(late, ["xi", "xl"], "left_anti"))
    n = undecided.count()
    if n:
        bits = room(n)
        marked = share(bits_of(undecided, bits, lambda b: _place(*_numbers(b, "xi", "xl"), bits)))
        mine = every.join(undecided.select(F.col("xi").alias("id"), F.col("xl").alias("line")), ["id", "line"], "left_semi")
        wide = room(8 * n)
        keys = share(bits_of(mine, wide, lambda b: _key_place(_prefixes(b)[2], wide)))
        more = _candidates(every, threshold, limit, lambda k: has(keys.value, _key_place(k, wide)), lambda i, k: has(marked.value, _place(i, k, bits)))
        more = cut(more.select("xi", "xl", "yi", "yl").distinct().join(undecided, ["xi", "xl"], "left_semi").join(tried, ["xi", "xl", "yi", "yl"], "left_anti"))
        late = late.unionAll(_verified(more, plain, threshold)).distinct()
    firsts = every.groupBy("a", "b").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.select("a", "b", "n", "first", F.col("first.id").alias("xi"), F.col("first.line").alias("xl")).join(late.withColumn("late", F.lit(True)), ["xi", "xl"], "left")
    state = firsts.where("n > 1 or late").select("a", "b", "first", "late")
    gone = every.select("id", "line", "a", "b").join(state, ["a", "b"]).where(F.coalesce("late", F.lit(False)) | (F.struct("id", "line") > F.col("first")))
    return gone.select("id", "line").distinct()


def _verified(pairs: DataFrame, plain: DataFrame, threshold: float) -> DataFrame:
    """(xi, xl) of the pairs (xi, xl, yi, yl) of lines whose words have the similarity."""
    used = pairs.select(F.explode(F.array(F.struct(F.col("xi").alias("id"), F.col("xl").alias("line")), F.struct(F.col("yi").alias("id"), F.col("yl").alias("line")))).alias("c")).select("c.*")
    bits = room(2 * pairs.count())
    shared = plain.sparkSession.sparkContext.broadcast(bits_of(used, bits, lambda b: _place(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)))

    def texts(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, all_texts, out = b.column(0).to_numpy(), b.column(1).to_pylist(), []
        n = np.fromiter((x.count("\n") + 1 for x in all_texts), np.int64, len(all_texts))
        doc = np.repeat(np.arange(len(n)), n)
        line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(has(shared.value, _place(ids[doc], line, bits)))
        now, lines = -1, []
        for i, k in zip(doc[hit].tolist(), line[hit].tolist()):
            if i != now:
                now, lines = i, all_texts[i].split("\n")
            out.append(b" ".join(sorted(set(lower_ascii(lines[k]).split()))))
        return pa.RecordBatch.from_arrays([pa.array(ids[doc[hit]], pa.int64()), pa.array(line[hit], pa.int64()), pa.array(out, pa.binary())], ["id", "line", "t"])

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            p, q = set(p.split(b" ")), set(q.split(b" "))
            both = len(p & q)
            keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["xi", "xl"])

    found = map_rows(plain, texts, "id long, line long, t binary")
    side = lambda k: found.select(F.col("id").alias(f"{k}i"), F.col("line").alias(f"{k}l"), F.col("t").alias(f"{k}t"))
    joined = pairs.join(side("x"), ["xi", "xl"]).join(side("y"), ["yi", "yl"]).select("xi", "xl", "xt", "yt")
    return map_rows(joined, check, "xi long, xl long").distinct()


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, n_lines, n_removed, removed (line numbers from 0, ascending, joined by commas)."""
    gone = similar_lines(docs, id_col=id_col, text_col=text_col, **options).groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    text = F.col(text_col)
    all_docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = all_docs.join(gone, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with the similar later lines taken out of their texts."""
    gone = similar_lines(docs, id_col=id_col, text_col=text_col, **options).groupBy("id").agg(F.collect_list("line").alias("lines"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).join(gone, "id", "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, lines in zip(b.column(1), b.column(2)):
            text, drop = text.as_py(), set(lines.as_py() or ())
            texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=pa.schema([b.schema.field(0), pa.field("text", pa.string())]))

    kind = whole.select("row").schema
    out = map_rows(whole.select("row", "text", "lines"), run, type(kind)([*kind.fields]).add("text", "string"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def oracle(threshold: float = 0.8, min_words: int = 1) -> str:
    """The query's rows over the table documents, for DuckDB."""
    return f"""
WITH docs AS (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM docs WHERE l IS NOT NULL),
sets AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) AS s FROM lines),
big AS (SELECT * FROM sets WHERE len(s) >= {min_words}),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, len(s) AS n, min(row(doc_id, line)) AS first FROM big GROUP BY s),
words AS MATERIALIZED (SELECT c, n, first, unnest(s) AS w FROM classes),
rank AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY count(*), w) AS r FROM words GROUP BY w),
placed AS (SELECT c, n, first, r, row_number() OVER (PARTITION BY c ORDER BY r) AS p FROM words JOIN rank USING (w)),
pre AS MATERIALIZED (SELECT * FROM placed WHERE p <= n - ceil({threshold} * n - 1e-9) + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.c AS late, y.c AS early FROM pre x JOIN pre y ON x.r = y.r AND y.first < x.first AND least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9),
late AS (SELECT DISTINCT late FROM cand JOIN classes x ON x.c = late JOIN classes y ON y.c = early WHERE len(list_intersect(x.s, y.s)) >= {threshold} * (x.n + y.n - len(list_intersect(x.s, y.s))) - 1e-9),
gone AS (SELECT DISTINCT b.doc_id, b.line FROM big b JOIN classes k ON k.s = b.s WHERE k.c IN (SELECT late FROM late) OR row(b.doc_id, b.line) > k.first)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS removed
FROM docs d LEFT JOIN gone g USING (doc_id) GROUP BY ALL"""
