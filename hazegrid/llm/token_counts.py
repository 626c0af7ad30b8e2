"""Token counts (operator 3): byte-pair merging with a heap and a linked list.

For one stretch of text, adjacent symbols sit in a linked list; a heap holds every adjacent pair whose concatenation is a
piece, by (rank, place). The lowest pair is popped, merged, and its new neighbours pushed, until none is left. The count is
the initial symbols minus the merges; no ids are made. Characters that are no piece count as their UTF-8 bytes.

A null text is an empty one: 0 tokens, 0 bytes. Equal ranks merge from the left. Repeated rows give repeated counts, an
empty table an empty result, and other columns are ignored, whatever their names. Texts of any length are counted whole, one
stretch between spaces at a time; a stretch takes some 200 bytes a character while it is merged.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from .common import map_rows

SPACE = "▁"
#: Stretches kept in each of a Python worker's two cache generations; the cache only saves work.
CACHE = 900_000


def merges(symbols: str, rank: dict[str, float]) -> tuple[int, int]:
    """Number of merges over the symbols, and the further tokens that characters outside the vocabulary make as bytes."""
    n = len(symbols)
    sym: list[str | None] = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = rank.get
    heap = [(r, i, i + 1, s) for i, s in enumerate(map("".join, zip(symbols, symbols[1:]))) if (r := get(s)) is not None]
    heapq.heapify(heap)
    pop, push, done = heapq.heappop, heapq.heappush, 0
    while heap:
        _, left, right, merged = pop(heap)
        a, b = sym[left], sym[right]
        if a is None or b is None or after[left] != right or len(a) + len(b) != len(merged):
            continue
        sym[left], sym[right] = merged, None
        done += 1
        nxt = after[right]
        after[left] = nxt
        if nxt < n:
            before[nxt] = left
            s = merged + sym[nxt]
            if (r := get(s)) is not None:
                push(heap, (r, left, nxt, s))
        prv = before[left]
        if prv >= 0:
            s = sym[prv] + merged
            if (r := get(s)) is not None:
                push(heap, (r, prv, left, s))
    extra = sum(len(c.encode()) - 1 for c in sym if c is not None and len(c) == 1 and c not in rank)
    return done, extra


class Counter(dict):
    """Counts tokens with a sentencepiece BPE model that has identity normalisation."""

    def __init__(self, model: bytes):
        super().__init__()
        m = pb.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models with identity normalisation are counted")
        if not m.trainer_spec.byte_fallback or any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces):
            raise ValueError("only models that fall back to bytes and have no user-defined pieces are counted")
        self.older: dict[str, int] = {}
        self.prefix = SPACE if n.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in m.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL}
        # a merge never joins a space to the character before it, unless a piece does
        inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.parts = re.compile("(?s).+" if inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def __missing__(self, part: str) -> int:
        if part in self.older:
            out = self.older[part]
        else:
            done, extra = merges(part, self.rank)
            out = len(part) - done + extra
        if len(part) < 64:
            self[part] = out
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        return sum(map(self.__getitem__, self.parts(self.prefix + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    with open(path, "rb") as f:
        return Counter(f.read())


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens, over_limit."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        texts = [x.as_py() or "" for x in b.column(1)]
        n = [c.count(t) for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_rows(source, run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
