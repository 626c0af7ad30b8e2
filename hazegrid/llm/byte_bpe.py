"""Byte-level BPE encoding and decoding (operator 10).

A sentencepiece BPE model is serialised directly from a byte-level vocabulary: each token's bytes become a piece of one
character a byte, its score is its negative rank, and the normaliser is the identity. Pre-tokens are encoded by that
model; ids are decoded by the inverse mapping.

Nulls are empty texts: no tokens, and the hashes of nothing. Ties do not arise, as each rank is unique; equal texts give
equal rows. Other columns of the input are ignored by `encode_documents`, so clashing names do no harm, and an empty table
gives an empty result. Texts of any length are encoded whole; their pre-tokens are held together, some 100 bytes each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from .common import map_rows

#: Byte b is written as the character FIRST + b; none of these is white space or changed by sentencepiece.
FIRST = 0x4E00
#: Pre-tokens kept in each of a Python worker's two cache generations; the cache only saves work.
CACHE = 150_000
_TO_CHARS = {b: chr(FIRST + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 of the token's bytes, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def build_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece, so a token's id is its place in rank order plus 1."""
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(ranks) + 1
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    m.trainer_spec.split_by_whitespace = False
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    p = m.pieces.add()
    p.piece, p.score, p.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        p = m.pieces.add()
        p.piece, p.score = chars(token), -float(rank)
    return m.SerializeToString()


class Codec:
    """Encodes and decodes with the model; holds a bounded cache of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.whole = {chars(t): r for t, r in order}
        self.by_place = np.array([r for _, r in order], dtype=np.uint32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(ranks))
        self.find = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for t, r in order:
            self.lengths[r] = len(t)
        self.starts = np.zeros(size, dtype=np.int64)
        self.starts[1:] = np.cumsum(self.lengths)[:-1]
        by_rank = dict((r, t) for t, r in order)
        self.bytes = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(size)), dtype=np.uint8)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Encodes tokens that are not in the cache, all in one call of the model."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new = []
        for t in tokens.difference(self.known):
            if t in self.older:
                self.known[t] = self.older[t]
            else:
                new.append(t)
        mapped = [chars(t.encode()) for t in new]
        for t, m, pieces in zip(new, mapped, self.model.encode(mapped) if mapped else []):
            # a pre-token that is in the vocabulary is that one id, as the vocabulary's library has it
            ids = np.array([self.whole[m]], dtype=np.uint32) if m in self.whole else self.by_place[np.array(pieces, dtype=np.int64) - 1]
            self.known[t] = (ids.tobytes(), " ".join(map(str, ids.tolist())))

    def encode_batch(self, texts: list[str | None], block: int = 1 << 20) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and the same in decimal with one space between; about `block` characters at a time."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (size < block or not part):
                part.append(self.find(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            self._learn(set().union(*part))
            get = self.known.__getitem__
            for tokens in part:
                got = list(map(get, tokens))
                yield np.frombuffer(b"".join([x[0] for x in got]), dtype=np.uint32), " ".join([x[1] for x in got])

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        return next(self.encode_batch([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids by the inverse mapping."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text: id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and decoded text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(path, pattern), []
        for ids, decimal in c.encode_batch(b.column(1).to_pylist()):
            back = c.decode(ids)
            rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), ids.astype(np.int32).tolist() if keep_ids else None, back.decode(errors="replace") if keep_ids else None))
        n, a, d, ids, back = map(list, zip(*rows)) if rows else ([], [], [], [], [])
        out = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            out += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(out, names)

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return map_rows(source, run, schema).withColumnRenamed("id", id_col)
