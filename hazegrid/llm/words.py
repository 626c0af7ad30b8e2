"""Hashes of words in bulk: between ASCII white space (0x20, 0x09-0x0D), of lower-cased UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time; words as long as this get another hash.
PIECE = 1 << 20
_gap = re.compile(rb"[ \t\n\r\x0b\x0c]")
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x, dtype=np.uint64)))) for x in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def _bulk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[b] * up[: len(b)])))
    line = np.cumsum(b == 10)[start] if len(start) else start
    return line, mix((sums[end] - sums[start]) * down[start], 0xD6E8FEB86659FD93)


def pieces(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of at most `size` bytes that cut no word; a longer word is a piece of its own."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + size)
        if to < n and not _SPACE[data[to]]:
            back = max(data.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back >= 0:
                to = back + 1
            else:
                gap = _gap.search(data, to)
                to = gap.start() if gap else n
        yield at, to
        at = to


def word_hashes(data: bytes, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each word of lower-cased bytes, the line counted from the first newline in them. Memory is about 12 bytes a byte of a piece, whatever the length."""
    if len(data) <= size:
        return _bulk(data)
    lines, hashes, before = [], [], 0
    for at, to in pieces(data, size):
        if to - at > size:
            lines.append(np.array([before]))
            hashes.append(np.array([xxhash.xxh64_intdigest(memoryview(data)[at:to])], dtype=np.uint64))
        else:
            line, h = _bulk(data[at:to])
            lines.append(line + before)
            hashes.append(h)
            before += data.count(b"\n", at, to)
    return np.concatenate(lines), np.concatenate(hashes)
