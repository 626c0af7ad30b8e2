"""Progressive JPEG media (operator 5).

`decode_batch` reads progressive JPEGs: it accumulates spectral-selection and successive-approximation scans in coefficient
arrays, inverse-transforms them in numpy, upsamples the chroma and gives full-resolution RGB tensors. Entropy-coded
stretches between restart markers are independent, so those of many pictures are decoded in step, one symbol of each at a
time; a refinement stretch that is one end-of-band run is read at once, any other by a plain reader.

`encode_batch` stores bytes losslessly in the format's own unit, the quantised coefficient: a picture of 4:2:0 has 64
coefficients a block, one byte each, plus 2 so that every stored one is non-zero after the first scan and refinement scans
are runs of plain bits. Quantisation tables are 1 throughout, so no coefficient is changed.

A null text is an empty one: 64 zero bytes. Equal texts give equal pictures and features: all arithmetic is exact; repeated
rows give repeated rows, and there are no ties. A long text is one picture (of at most 65,535 samples a side, some 2 GB of
text), held in a task with its coefficients and tensor, about 20 bytes a byte of text. Empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

BLOCK, RESTART, LIFT = 64, 16, 2
#: Order of the coefficients of a block (row * 8 + column), as the format fixes it: along the anti-diagonals, turning each time.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Symbols of the tables written here with the lengths of their codes.
_DC = [(s, 4) for s in range(10)]
_AC = [(6, 1), (5, 2), (7, 3), *[(s, 7) for s in (4, 3, 2, 1, 8, 9, 0x00, 0x10, 0x20, 0x30, 0x40)]]


def _canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol to (code, length), codes ascending by length."""
    out, code, before = {}, 0, 0
    for symbol, n in lengths:
        code <<= n - before
        out[symbol] = (code, n)
        code, before = code + 1, n
    return out


def _table_segment(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(n == k for _, n in lengths) for k in range(1, 17)]
    return _segment(0xC4, bytes([kind, *counts, *[s for s, _ in lengths]]))


def _segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2, "big") + data


#: (components, first and last coefficient, high and low bit) of each scan written.
_SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


def _scan_header(scan: tuple) -> bytes:
    parts, first, last, high, low = scan
    return _segment(0xDA, bytes([len(parts), *[x for c in parts for x in (c + 1, 0)], first, last, high << 4 | low]))


_TABLES = _table_segment(0x00, _DC) + _table_segment(0x10, _AC) + _segment(0xDD, RESTART.to_bytes(2, "big"))


def _head(width: int, height: int) -> bytes:
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC2, frame) + _TABLES


def _pack(code: np.ndarray, length: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each group, in order, padded with ones to whole bytes: (bytes, first byte of each group and the end)."""
    keep = length > 0
    if not keep.all():
        code, length, group = code[keep], length[keep], group[keep]
    ends = np.cumsum(length)
    last = np.searchsorted(group, np.arange(groups), side="right") - 1
    upto = np.where(last >= 0, ends[last], 0) if len(ends) else np.zeros(groups, dtype=np.int64)
    bits = np.diff(upto, prepend=0)
    start = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
    at = ends - length + (start[:-1] * 8 - (upto - bits))[group]
    word = code << (24 - (at & 7) - length)
    at >>= 3
    # the bits of codes that begin in one byte do not overlap
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
    word, at = (np.add.reduceat(word, first), at[first]) if len(first) else (word, at)
    out = np.zeros(int(start[-1]) + 3, dtype=np.uint8)
    out[at] = (word >> 16).astype(np.uint8)
    out[at + 1] += ((word >> 8) & 255).astype(np.uint8)
    out[at + 2] += (word & 255).astype(np.uint8)
    out = out[: start[-1]]
    pad = -bits % 8
    last = start[1:][pad > 0] - 1
    out[last] |= ((1 << pad[pad > 0]) - 1).astype(np.uint8)
    return out, start


def _stuffed(data: np.ndarray, start: np.ndarray, index: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Zero bytes after 0xFF, and a restart marker after each group that is not the last of its scan; new ends of the groups."""
    ff = data == 255
    shift = np.concatenate(([0], np.cumsum(ff)))
    marks = np.concatenate(([0], np.cumsum(np.where(last, 0, 2))))
    group = np.repeat(np.arange(len(index)), np.diff(start))
    out = np.zeros(len(data) + int(shift[-1]) + int(marks[-1]), dtype=np.uint8)
    out[np.arange(len(data)) + shift[:-1] + marks[group]] = data
    ends = start[1:] + shift[start[1:]] + marks[1:]
    more = np.flatnonzero(~last)
    out[ends[more] - 2] = 255
    out[ends[more] - 1] = 0xD0 + index[more] % 8
    return out.tobytes(), ends


def _code_arrays(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for s, (c, k) in _canonical(lengths).items():
        code[s], n[s] = c, k
    return code, n


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _grid(n_blocks: int) -> tuple[int, int]:
    """Width and height in units of 16 x 16 samples that hold so many blocks, 6 a unit."""
    units = -(-n_blocks // 6)
    w = int(np.ceil(np.sqrt(units)))
    return w, -(-units // w)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as one progressive JPEG."""
    dc_code, dc_len = _code_arrays(_DC)
    ac_code, ac_len = _code_arrays(_AC)
    grids = [_grid(len(p) // BLOCK) for p in payloads]
    units = np.array([w * h for w, h in grids])
    planes = [[], [], []]
    for p, u in zip(payloads, units.tolist()):
        c = np.zeros((6 * u, BLOCK), dtype=np.int32)
        flat = np.frombuffer(p, dtype=np.uint8).reshape(-1, BLOCK)
        c[: len(flat)] = flat
        c[: len(flat)] += LIFT
        for k, part in enumerate((c[: 4 * u], c[4 * u : 5 * u], c[5 * u :])):
            planes[k].append(part)
    planes = [np.concatenate(x) for x in planes]
    out = [[_head(16 * w, 16 * h)] for w, h in grids]
    for scan in _SCANS:
        parts, first, last_k, high, low = scan
        per = units * (4 if parts == (0,) else 1)  # items (blocks, or units of 6 blocks) of each picture in this scan
        groups_of = -(-per // RESTART)
        base = np.cumsum(groups_of) - groups_of
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        item_group = within // RESTART + np.repeat(base, per)
        groups = int(groups_of.sum())
        index = np.arange(groups) - np.repeat(base, groups_of)
        is_last = index == np.repeat(groups_of, groups_of) - 1
        if first == 0:
            dc = np.concatenate([_luma_units(planes[0][:, 0], units, grids), planes[1][:, :1], planes[2][:, :1]], axis=1)
            if high:
                code, length, group = (dc & 1).ravel(), np.ones(dc.size, dtype=np.int64), np.repeat(item_group, 6)
            else:
                v = dc >> low
                before = np.zeros_like(v)
                before[:, 1:4] = v[:, :3]
                before[1:, 0], before[1:, 4:] = v[:-1, 3], v[:-1, 4:]
                before[within % RESTART == 0, 0] = 0
                before[within % RESTART == 0, 4:] = 0
                diff = (v - before).ravel()
                size = _bit_length(np.abs(diff))
                code = dc_code[size] << size | np.where(diff < 0, diff + (1 << size) - 1, diff)
                length, group = dc_len[size] + size, np.repeat(item_group, 6)
        else:
            v = planes[parts[0]][:, first : last_k + 1]
            if high:
                count = np.bincount(item_group, minlength=groups)
                n = _bit_length(count) - 1
                code0 = ac_code[n << 4] << n | (count - (1 << n))
                run, stored = np.flatnonzero(v.any(axis=1)), v[v.any(axis=1)]
                code = np.concatenate((code0, (stored & 1).ravel()))
                length = np.concatenate((ac_len[n << 4] + n, np.ones(stored.size, dtype=np.int64)))
                group = np.concatenate((np.arange(groups), np.repeat(item_group[run], v.shape[1])))
                order = np.argsort(group, kind="stable")
                code, length, group = code[order], length[order], group[order]
            else:
                v = v >> low
                full = v[:, 0] > 0
                size = _bit_length(v)
                code, length = ac_code[size] << size | v, ac_len[size] + size
                code[~full], length[~full] = 0, 0
                code[~full, 0], length[~full, 0] = ac_code[0], ac_len[0]
                code, length, group = code.ravel(), length.ravel(), np.repeat(item_group, v.shape[1])
        data, ends = _stuffed(*_pack(code, length, group, groups), index, is_last)
        at, head = 0, _scan_header(scan)
        for k, e in enumerate(ends[np.flatnonzero(is_last)].tolist()):
            out[k] += [head, data[at:e]]
            at = e
    return [b"".join(x) + b"\xff\xd9" for x in out]


def _luma_units(dc: np.ndarray, units: np.ndarray, grids: list[tuple[int, int]]) -> np.ndarray:
    """Luma values of block rows as the four of each unit."""
    out, at = [], 0
    for u, (w, h) in zip(units.tolist(), grids):
        out.append(dc[at : at + 4 * u].reshape(h, 2, w, 2).transpose(0, 2, 1, 3).reshape(-1, 4))
        at += 4 * u
    return np.concatenate(out)


@dataclass
class _Part:
    """A component of a picture: sampling factors, size in blocks (in whole units), and the first row of its coefficients."""

    h: int
    v: int
    table: int
    wide: int = 0
    tall: int = 0
    own_wide: int = 0
    own_tall: int = 0
    base: int = 0


@dataclass
class _Picture:
    width: int = 0
    height: int = 0
    parts: dict[int, _Part] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[dict] = field(default_factory=list)
    across: int = 0
    down: int = 0


_MARK = re.compile(rb"\xff+[^\x00\xff]", re.S)


def _parse(data: bytes) -> _Picture:
    """Headers, tables and the stretches of each scan; only progressive pictures of 8-bit samples are read."""
    p, at, huff, restart = _Picture(), 2, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            return p
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        s = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while s:
                wide = 2 if s[0] >> 4 else 1
                p.quant[s[0] & 15] = np.frombuffer(s[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.int64)
                s = s[1 + 64 * wide :]
        elif marker == 0xC4:
            while s:
                n = sum(s[1:17])
                huff[s[0]] = bytes(s[1 : 17 + n])
                s = s[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(s, "big")
        elif marker == 0xC2:
            if s[0] != 8:
                raise ValueError("only 8-bit samples are read")
            p.height, p.width = int.from_bytes(s[1:3], "big"), int.from_bytes(s[3:5], "big")
            for i in range(s[5]):
                c, hv, t = s[6 + 3 * i : 9 + 3 * i]
                p.parts[c] = _Part(hv >> 4, hv & 15, t)
            hm, vm = max(x.h for x in p.parts.values()), max(x.v for x in p.parts.values())
            p.across, p.down = -(-p.width // (8 * hm)), -(-p.height // (8 * vm))
            for x in p.parts.values():
                x.wide, x.tall = p.across * x.h, p.down * x.v
                x.own_wide, x.own_tall = -(-(-(-p.width * x.h // hm)) // 8), -(-(-(-p.height * x.v // vm)) // 8)
        elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a progressive Huffman JPEG")
        elif marker == 0xDA:
            n = s[0]
            use = [(s[1 + 2 * i], s[2 + 2 * i]) for i in range(n)]
            first, last, bits = s[1 + 2 * n : 4 + 2 * n]
            stretches, begin = [], at
            for m in _MARK.finditer(data, at):
                stretches.append(data[begin : m.start()].replace(b"\xff\x00", b"\xff"))
                begin = m.end()
                if not 0xD0 <= data[m.end() - 1] <= 0xD7:
                    at = m.end() - 2
                    break
            p.scans.append({"use": use, "first": first, "last": last, "high": bits >> 4, "low": bits & 15, "restart": restart, "stretches": stretches, "dc": [huff.get(t >> 4) for _, t in use], "ac": huff.get(0x10 | use[0][1] & 15)})


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come: the symbol's length in the high byte and the symbol in the low; length 0 is no code."""
    out, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _values(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may come: bits of a symbol without a run together with its value, and the value; 0 bits where the 16 do not hold both."""
    got = _lookup(table)
    n, run, size = got >> 8, (got >> 4) & 15, got & 15
    fits = (n > 0) & (run == 0) & (size > 0) & (n + size <= 16)
    raw = (np.arange(1 << 16) >> np.maximum(16 - n - size, 0)) & ((1 << size) - 1)
    return np.where(fits, n + size, 0), np.where(fits, _extend(raw, size), 0).astype(np.int16)


class _Lanes:
    """Bits of many stretches, each read at its own place."""

    def __init__(self, stretches: list[bytes]):
        pad = b"\x00" * 8
        data = np.frombuffer(pad.join(stretches) + pad, dtype=np.uint8)
        n = np.array([len(s) for s in stretches], dtype=np.int64) + 8
        self.at = (np.cumsum(n) - n) * 8
        self.end = self.at + n * 8
        wide = data.astype(np.int64)
        self.word = np.zeros(len(wide), dtype=np.int64)
        self.word[:-3] = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        self.data = data

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        return (self.word[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def _check(ok) -> None:
    if not np.all(ok):
        raise ValueError("broken entropy-coded data")


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _dc_scan(co: np.ndarray, lanes: _Lanes, scan: dict, layout: list, unit_rows: np.ndarray, count: np.ndarray) -> None:
    """unit_rows: for each lane and unit the rows of co of its blocks (lane, unit, block); layout: component of each block."""
    pred = np.zeros((len(lanes.at), len(scan["use"])), dtype=np.int64)
    at = lanes.at.copy()
    for u in range(unit_rows.shape[1]):
        on = np.flatnonzero(count > u)
        for b, c in enumerate(layout):
            p, rows = at[on], unit_rows[on, u, b]
            if scan["high"]:
                co[rows, 0] |= (lanes.peek(p, 1) << scan["low"]).astype(co.dtype)
                at[on] = p + 1
                continue
            got = _lookup(scan["dc"][c])[lanes.peek(p, 16)]
            _check(got >> 8)
            p += got >> 8
            n = got & 255
            pred[on, c] += _extend(lanes.peek(p, n), n)
            at[on] = p + n
            co[rows, 0] = pred[on, c] << scan["low"]
    _check(at <= lanes.end)


def _ac_first(co: np.ndarray, lanes: _Lanes, scan: dict, rows: np.ndarray, count: np.ndarray) -> None:
    """rows: for each lane the rows of co of its blocks."""
    table, first, last, low = _lookup(scan["ac"]), scan["first"], scan["last"], scan["low"]
    both, values = _values(scan["ac"])
    values = values << low
    flat, wide = co.reshape(-1), co.shape[1]
    lane = np.arange(len(count))
    at, block, k = lanes.at.copy(), np.zeros(len(count), dtype=np.int64), np.full(len(count), first)
    end, count, here = lanes.end, count.copy(), rows[:, 0] * wide
    while True:
        got = lanes.peek(at, 16)
        n = both[got]
        if n.all():
            flat[here + k] = values[got]
            at += n
            k += 1
        else:
            got = table[got]
            _check((got >> 8 > 0) & (at < end))
            at += got >> 8
            run, size = (got >> 4) & 15, got & 15
            plain = size > 0
            long = ~plain & (run == 15)
            eob = ~plain & ~long
            n = np.where(plain, size, np.where(eob, run, 0))
            raw = lanes.peek(at, n)
            at += n
            k = np.where(plain, k + run, np.where(long, k + 16, k))
            _check(~plain | (k <= last))
            flat[(here + k)[plain]] = _extend(raw, n)[plain] << low
            k = np.where(plain, k + 1, k)
            block = np.where(eob, block + (1 << run) + raw, block)
            k = np.where(eob, last + 1, k)
            block -= eob
        done = k > last
        if done.any():
            _check(at <= end)
            block += done
            k[done] = first
            live = block < count
            if not live.all():
                lane, at, block, k, end, count = (x[live] for x in (lane, at, block, k, end, count))
                if not len(lane):
                    return
            here = rows[lane, block] * wide


def _ac_refine(co: np.ndarray, lanes: _Lanes, scan: dict, rows: np.ndarray, count: np.ndarray) -> None:
    table, first, last, low = _lookup(scan["ac"]), scan["first"], scan["last"], scan["low"]
    got = table[lanes.peek(lanes.at, 16)]
    _check(got >> 8)
    run, size = (got >> 4) & 15, got & 15
    at = lanes.at + (got >> 8)
    n = np.where((size == 0) & (run < 15), run, 0)
    whole = (size == 0) & (run < 15) & ((1 << n) + lanes.peek(at, n) >= count)
    at += n
    fast = np.flatnonzero(whole)
    per = count[fast]
    lane = np.repeat(fast, per)
    r = rows[lane, np.arange(len(lane)) - np.repeat(np.cumsum(per) - per, per)]
    band = co[r, first : last + 1]
    i, j = np.nonzero(band)
    owner = lane[i]
    started = np.searchsorted(owner, fast)
    order = np.arange(len(owner)) - np.repeat(started, np.diff(np.concatenate((started, [len(owner)]))))
    place = at[owner] + order
    _check(place < lanes.end[owner])
    bit = (lanes.data[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
    co[r[i], first + j] += np.where(band[i, j] > 0, bit, -bit.astype(np.int64)).astype(co.dtype) << low
    for x in np.flatnonzero(~whole).tolist():
        _refine_plainly(co, lanes, int(lanes.at[x]), table, first, last, low, rows[x, : count[x]])


def _refine_plainly(co: np.ndarray, lanes: _Lanes, at: int, table: np.ndarray, first: int, last: int, low: int, rows: np.ndarray) -> None:
    """One stretch of a refinement scan, a symbol at a time."""
    one, eob = 1 << low, 0

    def bits(n: int) -> int:
        nonlocal at
        v = int(lanes.peek(np.int64(at), n)) if n else 0
        at += n
        return v

    for row in rows.tolist():
        k = first
        while k <= last and not eob:
            got = int(table[int(lanes.peek(np.int64(at), 16))])
            _check(got >> 8)
            at += got >> 8
            run, size = (got >> 4) & 15, got & 15
            value = 0
            if size:
                value = one if bits(1) else -one
            elif run < 15:
                eob = (1 << run) + bits(run)
                break
            while k <= last:
                if co[row, k]:
                    if bits(1):
                        co[row, k] += one if co[row, k] > 0 else -one
                elif run == 0:
                    if value:
                        co[row, k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if eob:
            while k <= last:
                if co[row, k] and bits(1):
                    co[row, k] += one if co[row, k] > 0 else -one
                k += 1
            eob -= 1


def coefficients(pictures: list[bytes]) -> tuple[list[_Picture], np.ndarray]:
    """All pictures' coefficients, a block a row in zigzag order; each part of a picture says where its rows begin."""
    parsed = [_parse(x) for x in pictures]
    total = 0
    for p in parsed:
        for x in p.parts.values():
            x.base = total
            total += x.wide * x.tall
    co = np.zeros((total, BLOCK), dtype=np.int16)
    for step in range(max((len(p.scans) for p in parsed), default=0)):
        alike: dict[tuple, list[_Picture]] = {}
        for p in parsed:
            if step < len(p.scans):
                s = p.scans[step]
                shape = tuple((p.parts[c].h, p.parts[c].v) for c, _ in s["use"])
                alike.setdefault((len(s["use"]), s["first"], s["last"], s["high"], s["low"], tuple(s["dc"]), s["ac"], shape), []).append(p)
        for same in alike.values():
            _scan(co, same, step)
    return parsed, co


def _scan(co: np.ndarray, same: list[_Picture], step: int) -> None:
    scan = same[0].scans[step]
    joined = len(scan["use"]) > 1
    stretches, rows, counts = [], [], []
    layout = [i for i, (c, _) in enumerate(scan["use"]) for _ in range(same[0].parts[c].h * same[0].parts[c].v if joined else 1)]
    for p in same:
        s = p.scans[step]
        if joined:
            unit = np.arange(p.across * p.down)
            y, x = unit // p.across, unit % p.across
            item = np.stack([q.base + (y * q.v + v) * q.wide + x * q.h + h for q in (p.parts[c] for c, _ in s["use"]) for v in range(q.v) for h in range(q.h)], axis=1)
        else:
            q = p.parts[s["use"][0][0]]
            item = (q.base + np.arange(q.own_tall)[:, None] * q.wide + np.arange(q.own_wide)[None, :]).reshape(-1, 1)
        every = s["restart"] or len(item)
        if len(s["stretches"]) != -(-len(item) // every):
            raise ValueError("restart markers are missing")
        for k, stretch in enumerate(s["stretches"]):
            part = item[k * every : (k + 1) * every]
            stretches.append(stretch)
            rows.append(part)
            counts.append(len(part))
    count = np.array(counts)
    at = np.zeros((len(rows), count.max(), len(layout)), dtype=np.int64)
    flat = np.concatenate(rows)
    lane = np.repeat(np.arange(len(rows)), count)
    at[lane, np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat
    lanes = _Lanes(stretches)
    if scan["first"] == 0:
        _dc_scan(co, lanes, scan, layout, at, count)
    elif scan["high"]:
        _ac_refine(co, lanes, scan, at[:, :, 0], count)
    else:
        _ac_first(co, lanes, scan, at[:, :, 0], count)


#: The inverse transform's matrix in whole numbers, so that sums are exact in double precision whatever their order.
_SCALE = 1 << 13
_COS = np.round(_SCALE * np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)]))


def planes(co: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples of each block of dequantised coefficients."""
    out = np.empty((len(co), 8, 8), dtype=np.uint8)
    for a in range(0, len(co), 1 << 14):
        part = np.zeros((len(co[a : a + (1 << 14)]), 64))
        part[:, ZIGZAG] = co[a : a + (1 << 14)].astype(np.float64) * quant
        once = (part.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
        both = (once @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)
        out[a : a + (1 << 14)] = np.clip(np.floor(both / (_SCALE * _SCALE) + 128.5), 0, 255)
    return out


def samples(parsed: list[_Picture], co: np.ndarray) -> np.ndarray:
    """8 x 8 samples of all blocks of pictures, those of like tables together."""
    parts = [(x.base, x.base + x.wide * x.tall, p.quant[x.table]) for p in parsed for x in p.parts.values()]
    tables = np.stack([q for _, _, q in parts]) if parts else np.zeros((0, BLOCK))
    if len(parts) and (tables == tables[0]).all():
        return planes(co, tables[0])
    out = np.empty((len(co), 8, 8), dtype=np.uint8)
    for a, b, q in parts:
        out[a:b] = planes(co[a:b], q)
    return out


def tensor(p: _Picture, blocks: np.ndarray) -> np.ndarray:
    """The picture as (height, width, 3) RGB from its samples, chroma repeated to full resolution; one component gives grey."""
    hm, vm = max(x.h for x in p.parts.values()), max(x.v for x in p.parts.values())
    full = []
    for x in p.parts.values():
        s = blocks[x.base : x.base + x.wide * x.tall].reshape(x.tall, x.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * x.tall, 8 * x.wide)
        if (hm, vm) != (x.h, x.v):
            s = np.broadcast_to(s[:, None, :, None], (s.shape[0], vm // x.v, s.shape[1], hm // x.h)).reshape(s.shape[0] * (vm // x.v), -1)
        full.append(s[: p.height, : p.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y, cb, cr = (v.astype(np.int32) for v in full[:3])
    y = (y << 16) + (1 << 15)
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    for c, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        v >>= 16
        np.clip(v, 0, 255, out=v)
        out[:, :, c] = v
    return out


def decode_batch(pictures: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEGs."""
    parsed, co = coefficients(pictures)
    blocks = samples(parsed, co)
    return [tensor(p, blocks) for p in parsed]


def stored(p: _Picture, co: np.ndarray, n_bytes: int) -> bytes:
    """The payload that encode_batch put in the coefficients; its parts lie one after another."""
    base = min(x.base for x in p.parts.values())
    flat = co[base : base + n_bytes // BLOCK] - LIFT
    if flat.size and (flat.min() < 0 or flat.max() > 255):
        raise ValueError("not a payload of bytes")
    return flat.astype(np.uint8).tobytes()


def feature(t: np.ndarray) -> str:
    """Size, mean and spread of each channel in thousandths, and a digest of the tensor."""
    v = t.reshape(-1, 3)
    n = len(v)
    parts = []
    for c in range(3):
        h = np.bincount(v[:, c], minlength=256)
        s, q = int((h * np.arange(256)).sum()), int((h * np.arange(256) ** 2).sum())
        parts.append(f"{s * 1000 // n}~{(q * n - s * s) * 1000 // (n * n)}")
    return f"{t.shape[1]}x{t.shape[0]} {' '.join(parts)} {hashlib.sha256(np.ascontiguousarray(t).data).hexdigest()[:16]}"


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0"), len(data)


def _parts(texts: list[str | None], size: int = 3 << 20) -> Iterator[list[tuple[bytes, int]]]:
    part, total = [], 0
    for t in texts:
        part.append(payload(t))
        total += len(part[-1][0])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def store_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False, keep_tensor: bool = False) -> DataFrame:
    """Each text as a progressive JPEG, read back: digests and a feature of the RGB tensor; with keep_media the picture, with keep_tensor (height, width, rgb) the tensor itself."""
    kinds = {"id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    kinds |= {"media": "binary"} if keep_media else {}
    kinds |= {"height": "int", "width": "int", "rgb": "binary"} if keep_tensor else {}
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for part in _parts(b.column(1).to_pylist()):
            media = encode_batch([p for p, _ in part])
            parsed, co = coefficients(media)
            blocks = samples(parsed, co)
            for (p, n), m, picture in zip(part, media, parsed):
                back, t = stored(picture, co, len(p)), tensor(picture, blocks)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(t), *([m] if keep_media else []), *([t.shape[0], t.shape[1], t.tobytes()] if keep_tensor else [])))
        cols = list(zip(*rows)) if rows else [()] * (len(kinds) - 1)
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, arrow[k]) for c, k in zip(cols, list(kinds.values())[1:])]], list(kinds))

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_rows(source, run, ", ".join(f"{n} {k}" for n, k in kinds.items())).withColumnRenamed("id", id_col)


def rgb_tensors(media: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """Progressive JPEGs in a binary column to (id, height, width, rgb); null or unreadable ones give null sizes and tensor."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in b.column(1):
            try:
                t = decode_batch([x.as_py()])[0] if x.is_valid else None
            except (ValueError, IndexError, KeyError, TypeError):
                t = None
            out.append((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))
        h, w, t = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(t, pa.binary())], ["id", "height", "width", "rgb"])

    return map_rows(media.select(media[id_col].cast("long").alias("id"), media[media_col].alias("m")), run, "id long, height int, width int, rgb binary").withColumnRenamed("id", id_col)
