"""Hashes of the words of an Arrow text column, without a Python loop over words.

A running sum of random byte values times powers of an odd number gives the hash of any
byte range from two entries of the sum.  Work goes slice by slice so that the arrays per
byte stay small however large the batch or one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: The same with A-Z as a-z.
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of other characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, _SLICE + 4096)
        have = np.full(size, U64(base & (2**64 - 1)), dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


class Prefix:
    """Running hash of a byte range; ``of(s, e)`` hashes the ranges ``[s, e)``."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        self.sums = np.zeros(len(raw) + 1, dtype=U64)
        values = (_LOWER if lower else _VALUES)[raw]
        values *= _power("up", _BASE, len(raw))
        np.cumsum(values, out=self.sums[1:])
        self.down = _power("down", _INVERSE, len(raw) + 1)

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(U64))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of ``kind``; a run ends with its text."""
    inside = kind[raw]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    edge = offsets[:-1]
    before[edge[edge < len(raw)]] = False
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    edge = offsets[1:]
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _pieces(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about a slice; a single long text is cut where no run is open."""
    if len(offsets) > 2 or len(raw) <= 2 * _SLICE:
        yield 0, len(raw)
        return
    at = 0
    while at < len(raw):
        to = at + _SLICE
        while to < len(raw):
            gap = np.flatnonzero(~kind[raw[to : to + _SLICE]])
            if len(gap):
                to += int(gap[0])
                break
            to += _SLICE
        to = min(to, len(raw))
        yield at, to
        at = to


def word_runs(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True, prefixes: tuple[int, ...] = ()) -> dict:
    """Runs of the texts of one slice: ``start``, ``end``, ``hash``, ``ptr`` (first run of each text).

    ``prefix`` maps a number of bytes to the hashes of the runs' beginnings of that many
    bytes (0 where a run is not longer).
    """
    starts, ends, hashes, heads = [], [], [], {k: [] for k in prefixes}
    for a, b in _pieces(raw, offsets, kind):
        part = raw[a:b]
        s, e = spans(part, np.array([0, len(part)]) if len(offsets) == 2 else offsets, kind)
        sums = Prefix(part, lower)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(sums.of(s, e))
        for k in prefixes:
            heads[k].append(np.where(e - s > k, sums.of(s, np.minimum(s + k, e)), U64(0)))
    start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    return {
        "start": start,
        "end": np.concatenate(ends) if ends else start,
        "hash": np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64),
        "ptr": np.searchsorted(start, offsets),
        "prefix": {k: np.concatenate(v) if v else np.zeros(0, dtype=U64) for k, v in heads.items()},
    }


_STEPS = mix(np.arange(101, 133, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct hashed shingles of ``k`` words, sorted.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    raw, offsets = text_column(column)
    for lo, hi in slices(offsets):
        base = offsets[lo]
        runs = word_runs(raw[base : offsets[hi]], offsets[lo : hi + 1] - base)
        h, ptr = runs["hash"], runs["ptr"]
        n = len(h) - k + 1
        if n > 0:
            rolled = h[:n] * _STEPS[0]
            for j in range(1, k):
                rolled = rolled + h[j : j + n] * _STEPS[j]
            rolled = mix(rolled)
        for a, b in zip(ptr[:-1], ptr[1:]):
            if b - a >= k:
                part = np.sort(rolled[a : b - k + 1])
                fresh = np.empty(len(part), dtype=bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                yield part[fresh]
            elif b > a:
                yield mix((h[a:b] * _STEPS[: b - a]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, dtype=U64)
