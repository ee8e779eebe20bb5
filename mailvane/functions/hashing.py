"""FNV-1a feature hashing: a JVM expression and an Arrow batch accumulator.

``fnv1a`` is plain Column algebra, right for hashing a column of words.
``hash_vectors`` is the accumulator behind the vectorizers: tokens come out of
JVM expressions as ``array<string>``, the byte fold and the per-document sums run
on the flat Arrow buffers of a batch with numpy.  It is narrow, so a corpus is
vectorized without exploding tokens and without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.shipping import ship_package

_MASK = 0xFFFFFFFF
#: Numbers of the dense sums, and bytes of tokens, that are worked on at once: several arrays have a number for each.
SCRATCH_CELLS, SLICE_BYTES = 1 << 20, 2 << 20


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of ``text``, as a long."""

    def byte(h: Column, b: Column) -> Column:
        return (h.bitwiseXOR(b) * F.lit(V.FNV_PRIME)).bitwiseAND(F.lit(_MASK))

    def tail(c: Column, shift: int) -> Column:
        return F.shiftright(c, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))

    def char(h: Column, s: Column) -> Column:
        c = F.ascii(s).cast("long")  # code point of the character
        two = byte(byte(h, F.shiftright(c, 6).bitwiseOR(F.lit(192))), tail(c, 0))
        three = byte(byte(byte(h, F.shiftright(c, 12).bitwiseOR(F.lit(224))), tail(c, 6)), tail(c, 0))
        four = byte(
            byte(byte(byte(h, F.shiftright(c, 18).bitwiseOR(F.lit(240))), tail(c, 12)), tail(c, 6)), tail(c, 0)
        )
        return F.when(c < 128, byte(h, c)).when(c < 2048, two).when(c < 65536, three).otherwise(four)

    start = F.lit(V.FNV_OFFSET).cast("long")
    return F.when(text == "", start).otherwise(F.aggregate(F.split(text, ""), start, char))


def bucket(h: Column, dim: int) -> Column:
    return (h % F.lit(dim)).cast("int")


def sign(h: Column) -> Column:
    """+1 for odd hashes, -1 for even ones.

    The sign hash of the data format starts from another odd offset basis, and an
    odd multiplier keeps the lowest bit equal for both, so one hash is enough.
    """
    return F.when(h.bitwiseAND(F.lit(1)) == 1, F.lit(1)).otherwise(F.lit(-1))


def _state_type(dim: int) -> type:
    """Smallest unsigned type whose wrap-around keeps the hash exact modulo ``dim``.

    The low bits of a product depend on the low bits of its factors only, so for a
    dimension that divides 2^8 or 2^16 the fold runs on bytes or 16-bit words.
    """
    return np.uint8 if 256 % dim == 0 else np.uint16 if 65536 % dim == 0 else np.uint32


class _Tokens:
    """Flat view of an Arrow ``list<string>`` batch."""

    def __init__(self, lists: pa.Array, dim: int):
        lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        self.strings = flat = lists.flatten()
        wide = pa.types.is_large_string(flat.type)
        _, offsets, data = flat.buffers()
        if len(flat) == 0 or offsets is None:
            offs = np.zeros(1, dtype=np.int64)
        else:
            offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
            offs = offs[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = offs[:-1], offs[1:]
        self.lens = np.diff(offs)
        self.doc = np.repeat(np.arange(len(lists)), lengths)
        self.dtype = _state_type(dim)
        self.prime = np.array(V.FNV_PRIME).astype(self.dtype)
        self.dim = dim

    def start_state(self, n: int) -> np.ndarray:
        return np.full(n, np.array(V.FNV_OFFSET).astype(self.dtype), dtype=self.dtype)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return h if self.dim > np.iinfo(self.dtype).max else h % self.dtype(self.dim)

    def fold(self, state: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Continue the hash ``state[i]`` over the bytes of token ``which[i]``."""
        starts, lens = self.starts[which], self.lens[which]
        live = np.arange(len(which))
        out = state.copy()
        p = 0
        while True:
            live = live[lens[live] > p]
            if not len(live):
                return out
            out[live] = (out[live] ^ self.data[starts[live] + p]) * self.prime
            p += 1


def accumulate_pass(
    out: np.ndarray, lists: pa.Array, weight: float, *, bigrams: float, trigrams: float, boosts: dict
) -> None:
    """Add the hashed, unsigned features of one token-list column to the dense ``out``."""
    docs, dim = out.shape
    t = _Tokens(lists, dim)
    n = len(t.lens)
    if n == 0:
        return
    size = docs * dim
    base = t.doc * dim
    # a word repeats often within a batch: hash and look up each distinct word once
    vocab = t.strings.dictionary_encode()
    code = np.asarray(vocab.indices, dtype=np.int64)
    first = np.empty(len(vocab.dictionary), dtype=np.int64)
    first[code[::-1]] = np.arange(n)[::-1]
    h = t.fold(t.start_state(len(first)), first)[code]
    factor = np.ones(len(first))
    if boosts:
        hit = pc.index_in(vocab.dictionary, pa.array(list(boosts), vocab.dictionary.type))
        known = np.asarray(hit.fill_null(-1))
        factor = np.append(np.array(list(boosts.values())), 1.0)[known]
    total = np.bincount(base + t.slot(h), weights=factor[code], minlength=size)

    if bigrams and n > 1:
        left = np.flatnonzero(t.doc[:-1] == t.doc[1:])
        joined = (h[left] ^ t.dtype(ord("_"))) * t.prime
        total += bigrams * np.bincount(base[left] + t.slot(t.fold(joined, left + 1)), minlength=size)

    lo, hi = int(t.starts[0]), int(t.ends[-1])
    if trigrams and hi - lo >= 3:
        b = t.data[lo:hi]
        g = t.start_state(hi - lo - 2)
        for shift in range(3):
            g = (g ^ b[shift : shift + len(g)]) * t.prime
        at = np.repeat(base, t.lens)
        # windows that would run over the end of their token go to a bin that is dropped
        ends = t.ends[t.lens > 0] - lo
        at[ends - 1] = size
        at[np.maximum(ends - 2, 0)] = size
        at = at[: len(g)]
        slot = np.where(at < size, at + t.slot(g), size)
        total += trigrams * np.bincount(slot, minlength=size + 1)[:size]
    out += weight * total.reshape(docs, dim)


def l2_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def list_array(m: np.ndarray) -> pa.Array:
    n, dim = m.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(m.reshape(-1), type=pa.float64())
    )


def token_bytes(lists: pa.Array) -> np.ndarray:
    """What the tokens of each row of an Arrow ``list<string>`` take: their bytes, and a number for each."""
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    taken = np.asarray(pc.binary_length(lists.flatten()).fill_null(0), dtype=np.int64) + 8
    upto, stops = np.r_[0, np.cumsum(taken)], np.cumsum(lengths)
    return upto[stops] - upto[stops - lengths]


def row_slices(sizes: np.ndarray, most_rows: int, most_bytes: int) -> list[tuple[int, int]]:
    """Consecutive rows, of at most so many bytes together unless one alone has more."""
    upto, cuts = np.r_[0, np.cumsum(sizes)], [0]
    while cuts[-1] < len(sizes):
        at = cuts[-1]
        fit = int(np.searchsorted(upto, upto[at] + most_bytes, side="right")) - 1
        cuts.append(min(max(fit, at + 1), at + most_rows, len(sizes)))
    return list(zip(cuts[:-1], cuts[1:]))


def hash_vectors(
    passes: list[tuple[Column, float]],
    dim: int,
    *,
    bigrams: float = 0.0,
    trigrams: float = 0.0,
    boosts: dict | None = None,
    signed: bool = True,
) -> Column:
    """L2-normalised hashed feature vector of one or more weighted token lists."""
    ship_package()
    weights = [w for _, w in passes]
    table = dict(boosts or {})
    if signed and dim % 2:
        raise ValueError("signed hashing needs an even dimension")
    # with an even dimension the sign, the lowest hash bit, is the parity of the bucket
    signs = np.where(np.arange(dim) % 2 == 1, 1.0, -1.0)
    rows_at_once = max(1, SCRATCH_CELLS // dim)  # bounds the dense scratch matrix

    @F.arrow_udf("array<double>")
    def vectors(*lists: pa.Array) -> pa.Array:
        parts = []
        for at, stop in row_slices(sum(token_bytes(x) for x in lists), rows_at_once, SLICE_BYTES):
            out = np.zeros((stop - at, dim))
            for column, weight in zip(lists, weights):
                accumulate_pass(
                    out,
                    column.slice(at, len(out)),
                    weight,
                    bigrams=bigrams,
                    trigrams=trigrams,
                    boosts=table,
                )
            if signed:
                out *= signs
            parts.append(list_array(l2_rows(out)))
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.float64()))

    return vectors(*[c for c, _ in passes])
