"""Named features of token lists, counted on Arrow batches.

Words, word pairs and 3-byte windows are whole numbers here: a window is its three
bytes, a word its place in the batch's dictionary, a pair two such places.  Numbers are
counted per row with numpy, and only what comes out gets its name, the hex of its bytes.
The work is narrow: rows stay where they are and nothing is exploded before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from mailvane.functions import fixed_values as V
from mailvane.shipping import ship_package

#: Bytes and tokens of the rows that are counted at once; a longer row is counted alone.
SLICE_COST = 2 << 20
_WINDOWS = 1 << 24  # numbers below are 3-byte windows
_HEX = np.frombuffer(b"".join(b"%02X" % b for b in range(256)), dtype=np.uint8).reshape(256, 2)


class _Lists:
    """Flat view of an Arrow ``list<string>`` column."""

    def __init__(self, lists: pa.Array):
        flat = lists.flatten().cast(pa.large_string())
        counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        offsets = np.zeros(1, np.int64) if not len(flat) else np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        self.strings, self.row = flat, np.repeat(np.arange(len(lists)), counts)
        self.lens = np.diff(offsets)
        data = flat.buffers()[2] if len(flat) else None
        self.data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        tokens = np.r_[0, np.cumsum(counts)]
        self.cost = tokens + np.r_[0, np.cumsum(self.lens)][tokens]  # up to every row

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """``(row, number)`` of all 3-byte windows within tokens."""
        if len(self.data) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        b = self.data.astype(np.int64)
        number = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        inside = np.ones(len(b), dtype=bool)
        ends = np.cumsum(self.lens)[self.lens > 0]
        inside[ends - 1] = False
        inside[np.maximum(ends - 2, 0)] = False  # a one-byte token marks the end of the token before, no window either
        at = np.flatnonzero(inside[: len(number)])
        return np.repeat(self.row, self.lens)[at], number[at]


def _counted(row: np.ndarray, number: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``row * span + number`` in order, and how often each occurs."""
    return np.unique(row * span + number, return_counts=True)


def _window_names(number: np.ndarray) -> pa.Array:
    text = np.concatenate([_HEX[(number >> shift) & 255] for shift in (16, 8, 0)], axis=1)
    offsets = np.arange(len(number) + 1, dtype=np.int32) * 6
    return pa.StringArray.from_buffers(len(number), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))


def _slices(columns: list[pa.Array]) -> Iterator[slice]:
    cost, at = sum(_Lists(c).cost for c in columns), 0
    while at < len(cost) - 1:
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + SLICE_COST, side="right")) - 1)
        yield slice(at, end)
        at = end


def _weighed(passes: list[tuple[_Lists, float]], boosts: dict) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``(row, name, weight)`` of words, pairs and windows, each name once a row."""
    vocab = pa.concat_arrays([t.strings for t, _ in passes]).dictionary_encode()
    codes = np.split(np.asarray(vocab.indices, dtype=np.int64), np.cumsum([len(t.strings) for t, _ in passes])[:-1])
    words = vocab.dictionary.to_pylist()
    n = len(words)
    raw = [w.encode() for w in words]
    names = pa.array([w.hex().upper() for w in raw], pa.string())
    boost = np.array([boosts.get(w, 1.0) for w in words])
    # a word of three bytes has the name of a window
    number = np.array([int.from_bytes(w, "big") if len(w) == 3 else _WINDOWS + i for i, w in enumerate(raw)], dtype=np.int64)
    span, parts, pairs = _WINDOWS + n, [], []
    for (t, weight), code in zip(passes, codes):
        key, times = _counted(t.row, code, max(n, 1))
        parts.append((key // max(n, 1) * span + number[key % max(n, 1)], times * boost[key % max(n, 1)] * weight))
        key, times = _counted(*t.windows(), span)
        parts.append((key, times * (V.TRIGRAM_WEIGHT * weight)))
        left = np.flatnonzero(t.row[:-1] == t.row[1:])
        key, times = _counted(t.row[left], code[left] * n + code[left + 1], max(n * n, 1))
        pairs.append((key, times * (V.BIGRAM_WEIGHT * weight)))
    key, weight = _summed(parts)
    row, what = key // span, key % span
    window = what < _WINDOWS
    yield row[window], _window_names(what[window]), weight[window]
    yield row[~window], names.take(pa.array(what[~window] - _WINDOWS)), weight[~window]
    key, weight = _summed(pairs)
    what = key % max(n * n, 1)
    both = pc.binary_join_element_wise(names.take(pa.array(what // max(n, 1))), names.take(pa.array(what % max(n, 1))), "5F")
    yield key // max(n * n, 1), both, weight


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([w for _, w in parts]), minlength=len(key))


def weighted_features(docs: DataFrame, id_col: str, passes: list[tuple[Column, float]], boosts: dict) -> DataFrame:
    """``(id, feature, weight)``: summed weight of every word, word pair and 3-byte window of weighted token lists."""
    ship_package()
    weights = [w for _, w in passes]
    rows = docs.select(id_col, *[c.alias(f"_t{i}") for i, (c, _) in enumerate(passes)])
    out = T.StructType([docs.schema[id_col], T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.columns[1:]):
                cut = batch.slice(part.start, part.stop - part.start)
                for row, name, weight in _weighed([(_Lists(c), w) for c, w in zip(cut.columns[1:], weights)], boosts):
                    yield pa.RecordBatch.from_arrays([cut.column(0).take(pa.array(row)), name, pa.array(weight)], names=out.names)

    return rows.mapInArrow(run, out)


def window_counts(docs: DataFrame, id_col: str, tokens: Column, name: str) -> DataFrame:
    """``(id, window, n)``: how often each 3-byte window occurs in the tokens of its row."""
    ship_package()
    out = T.StructType([docs.schema[id_col], T.StructField(name, T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.columns[1:]):
                cut = batch.slice(part.start, part.stop - part.start)
                key, times = _counted(*_Lists(cut.column(1)).windows(), _WINDOWS)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0).take(pa.array(key // _WINDOWS)), _window_names(key % _WINDOWS), pa.array(times)], names=out.names
                )

    return docs.select(id_col, tokens.alias("_t")).mapInArrow(run, out)
