"""Vectors as whole numbers: components are scaled, floored, and multiplied exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles hold every whole number up to this one.
EXACT = float(1 << 53)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def whole_length(vector: Column, scale: float) -> Column:
    """Euclidean length of the scaled and floored vector; what is beyond 2**53 is whole already."""

    def square(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        z = F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
        return z * z

    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + square(x)))


def whole_matrix(vectors: pa.Array | pa.ChunkedArray, scale: float, dim: int) -> np.ndarray:
    """Scaled and floored rows, as doubles without fractions; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), dim))
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
    return out


def is_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no sum of products of the two sides' components can leave the whole numbers a double holds."""
    if not a.size or not b.size:
        return True
    return a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both sides as long numbers.

    One matrix product where doubles are exact; else Python's whole numbers, held at
    the ends of the long range.
    """
    if is_exact(a, b):
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[min(max(int(x), LOWEST), HIGHEST) for x in r] for r in exact], dtype=np.int64).reshape(len(a), len(b))


def first_best(group: np.ndarray, score: np.ndarray, position: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of every group, ties to the lower position; by group, best first."""
    order = np.lexsort((position, ~score, group))  # ~ turns the order of whole numbers round without overflow
    g = group[order]
    if not len(g):
        return order
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
    return order[np.arange(len(g)) - start < k]


def by_id(ids: pa.Array) -> np.ndarray:
    """Order of ids, null ids last."""
    import pyarrow.compute as pc

    return np.asarray(pc.sort_indices(ids, null_placement="at_end"), dtype=np.int64)


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: float, **more: Column) -> DataFrame:
    """``row, id, v, length`` and ``more`` of the usable vectors; ``row`` numbers them."""
    v = F.col(f"`{vector_col}`")
    return vectors.where(usable(v)).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), v.alias("v"),
        whole_length(v, scale).alias("length"), *[c.alias(name) for name, c in more.items()],
    )
