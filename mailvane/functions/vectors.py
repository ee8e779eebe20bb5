"""Vector arithmetic on ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions.text import let

_ALIASES = {"cosine": "cosine", "cos": "cosine", "euclidean": "euclidean", "euc": "euclidean", "l2": "euclidean",
            "dot": "dot"}


def metric_name(name: str | None) -> str:
    """Canonical metric; unknown names mean cosine."""
    return _ALIASES.get(name or "cosine", "cosine")


def check_dim(dim: int) -> int:
    if dim < 1:
        raise ValueError(f"dimension must be at least 1, got {dim}")
    return dim


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit vector; vectors shorter than 1e-30 stay as they are."""
    scaled = lambda n: F.when(n < V.COSINE_EPS, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / n)
    )
    return let(norm(v), scaled)  # the norm once per vector, not once per item


def _cosine(a: Column, b: Column, eps: float, degenerate: float) -> Column:
    denom = norm(a) * norm(b)
    return F.when(denom < eps, F.lit(degenerate)).otherwise(dot(a, b) / denom)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - _cosine(a, b, V.COSINE_EPS, 0.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    return _cosine(a, b, V.SIMILARITY_EPS, 0.0)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(metric: str | None) -> Callable[[Column, Column], Column]:
    """Column builder for a metric name; smaller is nearer for all of them."""
    return {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot": negative_dot}[metric_name(metric)]


def format_vector(v: Column) -> Column:
    """Comma-joined ``%.6f`` text form."""
    return F.array_join(F.transform(v, lambda x: F.printf(F.lit("%.6f"), x.cast("double"))), ",")


def parse_vector(csv: Column) -> Column:
    """Comma-separated floats, cut before the first token that is not a number."""
    values = F.transform(F.split(csv, ","), lambda t: F.btrim(t).try_cast("float"))
    bad = F.array_position(F.transform(values, lambda x: x.isNull()), F.lit(True))
    return F.when(bad == 0, values).otherwise(F.slice(values, F.lit(1), (bad - 1).cast("int")))
