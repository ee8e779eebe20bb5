"""Approximate k-NN: corpus rows are filed under their nearest centroid (cell), a
query looks into its ``n_probe`` nearest cells only, and ranks those rows exactly.

With ``n_probe`` = all cells the result is that of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.functions.fixed_values import COSINE_EPS
from mailvane.functions.vectors import metric_name, normalize
from mailvane.operators.kernels import matrix, sort_key
from mailvane.operators.knn import BLOCK_ROWS, all_pairs, block_join, effective_k, merge_top_k, numbered, parts_of
from mailvane.shipping import ship_package
from mailvane.sources.tables import written

#: Centroids are held by every task; an index whose centroids take more is refused.
CENTROID_BYTES = 256 << 20
#: Rows that a cell should hold: as many as there are cells, within these bounds.
LEAST_CELL_ROWS, MOST_CELL_ROWS = 64, 16_384

#: With one in so many cells probed, or more, products of whole blocks are made and rows of other cells left out.
LEAST_SHARE = 4


@dataclass(frozen=True)
class CellIndex:
    """Centroids of the cells; the row -> cell table is made by ``assign``."""

    centroids: np.ndarray
    metric: str

    def __post_init__(self):
        if not len(self.centroids):
            raise ValueError("an index has at least one cell")
        if self.centroids.nbytes > CENTROID_BYTES:
            raise ValueError(f"centroids of {self.centroids.nbytes} bytes; at most {CENTROID_BYTES} can be held by every task")

    @property
    def n_cells(self) -> int:
        return len(self.centroids)


def cells_for(rows: int) -> int:
    """Number of cells for a corpus: the square root of its rows, cells of bounded size."""
    return max(1, min(rows // LEAST_CELL_ROWS, max(round(rows**0.5), rows // MOST_CELL_ROWS)))


def build_index(
    corpus: DataFrame, n_cells: int | None = None, *, metric: str = "cosine", vector: str = "embedding", seed: int = 7
) -> CellIndex:
    """Train centroids by k-means on all rows; ``n_cells`` follows from their number if not given."""
    metric = metric_name(metric)
    v = normalize(F.col(vector)) if metric == "cosine" else F.col(vector).cast("array<double>")
    train = corpus.select(array_to_vector(v).alias("features"))
    n = corpus.count()
    model = KMeans(k=min(n_cells or cells_for(n), max(n, 1)), seed=seed, maxIter=10).fit(train)
    return CellIndex(np.array(model.clusterCenters()), metric)


def class_mean_index(corpus: DataFrame, category: str, *, metric: str = "cosine", vector: str = "embedding"):
    """Index with one cell per category, at the mean of its vectors; vectors are summed before the shuffle."""
    means = corpus.groupBy(category).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
    means = means.select(category, vector_to_array("m").alias("m"))
    rows = means.orderBy(category).collect()
    return CellIndex(np.array([r["m"] for r in rows]), metric_name(metric))


def _cell_keys(q: np.ndarray, index: CellIndex) -> np.ndarray:
    """Distance of every query row to every centroid, rounded to nine decimals."""
    c = index.centroids
    if index.metric == "euclidean":
        d = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * (q @ c.T)
        return sort_key(np.sqrt(np.maximum(d, 0.0)))
    if index.metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), COSINE_EPS)[:, None]
        return sort_key(1.0 - unit(q) @ unit(c).T)
    return sort_key(-(q @ c.T))


def _nearest(q: np.ndarray, index: CellIndex, n_probe: int) -> Iterator[np.ndarray]:
    """Numbers of the nearest cells of some queries after the others; nearest first."""
    step = max(1, (1 << 22) // index.n_cells)
    for at in range(0, len(q), step):
        keys = _cell_keys(q[at : at + step], index)
        if n_probe == 1:  # the first of equal ones, as in a stable order
            yield np.argmin(keys, axis=1)[:, None]
        else:
            yield np.argsort(keys, axis=1, kind="stable")[:, :n_probe]


def nearest_cells(index: CellIndex, vector: Column, n_probe: int = 1) -> Column:
    """Numbers of the ``n_probe`` nearest cells, nearest first; ties to the lower number."""
    ship_package()
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast(index)
    n_probe = max(1, min(n_probe, index.n_cells))

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        q = matrix(vectors)
        if not len(q):
            return pa.array([], pa.list_(pa.int32()))
        order = np.concatenate([*_nearest(q, shared.value, n_probe)]).astype(np.int32)
        offsets = (np.arange(len(q) + 1) * n_probe).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.reshape(-1)))

    return cells(vector)


def probed_bits(index: CellIndex, vector: Column, n_probe: int) -> Column:
    """The cells of ``nearest_cells`` as a bit for each cell of the index."""
    ship_package()
    shared = SparkSession.getActiveSession().sparkContext.broadcast(index)

    @F.arrow_udf("binary")
    def bits(vectors: pa.Array) -> pa.Array:
        values = []
        for near in _nearest(matrix(vectors), shared.value, n_probe):
            marks = np.zeros((len(near), shared.value.n_cells), dtype=bool)
            np.put_along_axis(marks, near, True, axis=1)
            values += [row.tobytes() for row in np.packbits(marks, axis=1)]
        return pa.array(values, pa.binary())

    return bits(vector)


def assign(index: CellIndex, corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """Corpus with its ``cell``; write it (see :func:`filed`) to search it repeatedly."""
    return corpus.withColumn("cell", F.get(nearest_cells(index, F.col(vector), 1), F.lit(0)))


def filed(index: CellIndex, corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """``assign`` written once, so that sizing and searching cells read what has been computed."""
    return written(assign(index, corpus, vector))


def search(
    index: CellIndex, queries: DataFrame, corpus: DataFrame, k: int = 0, *, n_probe: int = 8, query_id: str = "qid",
    query_vector: str = "embedding", id_col: str = "vec_id", vector: str = "embedding", category: str | None = None,
    block_rows: int = BLOCK_ROWS, leave_out_own: bool = False,
) -> DataFrame:
    """k nearest among the probed cells; result, and ``leave_out_own``, as in ``knn_join``.

    ``corpus`` may already carry ``cell``.  Cells that hold far more rows than others
    are split into blocks, so they become more tasks and not longer ones.
    """
    k = effective_k(k)
    rows = corpus if "cell" in corpus.columns else filed(index, corpus, vector)
    cat = F.col(category).cast("string") if category else F.lit(None).cast("string")
    c = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), cat.alias("c"), "cell")
    q = numbered(queries).select("qrow", F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"))
    searched = k + 1 if leave_out_own else k
    if n_probe >= index.n_cells:  # every query visits every cell: it is sent once for all of them
        return merge_top_k(all_pairs(q, c, searched, index.metric, block_rows, dim=index.centroids.shape[1]), k, leave_out_own)
    dim = index.centroids.shape[1]
    if n_probe * LEAST_SHARE >= index.n_cells:  # many cells: a query is sent once for each part of the corpus, not for each cell
        parts = parts_of(q, c, searched, dim)
        if n_probe > sum(parts[:2]):
            q = q.withColumn("probes", probed_bits(index, F.col("qv"), n_probe))
            return merge_top_k(all_pairs(q, c, searched, index.metric, block_rows, dim=dim, parts=parts), k, leave_out_own)
    q = q.withColumn("cell", F.explode_outer(nearest_cells(index, F.col("qv"), n_probe)))
    return merge_top_k(block_join(q, c, searched, index.metric, block_rows), k, leave_out_own)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours that the approximate search found."""
    hit = found.select("qid", "vec_id", F.lit(1.0).alias("hit"))
    return exact.join(hit, ["qid", "vec_id"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"), F.count(F.lit(1)).alias("n_pairs")
    )


def save_index(spark: SparkSession, index: CellIndex, path: str) -> None:
    rows = [(i, index.metric, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, metric string, centroid array<double>").write.parquet(path)


def load_index(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(path).orderBy("cell").collect()  # checked against CENTROID_BYTES when built
    return CellIndex(np.array([r["centroid"] for r in rows]), rows[0]["metric"])
