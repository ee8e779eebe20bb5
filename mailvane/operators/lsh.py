"""Approximate k-NN by signed random projections: several tables of codes, an equi-join, exact re-ranking.

A code is the signs of a vector's products with the planes of its table; vectors at a
small angle share it often.  Queries and rows meet where (table, code) is equal, and
each meeting pair is compared exactly.  Works for the cosine distance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailvane.operators.kernels import Block, matrix, sort_key
from mailvane.operators.knn import BLOCK_ROWS, effective_k, merge_top_k, numbered
from mailvane.shipping import ship_package
from mailvane.sources.tables import written

#: A table of overfull buckets up to this many rows is broadcast.
BROADCAST_BUCKETS = 1 << 20


@dataclass(frozen=True)
class SignCodes:
    """Planes of +1 and -1 that follow from their numbers, so that nothing has to be stored or sent."""

    dim: int
    tables: int = 10
    bits: int = 12

    def __post_init__(self):
        if self.dim < 1 or self.tables < 1 or not 1 <= self.bits <= 62:
            raise ValueError("at least one dimension and table, and 1 to 62 bits")

    def planes(self) -> np.ndarray:
        sign = lambda p, d: 1.0 if hashlib.md5(f"{p}:{d}".encode()).hexdigest()[0] >= "8" else -1.0
        return np.array([[sign(p, d) for d in range(self.dim)] for p in range(self.tables * self.bits)])

    def column(self, vector: Column) -> Column:
        """``array<long>``: the code of a vector in each table."""
        ship_package()
        planes, tables, bits = self.planes(), self.tables, self.bits

        @F.arrow_udf("array<long>")
        def codes(vectors: pa.Array) -> pa.Array:
            m = matrix(vectors)
            signs = (m @ planes.T >= 0).reshape(len(m), tables, bits) if len(m) else np.zeros((0, tables, bits), bool)
            numbers = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * tables, pa.int32()), pa.array(numbers.ravel()))

        return codes(vector)


def coded(codes: SignCodes, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """A row per table: ``df`` with ``tab`` and ``code``."""
    return df.select("*", F.posexplode(codes.column(F.col(vector))).alias("tab", "code"))


def _overfull(df: DataFrame, name: str, block_rows: int) -> DataFrame:
    parts = F.ceil(F.col("count") / F.lit(float(block_rows))).cast("int").alias(name)
    return df.groupBy("tab", "code").count().where(F.col("count") > block_rows).select("tab", "code", parts)


def _compare(k: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("qrow", pa.int64()), ("qid", left.schema.field("qid").type), ("category", pa.string()), ("vec_id", right.schema.field("id").type),
             ("distance", pa.float64()), ("dkey", pa.int64()), ("row", pa.int64())]
        )
        if not len(left) or not len(right):
            return schema.empty_table()
        right = right.sort_by([("tab", "ascending"), ("code", "ascending"), ("id", "ascending")]).combine_chunks()
        left = left.combine_chunks()
        # buckets are ranges of the sorted rows
        tab, code = right["tab"].to_numpy(), right["code"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (code[1:] != code[:-1]), True])
        place = {key: n for n, key in enumerate(zip(tab[cuts[:-1]].tolist(), code[cuts[:-1]].tolist()))}
        at = np.array([place.get(key, -1) for key in zip(left["tab"].to_pylist(), left["code"].to_pylist())])
        asked = np.flatnonzero(at >= 0)
        asked = asked[np.argsort(at[asked], kind="stable")]  # queries of a bucket together
        q, rows = matrix(left["qv"]), matrix(right["v"])
        out = [schema.empty_table()]
        turns = np.flatnonzero(np.r_[True, np.diff(at[asked]) != 0, True]) if len(asked) else np.zeros(1, dtype=np.int64)
        for lo, hi in zip(turns[:-1], turns[1:]):
            i, bucket = asked[lo:hi], at[asked[lo]]
            # places stand for the ids: both are in one order
            places = np.arange(cuts[bucket], cuts[bucket + 1])
            block = Block(pa.array(places), rows[places], None, "cosine", k)
            r, c, d, _ = block.search(q[i])
            r, c = pa.array(i[r]), block.ids.take(pa.array(c))
            columns = [left["qrow"].take(r), left["qid"].take(r), pa.nulls(len(r), pa.string()), right["id"].take(c), pa.array(d), pa.array(sort_key(d)), right["row"].take(c)]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out)

    return meet


def lsh_search(
    codes: SignCodes, queries: DataFrame, corpus: DataFrame, k: int = 0, *, query_id: str = "qid", query_vector: str = "embedding",
    id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """k nearest, by cosine, of the rows that share a code with a query; and ``(qid, rows_compared)``.

    The result is as that of ``knn_join``; a query may have fewer than k.  Buckets are
    dealt to tasks by hash; those with more rows or queries than a block are split.
    """
    k = effective_k(k)
    rows = corpus.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector).alias("v"))
    c = written(coded(codes, rows, "v"))
    q = numbered(queries).select("qrow", F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"))
    q = written(coded(codes, q, "qv"))
    large = written(_overfull(c, "parts", block_rows).join(_overfull(q, "q_parts", block_rows), ["tab", "code"], "full"))
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    cells = max(1, -(-(c.count() + q.count()) // block_rows))
    cell = F.pmod(F.xxhash64("tab", "code"), F.lit(cells)).cast("int").alias("cell")
    parts = lambda name: F.coalesce(F.col(name), F.lit(1))
    own = lambda key, name: F.pmod(F.xxhash64(key), parts(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), parts(name) - 1))
    q_side = q.join(large, ["tab", "code"], "left").select("qrow", "qid", "qv", "tab", "code", cell, own("qrow", "q_parts").alias("qb"), every("parts").alias("cb"))
    c_side = c.join(large, ["tab", "code"], "left").select("row", "id", "v", "tab", "code", cell, own("row", "parts").alias("cb"), every("q_parts").alias("qb"))
    keys = ["cell", "qb", "cb"]
    out = T.StructType(
        [T.StructField("qrow", T.LongType()), q.schema["qid"], T.StructField("category", T.StringType()),
         T.StructField("vec_id", c.schema["id"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("dkey", T.LongType()),
         T.StructField("row", T.LongType())]
    )
    found = q_side.groupBy(*keys).cogroup(c_side.groupBy(*keys)).applyInArrow(_compare(k), out)
    # one shuffle serves both: a row found in several tables counts once, then the k best stay
    once = found.repartition("qrow").dropDuplicates(["qrow", "row"])
    sizes = c.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("n"))
    compared = q.join(sizes, ["tab", "code"], "left").groupBy("qrow", "qid").agg(F.sum(F.coalesce("n", F.lit(0))).alias("rows_compared"))
    return merge_top_k(once, k), compared.drop("qrow")
