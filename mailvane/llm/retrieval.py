"""Exact top-k inner products: norm-bucketed retrieval.

Rows are grouped by length into bins, a bin into blocks of bounded size, and a block,
longest rows first, into buckets.  A query's k-th best score so far, over its own and
the bucket's greatest length, is the cosine a row of that bucket must reach.  A bin or
bucket where it exceeds 1 is left out; elsewhere that threshold chooses between pruning
by length and pruning by coordinates (the range a row's component may lie in, searched in
sorted lists), and what is left is verified by its product.

The first thresholds come from the longest rows of all, so bins that a query cannot
need are left out before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailvane.llm.intvectors import LOWEST, by_id, first_best, is_exact, products, whole_matrix, whole_rows
from mailvane.llm.shared import durable
from mailvane.shipping import ship_package

#: Bins of length to the doubling; with all lengths a double can have, under 33 000 bins.
BINS_PER_OCTAVE = 16
#: Rows of a bin that meet in one task, and queries that meet them.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Rows of a bucket.
BUCKET_ROWS = 512
#: Bytes of the longest rows that give the first thresholds.
SEED_BYTES = 4 << 20
#: Local cosine threshold from which coordinates are tried, and how many of a query's.
COORDINATES_FROM, FOCUS = 0.7, 3
#: A bucket's share that the narrowest coordinate must leave out for its list to be used.
LEAST_PRUNED = 0.75
#: Relative error allowed for in bounds made of doubles.
SLACK = 1e-9


def length_bin(length: np.ndarray) -> np.ndarray:
    """Number of the bin of each length, growing with it; -1 holds vectors of length 0."""
    with np.errstate(divide="ignore"):
        octave = np.log2(np.minimum(length, np.finfo(float).max))
    return np.where(length > 0, 2000 * BINS_PER_OCTAVE + np.floor(np.maximum(octave, -1999) * BINS_PER_OCTAVE), -1).astype(np.int64)


class LengthBuckets:
    """Rows of a block, longest first, in buckets; a row's place among equal scores is that of its id."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, place: np.ndarray):
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        order = np.lexsort((place, -length))
        self.row, self.matrix, self.place, self.length = rows[order], matrix[order], place[order], length[order]
        self.cuts = range(0, len(order), BUCKET_ROWS)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: pairs verified by their product, and buckets searched by coordinates or left out: what pruning did
        self.verified = self.by_coordinate = self.left_out = 0

    def _lists(self, at: int):
        """Unit vectors of a bucket, and their components sorted by coordinate."""
        if at not in self.sorted:
            part = slice(at, at + BUCKET_ROWS)
            unit = self.matrix[part] / np.maximum(self.length[part], 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self.sorted[at] = unit, order, np.take_along_axis(unit, order, axis=0)
        return self.sorted[at]

    def _by_coordinates(self, at: int, unit_query: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows of a bucket whose focus coordinates allow the cosine; None where they leave out too few."""
        unit, order, values = self._lists(at)
        focus = np.argsort(-np.abs(unit_query), kind="stable")[:FOCUS]
        angle, spread = np.arccos(np.clip(unit_query[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low = np.cos(np.minimum(np.pi, angle + spread)) - SLACK
        high = np.cos(np.maximum(0.0, angle - spread)) + SLACK
        ranges = [(np.searchsorted(values[:, f], lo), np.searchsorted(values[:, f], hi, side="right")) for f, lo, hi in zip(focus, low, high)]
        narrow = int(np.argmin([hi - lo for lo, hi in ranges]))
        first, last = ranges[narrow]
        if last - first > (1 - LEAST_PRUNED) * len(unit):
            return None
        rows = order[first:last, focus[narrow]]
        inside = ((unit[np.ix_(rows, focus)] >= low) & (unit[np.ix_(rows, focus)] <= high)).all(axis=1)
        return np.sort(rows[inside]) + at

    def search(self, query_rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """k best rows of every query with a score of at least ``least``: query, position, score."""
        n, exact = len(queries), is_exact(queries, self.matrix)
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = queries / np.maximum(size, 1e-300)[:, None]
        least = least.copy()
        q = position = score = np.zeros(0, dtype=np.int64)
        for at in self.cuts:
            longest = self.length[at]
            with np.errstate(invalid="ignore", over="ignore"):
                reach = size * longest
                # where numbers are too large for doubles to be exact, nothing is left out
                short = (reach * (1 + SLACK) < least) if exact else np.zeros(n, dtype=bool)
            open_ = np.flatnonzero(~short)
            self.left_out += n - len(open_)
            if not len(open_):
                break  # later buckets hold shorter rows only
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where((least > 0) & (reach > 0), least / reach * (1 - SLACK), 0.0)
            picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            whole = []
            for i in open_:
                rows = self._by_coordinates(at, unit[i], cosine[i]) if exact and cosine[i] >= COORDINATES_FROM else None
                if rows is None:
                    whole.append(i)
                    continue
                self.by_coordinate += 1
                self.verified += len(rows)
                picked.append((np.full(len(rows), i), rows, products(queries[i : i + 1], self.matrix[rows])[0]))
            if whole:
                i = np.array(whole)
                # rows by length: those the least demanding of these queries can need
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where((least[i] > 0) & (size[i] > 0), least[i] / size[i] * (1 - SLACK), 0.0).min() if exact else 0.0
                stop = at + int(np.searchsorted(-self.length[at : at + BUCKET_ROWS], -needed, side="right"))
                self.verified += len(i) * (stop - at)
                found = products(queries[i], self.matrix[at:stop])
                r, c = np.nonzero(found >= least[i][:, None])
                picked.append((i[r], c + at, found[r, c]))
            q = np.concatenate([q, *[p[0] for p in picked]])
            position = np.concatenate([position, *[p[1] for p in picked]])
            score = np.concatenate([score, *[p[2] for p in picked]])
            fine = (score >= least[q]) & (self.row[position] != query_rows[q])
            q, position, score = q[fine], position[fine], score[fine]
            best = first_best(q, score, self.place[position], k)
            q, position, score = q[best], position[best], score[best]
            full = np.bincount(q, minlength=n) >= k
            lowest = np.full(n, LOWEST)
            lowest[q] = score  # best first, so the last one stays
            least = np.where(full, np.maximum(least, lowest), least)
        return q, position, score


def _seeded(seed_rows: np.ndarray, seeds: np.ndarray, bins: dict[int, int], scale: float, dim: int, k: int):
    """Queries with the k-th best score among the seeds, and the bins that can hold better ones."""
    numbers = np.array(sorted(bins), dtype=np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                q = whole_matrix(batch.column("v"), scale, dim)
                own = batch.column("row").to_numpy()
                least, needed = np.full(len(q), LOWEST), np.zeros(len(q))
                if len(seeds) > k:
                    s = products(q, seeds)
                    s[own[:, None] == seed_rows[None, :]] = LOWEST
                    least = np.partition(s, len(seeds) - k, axis=1)[:, len(seeds) - k]
                if is_exact(q, seeds):
                    size = batch.column("length").to_numpy()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        needed = np.where((least > 0) & (size > 0), least / size * (1 - 4 * SLACK), 0.0)
                low = np.searchsorted(numbers, np.where(needed > 0, length_bin(needed), -1))
                n = len(numbers) - low
                reach = pa.array(numbers[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), reach)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("v"), pa.array(least), lists], ["row", "id", "v", "least", "bins"])

    return first


def _binned(rows: DataFrame) -> DataFrame:
    @F.arrow_udf("long")
    def bin_of(length: pa.Array) -> pa.Array:
        return pa.array(length_bin(length.to_numpy(zero_copy_only=False)))

    return rows.withColumn("bin", bin_of("length"))


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, seed_bytes: int = SEED_BYTES,
) -> DataFrame:
    """Of every query row, the k other rows of highest inner product: ``query_id, rank, vec_id, score``.

    Components are floored after scaling; scores are exact, and held at the ends of the
    long range.  Ties go to the smaller id, null ids last.  Vectors that are null or hold
    a null or non-finite component take no part; a shorter vector counts as ended by zeros.
    Every row is one of its own, also where ids or vectors repeat: only a query's own
    row is left out.  ``is_query`` being null is no query.  All other columns are left alone.
    An empty table, and one without queries, give an empty result.
    """
    ship_package()
    spark = vectors.sparkSession
    asked = F.coalesce(is_query, F.lit(False))
    rows = durable(_binned(whole_rows(vectors, id_col, vector_col, scale, asked=asked)))
    id_type = rows.schema["id"].dataType
    sizes = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).collect()  # under 33 000
    out = T.StructType([T.StructField("qrow", T.LongType()), T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])
    dim = max([1, *[r["dim"] for r in sizes]])
    longest = rows.orderBy(F.desc("length"), "row").limit(max(k + 1, seed_bytes // (8 * dim))).select("row", "v").toArrow()
    first = _seeded(longest["row"].to_numpy(), whole_matrix(longest["v"], scale, dim), {r["bin"]: r["n"] for r in sizes}, scale, dim, k)
    seeded = T.StructType([rows.schema["row"], rows.schema["id"], rows.schema["v"], T.StructField("least", T.LongType()), T.StructField("bins", T.ArrayType(T.LongType()))])
    queries = durable(rows.where("asked").select("row", "id", "v", "length").mapInArrow(first, seeded))

    reached = queries.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("qn"))
    blocks = lambda n, most: F.ceil(F.col(n) / F.lit(float(most))).cast("int")
    bins = spark.createDataFrame([(r["bin"], r["n"]) for r in sizes], "bin long, n long")
    bins = F.broadcast(bins.join(F.broadcast(reached), "bin").select("bin", blocks("n", block_rows).alias("parts"), blocks("qn", block_queries).alias("q_parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    q = queries.select("row", "id", "v", "least", F.explode("bins").alias("bin")).join(bins, "bin")
    q = q.select("row", "id", "v", "least", "bin", part("q_parts").alias("q_part"), every("parts").alias("part"))
    c = rows.join(bins, "bin").select("row", "id", "v", "bin", part("parts").alias("part"), every("q_parts").alias("q_part"))
    keys = ["bin", "part", "q_part"]

    def meet(asking: pa.Table, given: pa.Table) -> pa.Table:
        schema = pa.schema([("qrow", pa.int64()), ("query_id", asking.schema.field("id").type), ("vec_id", given.schema.field("id").type), ("score", pa.int64())])
        if not len(asking) or not len(given):
            return schema.empty_table()
        ids = given["id"].combine_chunks()
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id(ids)] = np.arange(len(ids))
        block = LengthBuckets(given["row"].to_numpy(), whole_matrix(given["v"], scale, dim), place)
        back = np.argsort(place, kind="stable")
        own = asking["row"].to_numpy()
        qi, position, score = block.search(own, whole_matrix(asking["v"], scale, dim), asking["least"].to_numpy(), k)
        return pa.Table.from_arrays([pa.array(own[qi]), asking["id"].combine_chunks().take(pa.array(qi)), ids.take(pa.array(back[block.place[position]])), pa.array(score)], schema=schema)

    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, out)
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products_report(vectors: DataFrame) -> DataFrame:
    """The five best rows of every vector whose id is divisible by 50."""
    return top_products(vectors, F.col("vec_id") % 50 == 0)


#: The same rows as a join of all pairs.
TOP_PRODUCTS_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.n ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.n <> c.n) WHERE rank <= 5"""
