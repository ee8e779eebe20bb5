"""Exact k-nearest-neighbour search as joins between a query and a corpus table.

Three plans, chosen by counted sizes; all give the same rows:

* the corpus fits a broadcast: queries stream past it, no shuffle at all
  (``neighbours_udf`` is that plan as a column);
* the queries fit a broadcast: the corpus streams past them, each task keeps its
  k best per query, and only those are shuffled;
* neither fits: both sides are dealt to a grid of tasks, as compressed blocks; a task opens
  some of its queries at a time, blocks of its part of the corpus pass them, and the k best
  per query and task are merged.

No plan builds row pairs; ties on the distance (nine decimals) go to the smaller id.
Every query row has its own neighbours, also where an id repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailvane.functions import fixed_values as V
from mailvane.functions.vectors import check_dim, distance, metric_name
from mailvane.operators.kernels import KEY_SCALE, Block, Nearest, matrix, sort_key
from mailvane.shipping import ship_package

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 16384
#: Vectors of queries and of the corpus that a task of two large sides is sent (compressed), and of queries that it opens at a time.
HELD_BYTES, SENT_BYTES, OPEN_BYTES = 384 << 20, 512 << 20, 64 << 20
#: Neighbours that a task holds for the queries open at a time, and that it returns; bytes of one of those.
OPEN_FOUND, MOST_FOUND, FOUND_BYTES = 1 << 20, 4 << 20, 48
#: Neighbours that all queries of a broadcast may find.
MOST_BROADCAST_FOUND = 1 << 21
#: Sides are not dealt to all cores in parts smaller than this.
SMALL_ROWS = 1024


def effective_k(k: int) -> int:
    return k if k > 0 else V.DEFAULT_TOP_K


def vector_dim(df: DataFrame, vector: str) -> int | None:
    row = df.select(F.size(vector).alias("n")).first()
    return None if row is None else check_dim(row["n"])


def fits_broadcast(df: DataFrame, dim: int, limit_bytes: int) -> bool:
    """Counted check, reading no more rows than the bound needs."""
    rows = limit_bytes // (8 * dim)
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def _distance_key(d: Column) -> Column:
    return F.floor(d * F.lit(KEY_SCALE) + F.lit(0.5)).cast("long")


def knn_single(
    corpus: DataFrame, query: list[float], k: int = 0, *, metric: str = "cosine", id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """k nearest rows of one literal vector: a projection and a bounded sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = distance(metric)(F.col(vector), q)
    return (
        corpus.select(F.col(id_col), d.alias("distance"))
        .orderBy(_distance_key(F.col("distance")), F.col(id_col))
        .limit(effective_k(k))
    )


def collect_block(corpus: DataFrame, id_col: str, vector: str, category: str | None, metric: str, k: int) -> Block:
    """A corpus whose size has been checked, as one searchable block."""
    cat = F.col(category).cast("string") if category else F.lit(None).cast("string")
    t = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), cat.alias("c")).toArrow().combine_chunks()
    chunk = lambda name: t[name].combine_chunks()
    return Block(chunk("id"), matrix(t["v"]), chunk("c"), metric, k)


def neighbour_type(id_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(
        T.StructType(
            [
                T.StructField("category", T.StringType()),
                T.StructField("vec_id", id_type),
                T.StructField("distance", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
    )


def neighbours_udf(
    corpus: DataFrame, k: int, *, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding",
    category: str | None = None,
) -> Callable[[Column], Column]:
    """Column function: query vector -> its nearest corpus rows, per category.

    For a corpus that passed ``fits_broadcast``.  The query rows keep all their other
    columns and stay where they are, so scoring needs no join back.
    """
    ship_package()
    spark, k = corpus.sparkSession, effective_k(k)
    out_type = neighbour_type(corpus.schema[id_col].dataType)
    shared = spark.sparkContext.broadcast(collect_block(corpus, id_col, vector, category, metric, k))

    @F.arrow_udf(out_type)
    def neighbours(queries: pa.Array) -> pa.Array:
        block = shared.value
        r, c, d, rank = block.search(matrix(queries))
        names = pa.array([None, *block.names], pa.string())
        structs = pa.StructArray.from_arrays(
            [
                names.take(pa.array(block.code[c] + 1)),
                block.ids.take(pa.array(c)),
                pa.array(d),
                pa.array(rank, pa.int32()),
            ],
            names=["category", "vec_id", "distance", "rank"],
        )
        offsets = np.searchsorted(r, np.arange(len(queries) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), structs)

    return neighbours


def _candidate_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qrow", T.LongType()),
            T.StructField("qid", query_type),
            T.StructField("category", T.StringType()),
            T.StructField("vec_id", id_type),
            T.StructField("distance", T.DoubleType()),
            T.StructField("dkey", T.LongType()),
        ]
    )


def numbered(queries: DataFrame) -> DataFrame:
    """Queries with ``qrow``, a number for each row."""
    return queries.withColumn("qrow", F.monotonically_increasing_id())


def _candidates(block: Block, qrows: pa.Array, qids: pa.Array, queries: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    r, c, d, _ = block.search(queries)
    names = pa.array([None, *block.names], pa.string())
    columns = [
        qrows.take(pa.array(r)),
        qids.take(pa.array(r)),
        names.take(pa.array(block.code[c] + 1)),
        block.ids.take(pa.array(c)),
        pa.array(d),
        pa.array(sort_key(d)),
    ]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)


def others(neighbours: Column, own_id: Column, k: int) -> Column:
    """Of an array of k + 1 neighbours per category, the k nearest that are not the row ``own_id`` itself."""
    is_own = lambda n: n["vec_id"].eqNullSafe(own_id)
    own = F.get(F.filter(neighbours, is_own), F.lit(0))
    # one less where the own row of that category came before
    rank = lambda n: (
        n["rank"] - F.when(n["category"].eqNullSafe(own["category"]) & (own["rank"] < n["rank"]), 1).otherwise(0)
    ).cast("int")
    moved = lambda n: F.struct(n["category"].alias("category"), n["vec_id"].alias("vec_id"), n["distance"].alias("distance"), rank(n).alias("rank"))
    return F.filter(F.transform(F.filter(neighbours, lambda n: ~is_own(n)), moved), lambda n: n["rank"] <= k)


def merge_top_k(candidates: DataFrame, k: int, leave_out_own: bool = False) -> DataFrame:
    """Final k nearest per query row and category out of per-block bests.

    Spark cuts each task's rows to k per group before the shuffle.  ``leave_out_own``
    drops the row of the query's own id first; blocks must have returned k + 1 then.
    """
    if leave_out_own:
        candidates = candidates.where(~F.col("qid").eqNullSafe(F.col("vec_id")))
    w = Window.partitionBy("qrow", "category").orderBy("dkey", "vec_id")
    return (
        candidates.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("qid", "category", "vec_id", "distance", "rank")
    )


def _query_broadcast(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    ship_package()
    spark = queries.sparkSession
    t = queries.toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((t["qid"].combine_chunks(), matrix(t["qv"])))
    out = _candidate_schema(queries.schema["qid"].dataType, corpus.schema["id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qs = shared.value
        near = Nearest(qs, k)
        for batch in batches:
            near.meet(Block(batch["id"], matrix(batch["v"]), batch["c"], metric, k))
        yield from _found(near, pa.array(np.arange(len(qs))), qids)

    return corpus.select("id", "v", "c").mapInArrow(scan, out)


def _found(near: Nearest, qrows: pa.Array, qids: pa.Array) -> Iterator[pa.RecordBatch]:
    for r, category, ids, d in near.batches():
        r = pa.array(r)
        yield pa.RecordBatch.from_arrays(
            [qrows.take(r), qids.take(r), category, ids, pa.array(d), pa.array(sort_key(d))],
            names=["qrow", "qid", "category", "vec_id", "distance", "dkey"],
        )


def meet_blocks(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of a block of queries (``qrow, qid, qv``) and a block of rows (``id, v, c``): its candidates."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("qrow", pa.int64()),
                ("qid", left.schema.field("qid").type),
                ("category", pa.string()),
                ("vec_id", right.schema.field("id").type),
                ("distance", pa.float64()),
                ("dkey", pa.int64()),
            ]
        )
        if not len(left) or not len(right):
            return schema.empty_table()
        block = Block(
            right["id"].combine_chunks(), matrix(right["v"]), right["c"].combine_chunks(), metric, k
        )
        batch = _candidates(block, left["qrow"].combine_chunks(), left["qid"].combine_chunks(), matrix(left["qv"]), schema)
        return pa.Table.from_batches([batch])

    return meet


def grid(n_queries: int, n_rows: int, dim: int, cores: int, found: int = 0) -> tuple[int, int]:
    """Parts of the queries and of the corpus; each part of one meets each of the other in a task.

    No fewer than bounded tasks need, and enough for all cores where parts do not get small;
    among these the ones that send least.  A query is sent once for each part of the corpus, with
    ``found`` rows sent back, and a row once for each part of the queries.
    """
    least = lambda n, size: max(1, -(-n * 8 * dim // size))
    most = lambda n, low: max(low, -(-n // SMALL_ROWS))
    q_low, c_low = max(least(n_queries, HELD_BYTES), -(-n_queries * found // MOST_FOUND)), least(n_rows, SENT_BYTES)
    q_most, c_most = most(n_queries, q_low), most(n_rows, c_low)
    wanted = min(4 * cores, q_most * c_most)
    # for each number of query parts, as many parts of the corpus as give tasks enough
    choices = [(q, max(c_low, -(-wanted // q))) for q in range(q_low, max(q_low, min(q_most, wanted)) + 1)]
    return min((x for x in choices if x[1] <= c_most), key=lambda x: (n_rows * x[0] * 8 * dim + n_queries * x[1] * (8 * dim + found * FOUND_BYTES), x))


def _dealt(rows: DataFrame, parts: int, name: str, block_rows: int) -> DataFrame:
    """``(name, rows)``: of every ``block_rows`` rows or fewer an equal share for each part, compressed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

        def shares(held: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cuts = [len(t) * i // parts for i in range(parts + 1)]
            to, values = [], []
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema, options=options) as out:
                        out.write_table(t.slice(lo, hi - lo))
                    to.append((first + i) % parts)
                    values.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(values, pa.binary())], names=[name, "rows"])

        # parts take turns in having the odd row
        held, n, first = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block_rows - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == block_rows:
                    yield shares(held, first)
                    held, n, first = [], 0, first + 1
        if held:
            yield shares(held, first)

    return rows.mapInArrow(deal, f"{name} int, rows binary")


def _opened(blocks: pa.Table, block_rows: int) -> Iterator[pa.Table]:
    """Compressed blocks, opened one after the other; small ones together."""
    held, n = [], 0
    for value in blocks["rows"]:
        t = pa.ipc.open_stream(value.as_buffer()).read_all()
        if held and n + len(t) > block_rows:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _bits(rows: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as a matrix of bytes."""
    return np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in rows])


def _meet_parts(k: int, metric: str, schema: pa.Schema, block_rows: int, held_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of a part of the queries and a part of the corpus, both as blocks: the candidates of the part.

    Some ``held_rows`` queries are open at a time, and one block of the corpus.  Queries with
    ``probes``, a bit for each cell, meet only the rows of these cells.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        found = []
        for held in (t.slice(at, held_rows) for t in _opened(left, held_rows) for at in range(0, len(t), held_rows)):
            near = Nearest(matrix(held["qv"]), k)
            probing = "probes" in held.column_names
            if probing:
                near.only(_bits(held["probes"]))
            for t in _opened(right, block_rows):
                cells = np.asarray(t["cell"]) if probing else None
                near.meet(Block(t["id"].combine_chunks(), matrix(t["v"]), t["c"].combine_chunks(), metric, k, cells))
            found += [b.cast(schema) for b in _found(near, held["qrow"].combine_chunks(), held["qid"].combine_chunks())]
        return pa.Table.from_batches(found, schema)

    return meet


def sizes_of(corpus: DataFrame, k: int) -> tuple[int, int]:
    """Rows of a corpus ``(c, ...)``, and how many of them a query can find at most."""
    n, names, unnamed = corpus.agg(F.count(F.lit(1)), F.count_distinct("c"), F.max(F.col("c").isNull().cast("int"))).first()
    return n, min(n, k * (names + (unnamed or 0)))


def parts_of(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> tuple[int, int, int]:
    """Parts of both sides (see :func:`grid`), and how many rows a query can find at most."""
    n_rows, found = sizes_of(corpus, k)
    # more tasks than two a core would only send each row more often
    cores = -(-queries.sparkSession.sparkContext.defaultParallelism // 2)
    return *grid(queries.count(), n_rows, dim, cores, found), found


def all_pairs(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_rows: int = BLOCK_ROWS, *, dim: int,
    parts: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Candidates of all queries ``(qrow, qid, qv)`` among all rows ``(id, v, c)`` of a corpus, by a grid of tasks.

    A task opens some of its part of the queries at a time, and blocks of ``block_rows`` rows of
    its part of the corpus pass them; the k-th distances so far cut later blocks.  It returns k
    rows for each of its queries and categories, of which it holds a bounded number.  With ``probes``,
    a bit for each cell, and a corpus with ``cell`` a query finds only rows of its cells.
    """
    ship_package()
    out = _candidate_schema(queries.schema["qid"].dataType, corpus.schema["id"].dataType)
    q_parts, c_parts, found = parts or parts_of(queries, corpus, k, dim)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    more = (["probes"], ["cell"]) if "probes" in queries.columns else ([], [])
    q = _dealt(queries.select("qrow", "qid", "qv", *more[0]), q_parts, "qb", block_rows).select("qb", every(c_parts, "cb"), "rows")
    c = _dealt(corpus.select("id", "v", "c", *more[1]), c_parts, "cb", block_rows).select(every(q_parts, "qb"), "cb", "rows")
    held = min(max(block_rows, OPEN_BYTES // (8 * dim)), max(SMALL_ROWS, OPEN_FOUND // max(found, 1)))
    meet = _meet_parts(k, metric, to_arrow_schema(out), block_rows, held)
    # so many partitions that few hold two parts; a given number is not made fewer by size, as the work is in the pairs
    apart = lambda df: df.repartition(4 * q_parts * c_parts, "qb", "cb").groupBy("qb", "cb")
    return apart(q).cogroup(apart(c)).applyInArrow(meet, out)


def block_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Candidates from all pairs of blocks of the same cell.

    ``queries`` is ``(qrow, qid, qv, cell)``, one row per probed cell, ``corpus`` is ``(id, v, c, cell)``.
    Blocks hold about ``block_rows`` rows, split by a hash of the
    id, so no task sees more than about one block of each side, however the rows
    spread over the cells.
    """
    ship_package()
    out = _candidate_schema(queries.schema["qid"].dataType, corpus.schema["id"].dataType)
    # one row per cell; their centroids are broadcast as well.  Broadcast, because a shuffle by cell would
    # bring the rows of a large cell together before they are split
    parts = lambda n: F.ceil(F.col(n) / F.lit(float(block_rows))).cast("int")
    sizes = (
        corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("cn"))
        .join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("qn")), "cell")
        .select("cell", parts("cn").alias("c_parts"), parts("qn").alias("q_parts"))
    )
    queries, corpus = queries.join(F.broadcast(sizes), "cell"), corpus.join(F.broadcast(sizes), "cell")
    split = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.select("qrow", "qid", "qv", "cell", split("qrow", "q_parts").alias("qb"), every("c_parts").alias("cb"))
    c = corpus.select("id", "v", "c", "cell", split("id", "c_parts").alias("cb"), every("q_parts").alias("qb"))
    keys = ["cell", "qb", "cb"]

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet_blocks(k, metric), out)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 0,
    *,
    metric: str = "cosine",
    query_id: str = "qid",
    query_vector: str = "embedding",
    id_col: str = "vec_id",
    vector: str = "embedding",
    category: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    dim: int | None = None,
    plan: str | None = None,
    leave_out_own: bool = False,
) -> DataFrame:
    """k nearest corpus rows of every query, within each category if one is named.

    Result ``(qid, category, vec_id, distance, rank)``; ``category`` is null without one.
    ``leave_out_own`` leaves out the corpus row that has the query's own id (ids of a
    corpus are unique): one neighbour more is searched, and the own row goes before ranking.
    ``dim`` spares a look at the first vector.  ``plan`` (``corpus``, ``queries`` or
    ``blocks``: what is broadcast) is for a caller who knows the sizes; queries beyond
    ``broadcast_bytes`` go to the tasks in blocks instead.
    """
    k, metric = effective_k(k), metric_name(metric)
    searched = k + 1 if leave_out_own else k
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"))
    cat = F.col(category).cast("string") if category else F.lit(None).cast("string")
    c = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), cat.alias("c"))
    dim = dim or vector_dim(c, "v")
    if dim is None:
        empty = _candidate_schema(q.schema["qid"].dataType, c.schema["id"].dataType)
        return merge_top_k(queries.sparkSession.createDataFrame([], empty), k)
    if plan not in (None, "corpus", "queries", "blocks"):
        raise ValueError("plan is 'corpus', 'queries' or 'blocks'")
    if plan == "corpus" or plan is None and fits_broadcast(c, dim, broadcast_bytes):
        near = neighbours_udf(c, searched, metric=metric, id_col="id", vector="v", category="c")
        found = q.select("qid", near(F.col("qv")).alias("n"))
        if leave_out_own:
            found = found.select("qid", others(F.col("n"), F.col("qid"), k).alias("n"))
        return (
            found
            .select("qid", F.inline_outer("n"))  # plain inline would add a filter that searches twice
            .where("vec_id IS NOT NULL")
            .select("qid", "category", "vec_id", "distance", "rank")
        )
    # each task holds what all broadcast queries have found
    if plan in (None, "queries") and fits_broadcast(q, dim, min(broadcast_bytes, 8 * dim * (MOST_BROADCAST_FOUND // max(sizes_of(c, searched)[1], 1)))):
        return merge_top_k(_query_broadcast(q, c, searched, metric), k, leave_out_own)
    return merge_top_k(all_pairs(numbered(q), c, searched, metric, block_rows, dim=dim), k, leave_out_own)


def knn_similarity(queries: DataFrame, corpus: DataFrame, k: int = 0, **kwargs) -> DataFrame:
    """Similarity-descending form of the cosine search; ``(qid, vec_id, score, rank)``."""
    found = knn_join(queries, corpus, k, metric="cosine", **kwargs)
    return found.select("qid", "vec_id", (1.0 - F.col("distance")).alias("score"), "rank")
