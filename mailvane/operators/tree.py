"""Two-level centroid tree: rows filed by cell with a radius, and search that stops by bounds.

Groups (the square root of the number of cells) are few enough for every task; cells
are a table.  A row goes to its nearest group by lookup and to the nearest cell of that
group by a join, so no array of all centroids exists anywhere.  Each cell knows how far its
farthest row is from its centre; with a query's k-th distance so far, the triangle
inequality tells which cells it can leave out.  The first k-th distance comes from the
query's own cell, and later rounds take only queries whose bound has not closed.

Exact for all metrics: cosine is searched among unit vectors, and for the dot product a
cell's best is bounded by its centre's product and its radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailvane.functions.fixed_values import COSINE_EPS
from mailvane.functions.vectors import metric_name, normalize
from mailvane.operators.kernels import Block, matrix, sort_key, top_k
from mailvane.operators.knn import BLOCK_ROWS, _candidate_schema, effective_k, meet_blocks, merge_top_k, numbered
from mailvane.shipping import ship_package
from mailvane.sources.tables import written

#: Groups that every task may hold, with their centres; the square root of the number of cells, and one per category.
MOST_GROUPS = 65_536
#: Rows of a group that are filed in one task, queries that are routed in one, and queries that visit a group in one.
FILED_ROWS, ROUTED_ROWS, VISITORS = 65_536, 4096, 32_768
#: A table of cells up to this many rows is broadcast where it is joined.
BROADCAST_CELLS = 1 << 20
#: Error that bounds made of matrix products may have, relative to the numbers in them.
SLACK = 1e-7


@dataclass(frozen=True)
class CentroidTree:
    """``groups(group, category, centre, radius)``, ``cells(cell, group, category, centre, radius, n_rows, parts)`` and
    ``rows(id, v, c, group, cell)``, all of them written tables."""

    groups: DataFrame
    cells: DataFrame
    rows: DataFrame
    metric: str

    def save(self, path: str) -> None:
        for name in ("groups", "cells", "rows"):
            getattr(self, name).withColumn("metric", F.lit(self.metric)).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CentroidTree:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("groups", "cells", "rows")]
        metric = tables[0].select("metric").first()
        return CentroidTree(*[t.drop("metric") for t in tables], metric["metric"] if metric else "cosine")


def tree_cells(rows: int) -> int:
    """Cells for a corpus: as many groups, cells in a group, and rows in a cell."""
    return max(1, round(rows ** (2 / 3)))


def in_space(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are compared: unit vectors for cosine (zeros where there is no direction)."""
    if metric != "cosine" or not v.size:
        return v
    n = np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.where((n < COSINE_EPS)[:, None], 0.0, v / np.maximum(n, COSINE_EPS)[:, None])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of both sides."""
    sq = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every query and cell: how near the cell is, and the least distance one of its rows can have."""
    length = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    size = np.sqrt(np.einsum("ij,ij->i", centres, centres)) + radius
    if metric == "euclidean":
        apart = _apart(q, centres)
        return apart, np.maximum(apart - radius, 0.0) - SLACK * (length + size)
    product = q @ centres.T
    least = -(product + length * radius)
    if metric == "dot":
        return -product, least - SLACK * (1.0 + length * size)
    chord = np.maximum(_apart(q, centres) - radius, 0.0) ** 2 / 2
    return 1.0 - product, np.maximum(1.0 + least, chord) - 4 * SLACK


class _Groups:
    """Centres of all groups, by category."""

    def __init__(self, table: pa.Table):
        self.number = table["group"].to_numpy()
        self.centres = matrix(table["centre"])
        self.radius = table["radius"].to_numpy() if "radius" in table.column_names else None
        names = table["category"].to_pylist()
        self.of = {name: np.array([i for i, n in enumerate(names) if n == name]) for name in dict.fromkeys(names)}


def _by_category(column: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    names = column.to_pylist()
    for name in dict.fromkeys(names):
        yield name, np.array([i for i, n in enumerate(names) if n == name])


def _shared_groups(groups: DataFrame):
    ship_package()
    return groups.sparkSession.sparkContext.broadcast(_Groups(groups.orderBy("group").toArrow()))


def _grouped(rows: DataFrame, groups: DataFrame, metric: str) -> DataFrame:
    """``rows(id, v, c)`` with the nearest ``group`` of their category and the distance ``away`` from its centre."""
    shared = _shared_groups(groups)
    out = T.StructType([*rows.schema.fields, T.StructField("group", T.LongType()), T.StructField("away", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            v = in_space(matrix(batch.column("v")), metric)
            group, away = np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
            for name, i in _by_category(batch.column("c")):
                mine = g.of[name]
                step = max(1, (1 << 22) // len(mine))
                for at in range(0, len(i), step):
                    d = _apart(v[i[at : at + step]], g.centres[mine])
                    best = d.argmin(axis=1)
                    group[i[at : at + step]] = g.number[mine[best]]
                    away[i[at : at + step]] = d[np.arange(len(d)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(away)], schema=pa.schema([*batch.schema, ("group", pa.int64()), ("away", pa.float64())]))

    return rows.mapInArrow(nearest, out)


def _filed(rows: DataFrame, cells: DataFrame, sizes: DataFrame, metric: str) -> DataFrame:
    """``rows(id, v, c, group)`` with the nearest ``cell`` of their group; a large group is filed by several tasks.

    ``sizes(group, file_parts)`` has one row per group.
    """
    ship_package()
    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("away", T.DoubleType())])
    names = rows.columns
    spread = rows.join(F.broadcast(sizes), "group").withColumn("file_part", F.expr("cast(pmod(xxhash64(id), file_parts) as int)"))
    given = cells.join(F.broadcast(sizes), "group").select("group", "cell", "centre", F.explode(F.expr("sequence(0, file_parts - 1)")).alias("file_part"))

    def file(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names).combine_chunks()
        v = in_space(matrix(left["v"]), metric)
        right = right.sort_by("cell")
        centres, number = matrix(right["centre"]), right["cell"].to_numpy()
        cell, away = np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
        step = max(1, (1 << 22) // max(1, len(number)))
        for at in range(0, len(v), step):
            d = _apart(v[at : at + step], centres)
            best = d.argmin(axis=1)
            cell[at : at + step], away[at : at + step] = number[best], d[np.arange(len(d)), best]
        return left.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))

    return spread.groupBy("group", "file_part").cogroup(given.groupBy("group", "file_part")).applyInArrow(file, out)


def build_tree(
    corpus: DataFrame, n_cells: int | None = None, *, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding",
    category: str | None = None, refine: int = 1, seed: int = 7, block_rows: int = BLOCK_ROWS,
) -> CentroidTree:
    """File a corpus under about ``n_cells`` cells (from its size if not given), each of one category.

    Centres start as rows drawn at random and move to the mean of their rows ``refine``
    times.  Any centres give exact results; better ones leave out more.
    """
    metric = metric_name(metric)
    cat = F.col(category).cast("string") if category else F.lit(None).cast("string")
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), cat.alias("c"))
    counts = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(MOST_GROUPS + 1).collect()
    n = sum(r["n"] for r in counts)
    total = max(1, min(n_cells or tree_cells(n), max(n, 1)))
    n_groups = max(1, round(total**0.5))
    if len(counts) + n_groups > MOST_GROUPS:
        raise ValueError(f"{len(counts)} categories and {n_groups} groups; at most {MOST_GROUPS} can be held by every task")
    spark = corpus.sparkSession
    space = normalize(F.col("v")) if metric == "cosine" else F.col("v").cast("array<double>")
    wanted = F.broadcast(spark.createDataFrame([(r["c"], max(1, round(n_groups * r["n"] / n))) for r in counts], "of string, wanted int"))
    drawn = Window.partitionBy("c").orderBy("draw")
    first = rows.select("c", "v", F.rand(seed).alias("draw")).withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= n_groups)
    first = first.join(wanted, F.col("c").eqNullSafe(F.col("of")) & (F.col("rank") <= F.col("wanted")))
    groups = written(first.select(F.monotonically_increasing_id().alias("group"), F.col("c").alias("category"), space.alias("centre")))
    mean = vector_to_array(Summarizer.mean(array_to_vector(space))).alias("centre")
    for _ in range(refine):
        groups = written(_grouped(rows, groups, metric).groupBy("group", F.col("c").alias("category")).agg(mean))
    filed = written(_grouped(rows, groups, metric))
    reach = filed.groupBy("group").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(float(FILED_ROWS))).cast("int").alias("file_parts"))
    groups = written(groups.join(F.broadcast(reach), "group"))
    sizes = groups.select("group", "file_parts")
    filed = filed.drop("away")

    centre = space.alias("centre")
    some = filed.where(F.rand(seed + 1) < F.lit(total / max(n, 1))).select("group", centre)
    cells = groups.select("group", "centre").unionByName(some)  # a group's own centre is a cell, so that it has one
    cells = written(cells.select(F.monotonically_increasing_id().alias("cell"), "group", "centre"))
    for _ in range(refine):
        cells = written(_filed(filed, cells, sizes, metric).groupBy("cell", "group").agg(mean))
    placed = written(_filed(filed, cells, sizes, metric))
    stats = placed.groupBy("cell", F.col("c").alias("category")).agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n_rows"))
    parts = F.ceil(F.col("n_rows") / F.lit(float(block_rows))).cast("int").alias("parts")
    cells = written(cells.join(stats, "cell").select("cell", "group", "category", "centre", "radius", "n_rows", parts))
    return CentroidTree(groups.drop("file_parts"), cells, placed.drop("away"), metric)


def _states(tree: CentroidTree, asked: DataFrame) -> DataFrame:
    """One row per query and category of the corpus: the k-th distance so far, and the last cell visited (none yet).

    ``asked(qrow, qid, qv, kths)`` has the k-th distances known by category, so a vector is kept once for all categories.
    """
    names = [r["category"] for r in tree.groups.select("category").distinct().collect()]  # at most MOST_GROUPS
    each = F.explode(F.array(*[F.lit(x).cast("string") for x in names])) if names else F.explode(F.array().cast("array<string>"))
    states = asked.withColumn("category", each)
    known = F.get(F.filter("kths", lambda x: x["category"].eqNullSafe(F.col("category"))), F.lit(0))["distance"]
    # distances that round to the same nine decimals are ties
    theta = F.least(F.lit(float("inf")), known + F.lit(2e-9)).alias("theta")  # of null and a number, the number
    return states.select("qrow", "qid", "qv", "category", theta, F.lit(float("-inf")).alias("mark"), F.lit(-1).cast("long").alias("mark_cell"))


def _to_groups(states: DataFrame, shared, metric: str, own: bool, count: bool = False) -> DataFrame:
    """States copied to the nearest group of their category (``own``), or to all that can hold something nearer.

    ``count``: only how many go to each group.
    """
    group = T.StructField("group", T.LongType())
    out = T.StructType([group, T.StructField("n", T.LongType())] if count else [*states.schema.fields, group])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                q, theta = in_space(matrix(batch.column("qv")), metric), batch.column("theta").to_numpy()
                who, where = [], []
                for name, i in _by_category(batch.column("category")):
                    mine = g.of[name]
                    near, least = bounds(q[i], g.centres[mine], g.radius[mine], metric)
                    if own:
                        r, c = np.arange(len(i)), near.argmin(axis=1)
                    else:
                        r, c = np.nonzero(least <= theta[i][:, None])
                    who.append(i[r])
                    where.append(g.number[mine[c]])
                if who and count:
                    group, n = np.unique(np.concatenate(where), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(n)], names=["group", "n"])
                elif who:
                    taken = batch.take(pa.array(np.concatenate(who)))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(where))], schema=pa.schema([*taken.schema, ("group", pa.int64())]))

    routed = states.mapInArrow(route, out)
    return routed.groupBy("group").agg(F.sum("n").alias("n")) if count else routed


def _open_cells(states: pa.Table, cells: pa.Table, metric: str, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of states and the cells of their group: how near a cell is, and whether the state has to visit it.

    ``own``: it visits the nearest cells that together hold k rows.  Else those after the last
    cell visited, in order of nearness, whose bound does not exceed the k-th distance.
    """
    q = in_space(matrix(states["qv"]), metric)
    near, least = bounds(q, matrix(cells["centre"]), cells["radius"].to_numpy(), metric)
    if not own:
        mark, at = states["mark"].to_numpy()[:, None], states["mark_cell"].to_numpy()[:, None]
        behind = (near > mark) | (near == mark) & (cells["cell"].to_numpy() > at)
        return near, behind & (least <= states["theta"].to_numpy()[:, None])
    order = np.argsort(near, axis=1, kind="stable")
    n_rows = cells["n_rows"].to_numpy()[order]
    keep = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(keep, order, np.cumsum(n_rows, axis=1) - n_rows < k, axis=1)
    return near, keep


def _to_cells(routed: DataFrame, tree: CentroidTree, n_states: int, k: int, most: int | None) -> DataFrame:
    """Routed states with the cells they visit next: ``cell, near, n_rows, parts``.

    In order of nearness and after the last cell visited, every cell whose bound does not
    exceed the k-th distance, or the first ``most`` of them.
    """
    metric = tree.metric
    pieces = max(1, -(-n_states // ROUTED_ROWS))
    fields = ["qrow", "qid", "qv", "category"]
    schema = T.StructType(
        [*[routed.schema[f] for f in fields], T.StructField("cell", T.LongType()), T.StructField("near", T.DoubleType()),
         T.StructField("n_rows", T.LongType()), T.StructField("parts", T.IntegerType())]
    )
    asking = routed.withColumn("piece", F.expr(f"cast(pmod(xxhash64(qrow), {pieces}) as int)"))
    given = tree.cells.select("group", "cell", "centre", "radius", "n_rows", "parts", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("cell").combine_chunks()
        kept = left.select(fields)
        r = c = np.zeros(0, dtype=np.int64)
        near = np.zeros((len(left), len(right)))
        if len(left) and len(right):
            near, keep = _open_cells(left, right, metric, k, own=False)
            order = np.argsort(near, axis=1, kind="stable")
            keep = np.take_along_axis(keep, order, axis=1)
            if most is not None:
                keep &= np.cumsum(keep, axis=1) <= most
            r, place = np.nonzero(keep)
            c = order[r, place]
        taken, cells = kept.take(pa.array(r)), right.take(pa.array(c))
        return pa.Table.from_arrays(
            [*taken.columns, cells["cell"], pa.array(near[r, c]), cells["n_rows"], cells["parts"]],
            names=[*fields, "cell", "near", "n_rows", "parts"],
        )

    chosen = asking.groupBy("group", "piece").cogroup(given.groupBy("group", "piece")).applyInArrow(choose, schema)
    if most is None:
        return chosen
    nearest = Window.partitionBy("qrow", "category").orderBy("near", "cell")
    return chosen.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= most).drop("place")


def _search(pairs: DataFrame, tree: CentroidTree, k: int, block_rows: int) -> DataFrame:
    """k nearest of every state among the rows of its cells; blocks of a cell and of its visitors meet."""
    visited = written(pairs.groupBy("cell", "parts").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("q_parts")))
    if visited.count() <= BROADCAST_CELLS:
        visited = F.broadcast(visited)
    part = lambda col, n: F.expr(f"cast(pmod(xxhash64({col}), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    q = pairs.join(visited.select("cell", "q_parts"), "cell")
    q = q.select("qrow", "qid", "qv", "cell", part("qrow", "q_parts").alias("qb"), every("parts").alias("cb"))
    c = tree.rows.join(visited, "cell").select("id", "v", "c", "cell", part("id", "parts").alias("cb"), every("q_parts").alias("qb"))
    keys = ["cell", "qb", "cb"]
    out = _candidate_schema(q.schema["qid"].dataType, c.schema["id"].dataType)
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet_blocks(k, tree.metric), out)
    w = Window.partitionBy("qrow", "category").orderBy("dkey", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_groups(states: DataFrame, shared, tree: CentroidTree, k: int, own: bool, block_rows: int) -> DataFrame:
    """k nearest of every state among the rows of its own cells, or of all cells that its k-th distance leaves open.

    A task has the cells of a group, a part of its rows and a part of its visitors, and chooses
    the cells itself: a vector is sent once for each group it visits, not for each cell.
    """
    metric = tree.metric
    parts = lambda n, size: F.ceil(F.col(n) / F.lit(float(size))).cast("int")
    visitors = _to_groups(states, shared, metric, own, count=True).select("group", parts("n", VISITORS).alias("q_parts"))
    held = tree.cells.groupBy("group").agg(F.sum("n_rows").alias("n")).select("group", parts("n", block_rows).alias("parts"))
    sizes = F.broadcast(written(visitors.join(held, "group")))  # at most MOST_GROUPS
    part = lambda col, n: F.expr(f"cast(pmod(xxhash64({col}), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    routed = _to_groups(states, shared, metric, own)
    asking = ["qrow", "qid", "qv", "category", "theta", "mark", "mark_cell"]
    q = routed.join(sizes, "group").select(*asking, "group", part("qrow", "q_parts").alias("qb"), every("parts").alias("cb"))
    empty = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    rows = tree.rows.join(sizes, "group").select(
        "group", "cell", "id", "v", *[empty(x, tree.cells) for x in ("centre", "radius", "n_rows")],
        part("id", "parts").alias("cb"), every("q_parts").alias("qb"),
    )
    cells = tree.cells.drop("parts").join(sizes, "group").select(
        "group", "cell", *[empty(x, tree.rows) for x in ("id", "v")], "centre", "radius", "n_rows", every("parts").alias("cb"), "q_parts"
    ).withColumn("qb", every("q_parts")).drop("q_parts")
    out = _candidate_schema(q.schema["qid"].dataType, tree.rows.schema["id"].dataType)
    schema = to_arrow_schema(out)

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        is_cell = pc.is_valid(right["n_rows"])
        cells, rows = right.filter(is_cell).sort_by("cell").combine_chunks(), right.filter(pc.invert(is_cell)).sort_by("cell")
        if not len(left) or not len(rows):
            return schema.empty_table()
        left, rows = left.combine_chunks(), rows.combine_chunks()
        step = max(1, (1 << 21) // len(cells))
        keep = np.concatenate([_open_cells(left.slice(at, step), cells, metric, k, own)[1] for at in range(0, len(left), step)])
        q, theta = matrix(left["qv"]), left["theta"].to_numpy()[:, None]
        ids, v, of = rows["id"].combine_chunks(), matrix(rows["v"]), rows["cell"].to_numpy()
        number = cells["cell"].to_numpy()
        found = []
        for n, lo, hi in zip(range(len(number)), np.searchsorted(of, number), np.searchsorted(of, number, side="right")):
            who = np.flatnonzero(keep[:, n])
            if len(who) and hi > lo:
                block = Block(ids[int(lo) : int(hi)], v[lo:hi], None, metric, k)
                r, c, d, _ = block.search(q[who], None if own else theta[who])
                found.append(pa.table({"r": who[r], "id": block.ids.take(pa.array(c)), "d": d}))
        if not found:
            return schema.empty_table()
        found = pa.concat_tables(found).combine_chunks()
        by_id = np.asarray(pc.sort_indices(found["id"]))
        place = np.empty(len(found), dtype=np.int64)
        place[by_id] = np.arange(len(found))
        d, r = found["d"].to_numpy(), found["r"].to_numpy()
        r, at, d, _ = top_k(r, np.zeros(len(r), dtype=np.int64), sort_key(d), place, d, k)
        kept = left.select(["qrow", "qid", "category"]).take(pa.array(r))
        columns = [*kept.columns, found["id"].take(pa.array(by_id[at])), pa.array(d), pa.array(sort_key(d))]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    keys = ["group", "qb", "cb"]
    found = q.groupBy(*keys).cogroup(rows.unionByName(cells).groupBy(*keys)).applyInArrow(visit, out)
    w = Window.partitionBy("qrow", "category").orderBy("dkey", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tree_search(
    tree: CentroidTree, queries: DataFrame, k: int = 0, *, schedule: tuple[int | None, ...] = (None,), query_id: str = "qid",
    query_vector: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """k nearest rows of every query (per category of the tree), and what each query visited.

    Results are as those of ``knn_join``.  ``schedule`` has the most cells that a query visits
    in each round, None for all that its bound leaves open; a query takes part in a round
    only while some cell can still hold something as near as its k-th row.  With None at the end
    the result is exact.  Visits are ``(qid, category, cells_visited, rows_compared, closed)``;
    ``closed`` says that no cell left out can change the result.
    """
    k = effective_k(k)
    asked = written(numbered(queries).select("qrow", F.col(query_id).alias("qid"), F.col(query_vector).alias("qv")))
    shared = _shared_groups(tree.groups)
    route = lambda open_, n, most: _to_cells(_to_groups(open_, shared, tree.metric, own=False), tree, n, k, most)
    same = (F.col("qrow") == F.col("at")) & F.col("category").eqNullSafe(F.col("of"))
    by_state = [F.col("qrow").alias("at"), F.col("category").alias("of")]
    ranks = Window.partitionBy("qrow", "category").orderBy("dkey", "vec_id")

    def narrowed(open_: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
        """States that visited any of ``pairs``, with the k-th distance found, and behind the last of them."""
        kth = found.where(F.col("rank") == k).select(*by_state, F.col("distance").alias("now"))
        # distances that round to the same nine decimals are ties
        theta = F.least("theta", F.coalesce(F.col("now") + F.lit(2e-9), F.col("theta"))).alias("theta")
        states = open_.join(kth, same, "left").select("qrow", "qid", "qv", "category", theta)
        last = pairs.groupBy(*by_state).agg(F.max(F.struct("near", "cell")).alias("last"))
        return written(
            states.join(last, same).select(
                "qrow", "qid", "qv", "category", "theta", F.col("last.near").alias("mark"), F.col("last.cell").alias("mark_cell")
            )
        )

    kths = F.lit(None).cast(T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("distance", T.DoubleType())])))
    own = _search_groups(_states(tree, asked.withColumn("kths", kths)), shared, tree, k, True, block_rows)
    # one per category
    kths = own.where(F.col("rank") == k).groupBy(F.col("qrow").alias("at")).agg(F.collect_list(F.struct("category", "distance")).alias("kths"))
    open_ = _states(tree, written(asked.join(kths, F.col("qrow") == F.col("at"), "left").drop("at")))
    best, seen = None, []
    for most in schedule:
        n = open_.count()
        if best is not None and not n:
            break
        pairs = route(open_, n, most)
        if most is None:
            fresh = _search_groups(open_, shared, tree, k, False, block_rows)
        else:
            pairs = written(pairs)
            fresh = _search(pairs, tree, k, block_rows)
        if best is not None:
            fresh = best.unionByName(fresh).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        best = written(fresh)
        seen.append(pairs.select("qrow", "qid", "category", "n_rows"))
        if most is None:
            open_ = None
            break
        open_ = narrowed(open_, best, pairs)
    visits = seen[0]
    for more in seen[1:]:
        visits = visits.unionByName(more)
    visits = visits.groupBy("qrow", "qid", "category").agg(F.count(F.lit(1)).alias("cells_visited"), F.sum("n_rows").alias("rows_compared"))
    if open_ is None:
        visits = visits.withColumn("closed", F.lit(True))
    else:
        left = written(route(open_, open_.count(), 1)).select(*by_state, F.lit(False).alias("more"))
        visits = visits.join(left, same, "left").withColumn("closed", F.coalesce("more", F.lit(True))).drop("at", "of", "more")
    return best.select("qid", "category", "vec_id", "distance", "rank"), visits.drop("qrow")


def knn_join_pruned(
    queries: DataFrame, corpus: DataFrame, k: int = 0, *, metric: str = "cosine", query_id: str = "qid", query_vector: str = "embedding",
    id_col: str = "vec_id", vector: str = "embedding", category: str | None = None, n_cells: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Exact join of two large sides: a tree over the corpus, searched until every bound has closed."""
    tree = build_tree(corpus, n_cells, metric=metric, id_col=id_col, vector=vector, category=category)
    return tree_search(tree, queries, k, query_id=query_id, query_vector=query_vector)
