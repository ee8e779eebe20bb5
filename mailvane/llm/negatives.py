"""Hard negatives by Fagin's threshold algorithm.

A block of rows has one list per dimension, sorted by component.  An anchor reads each
list from the end that its own component's sign makes largest; every row met is scored
whole by random access.  What the lists would yield next bounds all rows not met, so an anchor
stops once that threshold is strictly below the k-th score of each of its windows (or,
while a window is not full, below the least score it admits).  The first search finds the
positives of an anchor, its windows follow from their scores, and the second search
fills them from rows of other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailvane.llm.intvectors import HIGHEST, LOWEST, by_id, first_best, is_exact, products, whole_matrix, whole_rows
from mailvane.llm.shared import durable
from mailvane.shipping import ship_package

#: Rows and anchors that meet in one task.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 2048
#: Cells that labels are hashed into, so that their sizes are a bounded table.
LABEL_CELLS = 4096
#: First depth of sorted access; it doubles.
FIRST_DEPTH = 4
#: Scores held at once.
_CELLS = 1 << 22


class SortedLists:
    """Rows in order of id, and for every dimension their positions sorted by component."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.order = np.argsort(matrix, axis=0, kind="stable")
        self.values = np.take_along_axis(matrix, self.order, axis=0)
        self.longest = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)).max() if len(matrix) else 0.0
        #: rows scored by random access, and anchors that read all rows
        self.accessed = self.read_whole = 0

    def thresholds(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """The highest score of a row that none of the first ``depth`` entries of any list names."""
        return np.maximum(anchors, 0) @ self.values[len(self.values) - depth] + np.minimum(anchors, 0) @ self.values[depth - 1]

    def _met(self, anchor: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows that the entries ``low`` to ``high`` of the anchor's lists name."""
        n = len(self.order)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        return np.unique(np.concatenate([self.order[n - high : n - low, up].ravel(), self.order[low:high, down].ravel()]))

    def search(self, anchors: np.ndarray, allowed, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """Best k rows of each window: window, position, score.

        Window w asks for rows with ``low[w] <= score <= high[w]`` on behalf of anchor
        ``owner[w]`` (ascending); ``allowed(anchors)`` is the mask of rows each may take.
        """
        n, rows = len(anchors), len(self.matrix)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.searchsorted(owner, np.arange(n + 1))
        lists = np.count_nonzero(anchors, axis=1)
        # beyond this depth the lists name as many entries as there are rows
        deepest = np.minimum(rows // np.maximum(lists, 1), rows)
        stepwise = np.zeros(n, dtype=bool)
        if is_exact(anchors, self.matrix):
            size = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
            for d in np.unique(deepest[deepest >= FIRST_DEPTH]):
                i = np.flatnonzero(deepest == d)
                # no score is above the product of lengths: with a threshold above it nothing can stop
                stepwise[i] = self.thresholds(anchors[i], int(d)) <= size[i] * self.longest
        for i in np.flatnonzero(stepwise):
            windows = np.arange(at[i], at[i + 1])
            done = self._stepwise(anchors[i], allowed(np.array([i]))[0], windows, low, high, k, int(deepest[i]))
            if done is None:
                stepwise[i] = False
            else:
                found += done
        rest = np.flatnonzero(~stepwise)
        self.read_whole += len(rest)
        most = max(1, int(np.max(at[1:] - at[:-1], initial=1)))
        step = max(1, _CELLS // max(1, rows * most))
        for lo in range(0, len(rest), step):
            i = rest[lo : lo + step]
            score, mask = products(anchors[i], self.matrix), allowed(i)
            held = at[i + 1] - at[i]
            windows = np.arange(held.sum()) + np.repeat(at[i] - (np.cumsum(held) - held), held)
            mine = np.repeat(np.arange(len(i)), held)
            found.append(self._fill(windows, score[mine], mask[mine], np.arange(rows), low, high, k))
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _fill(windows: np.ndarray, score: np.ndarray, mask: np.ndarray, position: np.ndarray, low, high, k: int):
        """The k best of the scores, one line of them for each window, that lie in it."""
        inside = mask & (score >= low[windows][:, None]) & (score <= high[windows][:, None])
        if score.shape[1] > k:
            kept = np.where(inside, score, LOWEST)
            bar = np.partition(kept, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            inside &= score >= bar[:, None]
        w, p = np.nonzero(inside)
        best = first_best(w, score[w, p], position[p], k)
        return windows[w[best]], position[p[best]], score[w[best], p[best]]

    def _stepwise(self, anchor, mask, windows, low, high, k, deepest: int):
        """Sorted access at doubling depths; None when no threshold stops it by ``deepest``."""
        seen = np.zeros(len(self.matrix), dtype=bool)
        position, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        before, depth = 0, FIRST_DEPTH
        while depth <= deepest:
            fresh = self._met(anchor, before, depth)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            self.accessed += len(fresh)
            take = fresh[mask[fresh]]
            position, score = np.concatenate([position, take]), np.concatenate([score, products(anchor[None, :], self.matrix[take])[0]])
            threshold = self.thresholds(anchor[None, :], depth)[0]
            lines = np.broadcast_to(score, (len(windows), len(score)))
            w, p, s = self._fill(windows, lines, np.ones_like(lines, dtype=bool), position, low, high, k)
            full = np.bincount(w - windows[0], minlength=len(windows)) >= k
            last = low[windows].copy()
            last[w - windows[0]] = np.where(full[w - windows[0]], s, last[w - windows[0]])  # best first: the k-th stays
            # a window that admits nothing is closed from the start
            closed = (threshold < last) | (high[windows] < low[windows])
            if closed.all():
                return [(w, p, s)]
            before, depth = depth, 2 * depth
        return None


def _lists_of(given: pa.Table, scale: float, dim: int) -> tuple[pa.Table, SortedLists]:
    given = given.combine_chunks()
    given = given.take(pa.array(by_id(given["id"].combine_chunks())))
    return given, SortedLists(whole_matrix(given["v"], scale, dim))


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both sides as comparable numbers; there are no nulls."""
    both = pa.chunked_array([*a.chunks, *b.chunks], type=a.type).combine_chunks().dictionary_encode()
    both = both.indices.to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def _positives_of(scale: float, dim: int, k: int):
    def meet(asking: pa.Table, given: pa.Table) -> pa.Table:
        schema = pa.schema([("arow", pa.int64()), ("prow", pa.int64()), ("pid", given.schema.field("id").type), ("pscore", pa.int64())])
        if not len(asking) or not len(given):
            return schema.empty_table()
        given, lists = _lists_of(given, scale, dim)
        own, rows = asking["row"].to_numpy(), given["row"].to_numpy()
        mine, theirs = _codes(asking["label"], given["label"])
        n = len(own)
        w, p, s = lists.search(
            whole_matrix(asking["v"], scale, dim), lambda i: (mine[i][:, None] == theirs) & (own[i][:, None] != rows),
            np.arange(n), np.full(n, LOWEST), np.full(n, HIGHEST), k,
        )
        return pa.Table.from_arrays([pa.array(own[w]), pa.array(rows[p]), given["id"].combine_chunks().take(pa.array(p)), pa.array(s)], schema=schema)

    return meet


def window_of(score: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """Whole scores s with low_percent * score <= 100 * s <= high_percent * score; may be empty."""
    return -((-low_percent * score) // 100), (high_percent * score) // 100


def _negatives_of(scale: float, dim: int, k: int, low_percent: int, high_percent: int):
    def meet(asking: pa.Table, given: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("arow", pa.int64()), ("aid", asking.schema.field("id").type), ("prow", pa.int64()), ("pid", asking.schema.field("id").type),
             ("pscore", pa.int64()), ("nid", given.schema.field("id").type), ("nscore", pa.int64())]
        )
        if not len(asking) or not len(given):
            return schema.empty_table()
        given, lists = _lists_of(given, scale, dim)
        mine, theirs = _codes(asking["label"], given["label"])
        wanted = asking["positives"].combine_chunks()
        owner = np.repeat(np.arange(len(asking)), np.asarray(wanted.value_lengths()))
        wanted = wanted.flatten()
        scores = wanted.field("pscore")
        bounds = np.array([window_of(s, low_percent, high_percent) for s in scores.to_pylist()], dtype=np.int64)
        w, p, s = lists.search(
            whole_matrix(asking["v"], scale, dim), lambda i: mine[i][:, None] != theirs, owner, bounds[:, 0], bounds[:, 1], k
        )
        anchor, at = asking.take(pa.array(owner[w])), pa.array(w)
        return pa.Table.from_arrays(
            [anchor["row"].combine_chunks(), anchor["id"].combine_chunks(), wanted.field("prow").take(at), wanted.field("pid").take(at),
             scores.take(at), given["id"].combine_chunks().take(pa.array(p)), pa.array(s)], schema=schema
        )

    return meet


def _best(found: DataFrame, groups: list[str], score: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc(score), F.asc_nulls_last(ident))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, *, n_positives: int = 5, n_negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Positives of an anchor row are the other rows of its label with the highest inner
    products, negatives of a positive the best rows of other labels whose score is
    between ``low_percent`` and ``high_percent`` of the positive's; for a negative
    positive score that range is empty.  Components are floored after scaling; scores are
    exact, and held at the ends of the long range.  Ties go to the smaller id, null ids
    last.  Rows whose label or vector is null, or whose vector holds a null or
    non-finite component, take no part; a shorter vector counts as ended by zeros.  Every row
    is one of its own, also where ids or vectors repeat.  ``is_anchor`` being null is no
    anchor.  Other columns are left alone.  Empty tables, and anchors that are alone in
    their label, give no rows.
    """
    ship_package()
    usable = vectors.where(label.isNotNull())
    rows = durable(whole_rows(usable, id_col, vector_col, scale, label=label, anchor=F.coalesce(is_anchor, F.lit(False))).drop("length"))
    id_type = rows.schema["id"].dataType
    cell = F.pmod(F.xxhash64("label"), F.lit(LABEL_CELLS)).cast("int")
    sizes = rows.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("an"), F.max(F.size("v")).alias("dim")
    ).collect()  # at most LABEL_CELLS
    n, anchors_n, dim = sum(r["n"] for r in sizes), sum(r["an"] for r in sizes), max([1, *[r["dim"] for r in sizes]])
    blocks = lambda count, most: max(1, -(-count // most))
    cells = F.broadcast(
        rows.sparkSession.createDataFrame(
            [(r["cell"], blocks(r["n"], block_rows), blocks(r["an"], block_anchors)) for r in sizes if r["an"]], "cell int, parts int, a_parts int"
        )
    )
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count) - 1 if isinstance(count, int) else F.col(count) - 1))
    part = lambda count: F.pmod(F.xxhash64("row"), F.lit(count) if isinstance(count, int) else F.col(count)).cast("int")

    in_cells = rows.withColumn("cell", cell).join(cells, "cell")
    # columns of its own: the two sides of a cogroup must not share any
    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    asking = again.where("anchor").withColumn("cell", cell).join(cells, "cell").select("row", "id", "v", "label", "cell", part("a_parts").alias("a_part"), every("parts").alias("part"))
    given = in_cells.select("row", "id", "v", "label", "cell", part("parts").alias("part"), every("a_parts").alias("a_part"))
    keys = ["cell", "part", "a_part"]
    out = T.StructType([T.StructField("arow", T.LongType()), T.StructField("prow", T.LongType()), T.StructField("pid", id_type), T.StructField("pscore", T.LongType())])
    found = asking.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_positives_of(scale, dim, n_positives), out)
    best = _best(found, ["arow"], "pscore", "pid", n_positives)
    positives = best.groupBy("arow").agg(F.collect_list(F.struct("prow", "pid", "pscore")).alias("positives"))  # n_positives at most

    a_parts, parts = blocks(anchors_n, block_anchors), blocks(n, block_rows)
    anchors = again.where("anchor").join(positives, F.col("row") == F.col("arow")).select("row", "id", "v", "label", "positives")
    asking = anchors.select("*", part(a_parts).alias("a_part"), every(parts).alias("part"))
    given = rows.select("row", "id", "v", "label", part(parts).alias("part"), every(a_parts).alias("a_part"))
    out = T.StructType(
        [T.StructField("arow", T.LongType()), T.StructField("aid", id_type), T.StructField("prow", T.LongType()), T.StructField("pid", id_type),
         T.StructField("pscore", T.LongType()), T.StructField("nid", id_type), T.StructField("nscore", T.LongType())]
    )
    keys = ["part", "a_part"]
    found = asking.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_negatives_of(scale, dim, n_negatives, low_percent, high_percent), out)
    return _best(found, ["arow", "prow"], "nscore", "nid", n_negatives).select(
        F.col("aid").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank", F.col("nid").alias("negative_id"),
        F.col("pscore").alias("positive_score"), F.col("nscore").alias("negative_score"),
    )


def hard_negative_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of all vectors whose id is divisible by 50; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, moved)


#: The same rows as a join of all pairs.
HARD_NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pairs AS MATERIALIZED (SELECT a.n AS an, a.vec_id AS anchor_id, c.n AS cn, c.vec_id, a.label = c.label AS same,
    list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.n <> c.n),
positives AS (SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.an, p.cn ORDER BY g.score DESC, g.vec_id)::INTEGER AS rank,
  g.vec_id AS negative_id, p.score AS positive_score, g.score AS negative_score
FROM positives p JOIN pairs g ON g.an = p.an AND NOT g.same AND 50 * p.score <= 100 * g.score AND 100 * g.score <= 95 * p.score
QUALIFY rank <= 3"""
