"""Vector tables: validation, ids, upsert, lookup, delete, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailvane.functions.vectors import check_dim
from mailvane.sources.tables import written


def validate_dim(table: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows of the right dimension, and the others."""
    check_dim(dim)
    ok = F.coalesce(F.size(vector) == dim, F.lit(False))
    return table.where(ok), table.where(~ok)


def dense_rank_ids(rows: DataFrame, order: str, start: Column, out: str) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the order of a column; ties by the other columns.

    Rows are sorted over all tasks and written once; the counts of the tasks' parts (one row
    each) give each part its first number.  Rows equal in all columns may get each other's
    number and are dealt to several tasks, so a value that very many rows share is no hot spot.
    """
    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns)).withColumn("_row", F.monotonically_increasing_id())
    keys = [order, "_tie", "_row"]
    placed = written(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_row").withColumn("_place", F.monotonically_increasing_id())
    )
    # the task's number is in the upper bits
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = start + F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), "_part").withColumn(out, number.cast("long")).drop("_place", "_part", "_first")


def append_ids(table: DataFrame, incoming: DataFrame, order: str, id_col: str = "vec_id") -> DataFrame:
    """``table`` plus ``incoming`` with the ids that follow the table's highest one."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    numbered = dense_rank_ids(incoming, order, F.lit(top + 1), id_col)
    return table.unionByName(numbered.select(*table.columns))


def upsert_latest(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write per key.  ``changes`` carries ``seq``; rows of ``table`` are older than any change.

    ``max_by`` aggregates before the shuffle, so a key written very often is no hot spot.
    """
    values = [c for c in table.columns if c != key]
    old = table.withColumn("_seq", F.lit(None).cast("long"))
    new = changes.select(*table.columns, F.col(seq).cast("long").alias("_seq"))
    packed = F.struct(*values)
    latest = F.max_by(packed, F.coalesce("_seq", F.lit(-(1 << 63) + 1))).alias("_v")
    return old.unionByName(new).groupBy(key).agg(latest).select(key, "_v.*")


def get_by_id(table: DataFrame, vec_id, id_col: str = "vec_id") -> DataFrame:
    return table.where(F.col(id_col) == F.lit(vec_id))


def delete_by_id(table: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """``(remaining rows, ids that were not there)``."""
    gone = ids.select(id_col).distinct()
    return table.join(gone, id_col, "left_anti"), gone.join(table.select(id_col), id_col, "left_anti")


def active_rows(table: DataFrame) -> DataFrame:
    return table.where("active")


def list_ids(table: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return table.select(id_col)


def category_stats(table: DataFrame, category: str = "category", vector: str = "embedding", active: Column | None = None):
    """Rows in all, live rows and dimension range of every category."""
    live = F.lit(True) if active is None else active
    return table.groupBy(category).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(live).alias("active_rows"),
        F.min(F.size(vector)).alias("min_dim"),
        F.max(F.size(vector)).alias("max_dim"),
    )


def table_info(table: DataFrame, metric: str, vector: str = "embedding", active: Column | None = None) -> DataFrame:
    live = F.lit(True) if active is None else active
    return table.agg(
        F.max(F.size(vector)).alias("dimensions"),
        F.lit(metric).alias("metric"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(live).alias("active_rows"),
    )
