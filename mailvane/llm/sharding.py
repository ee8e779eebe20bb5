"""Sharding: proportional stratified interleaving.

Rows are put in a seeded random order within their source.  The rank r of n rows becomes
the fraction (r + 1/2) / n, all rows are sorted by it, and the sorted list is cut into
equal runs, so every shard holds each source in the proportion of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.llm.shared import durable, hash_key, named, ranked

_TWO_52 = 4503599627370496.0


def interleaved(rows: DataFrame, n_shards: int, stratum: str = "source", id_col: str = "doc_id", seed: str = "shard") -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most, and each source's share of a shard by one row
    at most for each cut.  A null source is a source of its own.  Null and repeated ids
    are allowed: such rows are spread by a number of their own, however many they are.  An
    empty table gives an empty result.  Columns of ``rows`` named ``shard`` or ``slot`` are
    replaced, all others come back whatever their names.

    ``rows`` should be narrow: it is shuffled twice.  No source is ranked in one task.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows.drop("shard", "slot")
    ties = [c for c, kind in rows.dtypes if kind.split("<")[0] not in ("map", "variant")]
    # the given columns go into one struct, so that none of them meets a name used here
    own_id, own_stratum = named([id_col, stratum])
    # rows without an id, or of one id, are told apart by their other columns and a number
    number = F.monotonically_increasing_id()
    kept = durable(rows.select(F.struct(*named(rows.columns)).alias("given"), F.struct(*named(ties)).alias("tie"), own_stratum.alias("stratum"), own_id.alias("id"), number.alias("n")))
    again = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1 or id is null").select(F.col("id").alias("again"))
    if again.isEmpty():
        keyed = kept.withColumn("key", hash_key(seed, F.col("id")))
    else:
        told = F.when(F.col("id").isNull() | F.col("again").isNotNull(), F.col("n"))
        keyed = kept.join(again, F.col("id").eqNullSafe(F.col("again")), "left").withColumn("key", hash_key(seed, F.col("id"), told)).drop("again")
    keyed = keyed.drop("n", "id")
    sizes = kept.groupBy(F.col("stratum").alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    placed = ranked(keyed, ["stratum"], "key", ["tie"], "rank").join(sizes, F.col("stratum").eqNullSafe(F.col("of")))
    fraction = (2 * F.col("rank") + 1).cast("double") / (2 * F.col("rows")).cast("double")
    # 13 hexadecimal digits of the fraction, then the key against ties
    place = F.concat(F.lpad(F.hex((fraction * _TWO_52).cast("long")), 13, "0"), F.col("key"))
    placed = durable(placed.select("given", "tie", place.alias("place")))
    total = placed.count()
    listed = ranked(placed, [], "place", ["tie"], "position")
    shard = F.expr(f"(position * {n_shards}) div {max(total, 1)}").cast("int")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return listed.withColumn("shard", shard).select("given.*", "shard", (F.col("position") - first).cast("long").alias("slot"))


def shard_report(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The query's columns for ``docs(doc_id, text, source)``.

    A null or empty text has size 1, a long one its whole size.  Null and repeated ids and
    repeated rows are rows of their own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleaved(narrow, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
