"""What several operators of this subpackage need: tables, shared folders, ranks, graph components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailvane.session import ensure_checkpoint_dir

#: A word, as every operator here takes it: white space is these six ASCII characters only.
SPACE_CLASS = r"\x20\x09-\x0D"
#: A side up to this size may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.  The folder
    goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def named(columns: list[str]) -> list[Column]:
    """The columns, whatever their names hold (dots as well)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when its counted size is within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    """Words of a text, null or empty: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def hash_key(seed: str, *cols: Column) -> Column:
    """32 hexadecimal digits that depend on the seed and the columns; null has a form of its own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def ranked(df: DataFrame, groups: list[str], key: str, ties: list[str], out: str, digits: int = 3) -> DataFrame:
    """Adds ``out``, the rank from 0 of each row by ``key`` within ``groups``, however large a group is.

    ``key`` is a hash in hexadecimal, so its first digits cut a group into parts of even
    size.  Rows are ranked within a part, and the counts of the parts before it (at most
    16**digits for a group, summed before any shuffle) are added.
    """
    part, before = f"_{out}_part", f"_{out}_before"
    cut = df.withColumn(part, F.substring(key, 1, digits))
    counts = cut.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*groups).orderBy(part) if groups else Window.orderBy(part)
    offsets = counts.withColumn(before, F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    renamed = offsets.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col(part).alias("_of_part"), before)
    same = F.col(part) == F.col("_of_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    within = F.row_number().over(Window.partitionBy(*groups, part).orderBy(key, *ties))
    placed = cut.withColumn("_within", within).join(renamed, same, "left")
    return placed.withColumn(out, F.col(before) + F.col("_within") - 1).drop(part, before, "_within", "_of_part", *[f"_of_{g}" for g in groups])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(u, v)``: ``(node, component)``, the smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours
    to its smallest one, then its smaller neighbours likewise.  Minima are partial
    aggregates and the joins may be split where a node has very many neighbours.
    """
    e = durable(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = durable(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
