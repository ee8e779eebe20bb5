"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's documents are put in a seeded random order and repeated; the mix takes the
first ``target`` words of that stream, cut into blocks.  A binary tree over the output
shards splits the exact block quotas of all sources: at each node the left half draws
its blocks without replacement, which is a multivariate-hypergeometric draw of counts
for each source.  The quotas at the leaves then draw disjoint runs of each source's
permuted blocks, and every shard is shuffled by itself.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailvane.llm.shared import durable, hash_key, named, ranked, word_count

#: No source, and so no document, is taken more often than this.
MOST_EPOCHS = 3


def water_filled(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to ``sizes(source, source_size)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes.  A target above ``MOST_EPOCHS`` times its source's size stops there and the
    excess goes to the others by weight: with the sources sorted by limit / weight, the
    first level (words left / weights left) that is within its own limit holds for all
    sources from there on.
    """
    limit = F.lit(MOST_EPOCHS) * F.col("source_size")
    weighed = sizes.withColumn("_weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    weighed = weighed.withColumn("_ratio", limit.cast("double") / F.col("_weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    levels = weighed.withColumn("_place", F.row_number().over(order)).withColumn("_level", left.cast("double") / F.sum("_weight").over(onward))
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_place"))).over(everything)
    target = F.least(limit.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _running(df: DataFrame, group: str, key: str, ties: list[str], size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows before this one by ``key`` in its group.

    As in :func:`ranked`, the first digits of the hash cut a group into even parts.
    """
    cut = df.withColumn("_part", F.substring(key, 1, 3))
    sums = cut.groupBy(group, "_part").agg(F.sum(size).alias("_sum"))
    over = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    here = Window.partitionBy(group, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.coalesce(F.sum(size).over(here), F.lit(0)))
    joined = inside.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_of", "_group", "_before", "_inside")


def split_quotas(quotas: DataFrame, n_shards: int, seed: str) -> DataFrame:
    """``quotas(source, blocks)`` divided among shards: ``(shard, source, quota)``, sums exact.

    Every node of the tree covers a run of shards.  Its blocks are ranked by a hash of
    their own, and the first of them, as many as are due to the left half, go left.
    """
    tokens = quotas.filter("blocks > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("token"))
    tokens = tokens.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(n_shards))
    depth, level = 1, 0
    while depth < n_shards:
        tokens = tokens.withColumn("_key", hash_key(f"{seed}:{level}", F.col("source"), F.col("token")))
        held = tokens.groupBy(F.col("lo").alias("_lo")).agg(F.count(F.lit(1)).alias("_held"))
        nodes = ranked(tokens, ["lo"], "_key", ["source", "token"], "_rank", digits=2).join(held, F.col("lo") == F.col("_lo"))
        middle = F.expr("(lo + hi + 1) div 2").cast("int")
        due = F.expr("(_held * ((lo + hi + 1) div 2 - lo)) div (hi - lo)")
        goes_left = F.col("_rank") < due
        leaf = F.col("hi") - F.col("lo") <= 1
        nodes = nodes.select(
            "source",
            "token",
            F.when(leaf | goes_left, F.col("lo")).otherwise(middle).alias("lo"),
            F.when(leaf | ~goes_left, F.col("hi")).otherwise(middle).alias("hi"),
        )
        tokens = durable(nodes)
        depth, level = depth * 2, level + 1
    return tokens.groupBy(F.col("lo").alias("shard"), "source").agg(F.count(F.lit(1)).alias("quota"))


def mixed(rows: DataFrame, n_shards: int = 8, blocks_per_shard: int = 64, seed: str = "mix") -> DataFrame:
    """Items of the mix, one for each time a document is taken.

    ``rows`` has ``row`` (unique), ``source`` and ``size``.  Returns ``row, source, size,
    source_size, target, copy, shard, slot``; rows not taken are missing.  The last
    document of a source's stream is taken when at least half of it is due, so a source
    misses its target by half a document at most.  Rows of size 0 are never taken.  Null
    is a source.  Equal input gives equal output whatever the partitioning.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(water_filled(sizes))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, total // (n_shards * blocks_per_shard))
    named = targets.withColumnRenamed("source", "_source")
    keyed = rows.filter("size > 0").withColumn("_key", hash_key(seed, F.col("source"), F.col("row")))
    stream = _running(keyed, "source", "_key", ["row"], "size", "_start").join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    at = F.col("copy") * F.col("source_size") + F.col("_start")
    items = (
        stream.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))))
        .withColumn("_at", at)
        .filter("_at + size / 2 <= target")
        .withColumn("block", F.expr(f"_at div {block}"))
    )
    items = durable(items.select("row", "source", "size", "source_size", "target", "copy", "block"))

    blocks = items.select("source", "block").distinct()
    quotas = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    leaves = split_quotas(quotas, n_shards, seed)
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("_first", F.coalesce(F.sum("quota").over(before), F.lit(0)).cast("long"))
    draws = runs.select(F.col("source").alias("_source"), "shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("quota") - 1)).alias("_draw"))
    permuted = ranked(blocks.withColumn("_key", hash_key(f"{seed}:blocks", F.col("source"), F.col("block"))), ["source"], "_key", ["block"], "_drawn", digits=2)
    drawn = permuted.join(draws, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_drawn") == F.col("_draw")))
    drawn = drawn.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "shard")

    placed = items.join(drawn, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    placed = placed.withColumn("_key", hash_key(f"{seed}:local", F.col("shard"), F.col("row"), F.col("copy")))
    return ranked(placed, ["shard"], "_key", ["row", "copy"], "slot").drop("_key", "block")


def sized(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, doc_id, source, size`` of ``docs`` (and ``carry`` as a struct), written once so that ``row`` stays.

    ``row`` is the id as text; rows that repeat an id, or have none, get ``#`` and a number
    behind it, which no id has.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    if carry:
        columns.append(F.struct(*named(carry)).alias("carried"))
    rows = durable(docs.select(*columns).withColumn("_n", F.monotonically_increasing_id()))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1 or doc_id is null").select(F.col("doc_id").alias("_again"))
    if repeated.isEmpty():
        return rows.withColumn("row", F.col("doc_id").cast("string")).drop("_n")
    marked = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_again")), "left").withColumn(
        "row",
        F.when(F.col("doc_id").isNull() | F.col("_again").isNotNull(), F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_n"))).otherwise(F.col("doc_id").cast("string")),
    )
    return durable(marked.drop("_again", "_n"))


def mix_report(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: the words the mix takes from it, and ``places``, where its copies go.

    ``places`` has ``shard:slot`` of every copy, sorted and comma-joined; slots of a shard are
    gapless from 0.  Null and empty texts have size 0 and are never taken.  Null is a source.
    Null and repeated ids and repeated rows are documents of their own.  An empty table
    gives no rows; other columns are not read.
    """
    rows = sized(docs)
    items = mixed(rows, n_shards)
    place = F.concat_ws(":", "shard", "slot")
    taken = items.groupBy("row").agg(F.sum("size").alias("taken"), F.array_join(F.sort_array(F.collect_list(place)), ",").alias("places"))
    targets = water_filled(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "_source")
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken, "row", "left")
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source",
            F.coalesce("places", F.lit("")).alias("places"),
        )
    )


def mix_documents(docs: DataFrame, n_shards: int = 8, places: bool = False) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is there twice, one not taken is gone.

    All columns come back unchanged and in order, whatever their names; with ``places``,
    ``shard`` and ``slot`` of each copy follow (columns of those names are replaced).
    Nulls, repeated rows and empty tables are as in :func:`mix_report`.
    """
    docs = docs.drop("shard", "slot") if places else docs
    rows = sized(docs, carry=docs.columns)
    items = mixed(rows.select("row", "source", "size"), n_shards).select("row", "shard", "slot")
    return items.join(rows.select("row", "carried"), "row").select("carried.*", *(["shard", "slot"] if places else []))


#: The query's rows in DuckDB: the same levels, order by hash, rule for the last document, and tree over eight shards.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (3 * source_size)::DOUBLE / w AS ratio,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT)::DOUBLE
     / (sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed
), chosen AS (
  SELECT arg_min(level, (ratio, source)) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM chosen) * w) AS target FROM levels
), stream AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(source, '\N') || ':' || doc_id::VARCHAR)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized s
), items AS (
  SELECT doc_id::VARCHAR AS row, source, size, copy, copy * source_size + start AS offs
  FROM stream JOIN targets USING (source), range(3) r(copy)
  WHERE size > 0 AND copy * source_size + start + size / 2 <= target
), cut AS (
  SELECT *, offs // greatest(1, (SELECT sum(source_size)::BIGINT FROM targets) // 512) AS block FROM items
), blocks AS (
  SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5('mix:blocks:' || source || ':' || block), block) - 1 AS drawn
  FROM (SELECT DISTINCT source, block FROM cut)
), level0 AS (
  SELECT source, unnest(range(count(*))) AS token, 0 AS lo, 8 AS hi FROM blocks GROUP BY source
), @LEVELS@, leaves AS (
  SELECT source, lo AS shard, count(*) AS quota FROM level3 GROUP BY source, lo
), runs AS (
  SELECT *, coalesce(sum(quota) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM leaves
), placed AS (
  SELECT c.row, c.copy, c.size, r.shard, row_number() OVER (PARTITION BY r.shard
    ORDER BY md5('mix:local:' || r.shard || ':' || c.row || ':' || c.copy), c.row, c.copy) - 1 AS slot
  FROM cut c JOIN blocks b ON b.source = c.source AND b.block = c.block
  JOIN runs r ON r.source = c.source AND b.drawn >= r.first AND b.drawn < r.first + r.quota
), taken AS (
  SELECT row, sum(size)::BIGINT AS taken, string_agg(shard || ':' || slot, ',' ORDER BY shard || ':' || slot) AS places FROM placed GROUP BY row
)
SELECT doc_id, size, source_size, target, source, coalesce(taken, 0)::BIGINT AS taken, coalesce(places, '') AS places
FROM sized JOIN targets USING (source) LEFT JOIN taken ON row = doc_id::VARCHAR
""".replace(
    "@LEVELS@",
    ", ".join(
        f"""level{n + 1} AS (
  SELECT source, token, CASE WHEN rank < held * ((lo + hi + 1) // 2 - lo) // (hi - lo) THEN lo ELSE (lo + hi + 1) // 2 END AS lo,
    CASE WHEN rank < held * ((lo + hi + 1) // 2 - lo) // (hi - lo) THEN (lo + hi + 1) // 2 ELSE hi END AS hi
  FROM (SELECT *, count(*) OVER (PARTITION BY lo) AS held,
    row_number() OVER (PARTITION BY lo ORDER BY md5('mix:{n}:' || source || ':' || token), source, token) - 1 AS rank FROM level{n}))"""
        for n in range(3)
    ),
)
