"""Text lines with their place: the file, and the number of the line in it.

Files are read in splits, large ones by many tasks.  A first pass counts the lines of
every split; a line's number is its place in its split plus the lines of the splits
before.  Only the counts are shuffled, never lines, and no task needs a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of splits up to this many rows is broadcast.
BROADCAST_SPLITS = 200_000


def _placed(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        # rows of a split are neighbours in their task, so these numbers are gapless within it
        F.monotonically_increasing_id().alias("place"),
    )


def located_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(line, path, line_no)`` of all files below ``path``; numbers start at 1 in every file and count empty lines."""
    # both passes plan the same scan, so their tasks hold the same splits in the same order
    splits = _placed(spark, path, glob).groupBy("path", "split_start").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        F.col("path").alias("of"), F.col("split_start").alias("at"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    lines = _placed(spark, path, glob)
    if splits.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    same = (F.col("path") == F.col("of")) & (F.col("split_start") == F.col("at"))
    return lines.join(starts, same).select("line", "path", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"))


def split_located(tagged: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects as ``(path, line_no, reason, line)``."""
    good = tagged.where(F.col("reason").isNull()).drop("reason", line, "path", "line_no")
    return good, tagged.where(F.col("reason").isNotNull()).select("path", "line_no", "reason", line)
