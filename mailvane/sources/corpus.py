"""Corpus tables on disk: folders by category, and within them by the batch that wrote them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.sources.tables import filesystem, hadoop_path

CORPUS_SCHEMA = "vec_id long, embedding array<float>, metadata string, category string, batch string"


def write_corpus(rows: DataFrame, path: str, mode: str = "append", batch: str | None = None) -> None:
    """Append rows ``(vec_id, category, embedding, metadata)``, or replace the categories they hold.

    ``batch`` names the folder within each category (a new one by default); writing the
    same batch again replaces it, so a repeated append leaves no duplicates.  With
    ``mode="replace"`` the other batches of these categories go once the rows are written.
    Rows of one category spread over all tasks.
    """
    if mode not in ("append", "replace"):
        raise ValueError("mode is 'append' or 'replace'")
    spark, batch = rows.sparkSession, batch or f"load-{uuid.uuid4().hex}"
    known = F.col("category").isin(V.CATEGORIES)
    checked = rows.select(
        "vec_id",
        "embedding",
        "metadata",
        F.when(known, F.col("category")).otherwise(F.raise_error(F.lit("unknown category"))).alias("category"),
        F.lit(batch).alias("batch"),
    )
    checked.write.partitionBy("category", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    if mode == "replace":
        files = filesystem(spark, path)
        for category in V.CATEGORIES:
            if files.exists(hadoop_path(spark, f"{path}/category={category}/batch={batch}")):
                for other in files.listStatus(hadoop_path(spark, f"{path}/category={category}")):
                    if other.getPath().getName() != f"batch={batch}":
                        files.delete(other.getPath(), True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus at ``path``; without rows if nothing has been written there yet."""
    files = filesystem(spark, path)
    if not files.exists(hadoop_path(spark, path)):
        files.mkdirs(hadoop_path(spark, path))
    return spark.read.schema(CORPUS_SCHEMA).parquet(path)
