"""Table reading, and tables written on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from mailvane.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.  The folder
    goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = hadoop_path(spark, path)
    filesystem(spark, path).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark, path: str):
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_folder(spark, path: str) -> str | None:
    """``path`` as files of this machine (or a mount all machines share) have it; None in any other store."""
    files = filesystem(spark, path)
    return files.makeQualified(hadoop_path(spark, path)).toUri().getPath() if files.getUri().getScheme() == "file" else None


def spread(scan: DataFrame) -> DataFrame:
    """Rows over all cores if a plain scan has fewer splits than there are cores.

    Featurizing and parsing are narrow and heavy on the processor; a table of a few
    files (or row groups) would leave most cores idle.  A large table has far more
    splits than cores and is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
