"""Id ranges of a corpus that several writers share.

``_ids`` in the corpus folder holds numbered entries, each a range of ids and who has it.
A writer claims the ids after the last entry by renaming a file of its own to the next
number; the rename fails where that number exists, and it looks again.  So no two
writers share an id, and a batch that is repeated finds the range it had.  The store
must rename atomically (HDFS, a local disk), as checkpoints of streams ask as well.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.operators.table import dense_rank_ids
from mailvane.sources.corpus import read_corpus, write_corpus
from mailvane.sources.tables import filesystem, hadoop_path, written

_FOLDER = "_ids"
_ATTEMPTS = 1000


def _entries(spark: SparkSession, corpus: str) -> list[dict]:
    """All entries in order; a handful of bytes per batch."""
    folder = f"{corpus}/{_FOLDER}"
    if not filesystem(spark, corpus).exists(hadoop_path(spark, folder)):
        return []
    rows = spark.read.schema("entry long, owner string, first long, n long").option("pathGlobFilter", "*.json").json(folder)
    return [r.asDict() for r in rows.orderBy("entry").collect()]


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename without overwriting; False where the target exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path(spark, target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hadoop_path(spark, source), hadoop_path(spark, target), options)
    except Exception as e:  # the JVM's exception; py4j has one class for all of them
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
            return False
        raise
    return True


def _offer(spark: SparkSession, corpus: str, entry: dict) -> bool:
    files, folder = filesystem(spark, corpus), f"{corpus}/{_FOLDER}"
    files.mkdirs(hadoop_path(spark, folder))
    own = f"{folder}/.offer-{uuid.uuid4().hex}"
    out = files.create(hadoop_path(spark, own), False)
    out.write(json.dumps(entry).encode())
    out.close()
    if _renamed(spark, own, f"{folder}/{entry['entry']:012d}.json"):
        return True
    files.delete(hadoop_path(spark, own), False)
    return False


def claim_ids(spark: SparkSession, corpus: str, owner: str, n: int) -> int:
    """First of ``n`` ids that are the owner's alone; the same ones if it has claimed before.

    The first claim in a corpus that has rows already starts after their highest id.
    An owner that comes again with another number of rows is refused: its batch has changed.
    """
    for _ in range(_ATTEMPTS):
        entries = _entries(spark, corpus)
        for e in entries:
            if e["owner"] == owner:
                if e["n"] != n:
                    raise ValueError(f"{owner} holds {e['n']} ids, not {n}")
                return e["first"]
        if entries:
            number, first = entries[-1]["entry"] + 1, entries[-1]["first"] + entries[-1]["n"]
        else:
            number = 1
            first = 1 + read_corpus(spark, corpus).agg(F.coalesce(F.max("vec_id"), F.lit(0)).alias("top")).first()["top"]
        if _offer(spark, corpus, {"entry": number, "owner": owner, "first": first, "n": n}):
            return first
    raise RuntimeError(f"no id range after {_ATTEMPTS} attempts")


def number_rows(rows: DataFrame, corpus: str, owner: str, order: str, id_col: str = "vec_id") -> DataFrame:
    """``rows`` with ids of a range claimed for ``owner``, gapless and in the order of a column."""
    kept = written(rows)
    first = claim_ids(rows.sparkSession, corpus, owner, kept.count())
    return dense_rank_ids(kept, order, F.lit(first), id_col)


def load_batch(rows: DataFrame, corpus: str, batch: str, order: str = "_order") -> None:
    """Append rows ``(category, embedding, metadata, <order>)`` under ids of their own; again, it replaces itself."""
    numbered = number_rows(rows, corpus, batch, order)
    write_corpus(numbered.select("vec_id", "category", "embedding", "metadata"), corpus, batch=batch)
