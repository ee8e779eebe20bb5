"""Continuous growth of a corpus from labelled-mail lines."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailvane.operators.classify import train_corpus
from mailvane.sources.corpus import write_corpus
from mailvane.sources.ledger import number_rows
from mailvane.sources.mail import tag_mail_lines
from mailvane.sources.tables import written
from mailvane.sources.vectors import reject_counts


def train_stream(
    lines: DataFrame, corpus: str, outcomes: str, checkpoint: str, *, profile: str = "enhanced", once: bool = False
) -> StreamingQuery:
    """Append the good lines of a stream ``(line)`` to ``corpus``; count outcomes per batch.

    The corpus has the layout of :func:`write_corpus` and may hold rows already.  A batch
    is named by the checkpoint and its number, so another checkpoint overwrites nothing and
    a repeated batch replaces itself.  Its ids are a range that the corpus's ledger gives to
    no other writer, in the order of a hash of the line.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def train(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{stream}-{batch_id}"
        tagged = written(tag_mail_lines(batch))
        good = tagged.where("reason IS NULL").withColumn("_order", F.xxhash64("line"))
        numbered = number_rows(good, corpus, name, "_order", "mail_id")
        write_corpus(train_corpus(numbered, profile=profile), corpus, batch=name)
        reject_counts(tagged).write.mode("overwrite").parquet(f"{outcomes}/batch={name}")

    writer = lines.writeStream.foreachBatch(train).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
