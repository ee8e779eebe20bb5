"""Mail sources: labelled JSON lines, TSV, plain text and raw messages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions import jsontext as J
from mailvane.functions.mail import strip
from mailvane.sources.lines import located_lines, split_located
from mailvane.sources.tables import local_folder, written
from mailvane.sources.vectors import split_rejects, text_lines


def tag_mail_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Labelled mail per JSON line: ``reason, category, subject, body``.

    Blank lines and lines starting with ``#`` vanish.  Keys count in upper and lower case
    alike; of a repeated one the last value that is not null counts.  A missing member is
    ''; a member of another type than string makes the line invalid.
    """
    members = F.col("_members")
    member = lambda name: J.last_member(members, name)
    typed = lambda name: F.coalesce(J.variant_type(member(name)), F.lit("STRING")) == "STRING"
    text = lambda name: F.coalesce(F.try_variant_get(member(name), "$", "string"), F.lit(""))
    valid = members.isNotNull() & typed("category") & typed("subject") & typed("body")
    category = F.lower(text("category"))
    return (
        lines.withColumn(line, strip(F.col(line)))
        .where((F.col(line) != "") & ~F.col(line).startswith("#"))
        .withColumn("_members", J.object_members(F.col(line)))
        .withColumn(
            "reason",
            F.when(~F.coalesce(valid, F.lit(False)), "invalid_json").when(
                ~category.isin(V.CATEGORIES), "invalid_category"
            ),
        )
        .withColumns({"category": category, "subject": text("subject"), "body": text("body")})
        .drop("_members")
    )


def load_mail_jsonl(spark: SparkSession, path: str, located: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; with ``located`` rejects name file and line number."""
    if located:
        return split_located(tag_mail_lines(located_lines(spark, path)))
    return split_rejects(tag_mail_lines(text_lines(spark, path)))


def tag_tsv_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``subject<TAB>body`` lines, split at the first tab; a line without tab is rejected."""
    at = F.instr(F.col(line), "\t")
    return (
        lines.withColumn(line, F.regexp_replace(F.col(line), r"\r?\n?\z", ""))
        .where(F.col(line) != "")
        .withColumn("reason", F.when(at == 0, "no_tab"))
        .withColumns({"subject": F.substring_index(F.col(line), "\t", 1), "body": F.substr(F.col(line), at + 1)})
    )


def load_mail_tsv(spark: SparkSession, path: str, located: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; with ``located`` rejects name file and line number."""
    if located:
        return split_located(tag_tsv_lines(located_lines(spark, path)))
    return split_rejects(tag_tsv_lines(text_lines(spark, path)))


#: Messages that one task writes or reads as files.
FILES_A_TASK = 2048


def _write_local(placed: DataFrame, folder: str) -> None:
    """The files of ``placed(part, nth, raw)`` in a folder that all tasks reach by its path.

    The names are those of Spark's writer, which starts a process for the mode of each file
    and of its checksum here.  A task that is run again writes the same files.
    """
    os.makedirs(folder)
    load = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            raw = batch["raw"].cast(pa.large_binary())
            for part, nth, text in zip(batch["part"].to_pylist(), batch["nth"].to_pylist(), raw):
                name = f"part-{part:05d}-{load}-c{nth:03d}.txt"
                # hidden until it is whole
                with open(new := f"{folder}/.{name}.{uuid.uuid4().hex}", "xb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                os.replace(new, f"{folder}/{name}")
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    placed.select("part", "nth", "raw").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_raw_mail(mails: DataFrame, path: str) -> DataFrame:
    """A file for each message of ``mails(mail_id, raw)``, all in the one folder ``path``.

    Returns ``(part, nth, mail_id)``, which names the messages of the files (see
    :func:`named_raw_mail`).  A folder for each message as well would cost the writer
    and the lister more than its file does.
    """
    parts = max(mails.sparkSession.sparkContext.defaultParallelism, -(-mails.count() // FILES_A_TASK))
    part = F.pmod(F.col("row"), F.lit(parts)).cast("int").alias("part")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    # rows of a task are consecutive, and dealt in turn
    rows = mails.select(F.monotonically_increasing_id().alias("row"), "mail_id", "raw").select("*", part)
    placed = written(rows.select("part", nth.alias("nth"), "mail_id", "raw"))
    local = local_folder(mails.sparkSession, path)
    if local:
        _write_local(placed, local)
    else:
        # task and count of a file are the part and place of its message
        dealt = placed.repartitionById(parts, "part").sortWithinPartitions("nth")
        dealt.select("raw").write.option("maxRecordsPerFile", 1).text(path)
    return placed.select("part", "nth", "mail_id")


def named_raw_mail(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files of :func:`load_raw_mail` under the ``mail_id`` of their message."""
    name = r"/part-(\d+)-[^/]*-c(\d+)\.[^/]*$"
    at = lambda group: F.regexp_extract("mail_id", name, group).cast("int")
    placed = files.select(at(1).alias("part"), at(2).alias("nth"), F.regexp_replace("raw", r"\n\z", "").alias("raw"))
    # the writer ends every file with a line feed
    return placed.join(index, ["part", "nth"]).select("mail_id", "raw")


def load_raw_mail(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``mail_id`` (the file's path) and ``raw``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("mail_id"), F.col("value").alias("raw")
    )


def firstline_subject(text: Column) -> tuple[Column, Column]:
    """``(subject, body)`` of a plain text: first line and the rest."""
    at = F.instr(text, "\n")
    return F.substring_index(text, "\n", 1), F.when(at > 0, F.substr(text, at + 1)).otherwise("")


def load_plain_mail(spark: SparkSession, path: str) -> DataFrame:
    subject, body = firstline_subject(F.col("raw"))
    return load_raw_mail(spark, path).select("mail_id", subject.alias("subject"), body.alias("body"))


def subject_metadata(subject: Column) -> Column:
    """``{"subject":"..."}`` with backslash, quote, newline, CR and tab escaped."""
    text = subject
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('{"subject":"'), text, F.lit('"}'))
