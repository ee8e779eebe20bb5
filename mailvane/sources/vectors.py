"""Vector sources and sinks: JSON lines, CSV and text forms, with reject accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.functions import jsontext as J
from mailvane.functions.vectors import check_dim
from mailvane.sources.lines import located_lines, split_located


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _chomp(line: Column) -> Column:
    return F.rtrim(line, F.lit("\r\n"))


def tag_vector_lines(lines: DataFrame, dim: int, line: str = "line") -> DataFrame:
    """Add ``reason`` (null for a good line), ``embedding`` and ``metadata``.

    Empty lines vanish.  Items of ``vector`` that are not numbers count as 0.0.  Of a
    repeated key the first value counts.  Metadata is kept whole.
    """
    check_dim(dim)
    members, vec = F.col("_members"), F.col("_vec")
    items = F.try_variant_get(vec, "$", "array<variant>")
    one = lambda x: F.when(J.is_number(x), F.try_variant_get(x, "$", "double")).otherwise(0.0)
    # an all-number array is cast at once; only mixed ones are looked at item by item
    numbers = J.variant_type(vec).rlike("^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    values = F.when(numbers, F.try_variant_get(vec, "$", "array<double>")).otherwise(F.transform(items, one))
    meta, meta_raw = F.try_element_at(members, F.lit("metadata")), F.get_json_object(F.col(line), "$.metadata")
    # metadata that repeats keys has no variant form; its members then hold it as text
    nested = J.variant_type(meta).rlike("^(OBJECT|ARRAY)") | (meta_raw.rlike(r"^\s*[\[{]") & J.strict_variant(F.col(line)).isNull())
    meta_text = F.when(nested, meta_raw).otherwise(F.to_json(meta))
    return (
        lines.withColumn(line, _chomp(F.col(line)))
        .where(F.col(line) != "")
        .withColumn("_members", J.object_members(F.col(line)))
        .withColumn("_vec", F.try_element_at(members, F.lit("vector")))
        .withColumn(
            "reason",
            F.when(members.isNull(), "invalid_json")
            .when(vec.isNull() | ~J.variant_type(vec).startswith("ARRAY"), "missing_vector")
            .when(F.size(items) != dim, "wrong_dimension"),
        )
        .withColumn("embedding", F.when(F.col("reason").isNull(), values.cast("array<float>")))
        .withColumn("metadata", F.when(F.col("reason").isNull(), F.coalesce(meta_text, F.lit(""))))
        .drop("_members", "_vec")
    )


def split_rejects(tagged: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    good = tagged.where(F.col("reason").isNull()).drop("reason", line)
    return good, tagged.where(F.col("reason").isNotNull()).select(line, "reason")


def reject_counts(tagged: DataFrame) -> DataFrame:
    """Rows per outcome; ``loaded`` counts the good ones."""
    return tagged.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def load_vectors_jsonl(spark: SparkSession, path: str, dim: int, located: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` of a JSON-lines file or folder; with ``located`` rejects name file and line number."""
    if located:
        return split_located(tag_vector_lines(located_lines(spark, path), dim))
    return split_rejects(tag_vector_lines(text_lines(spark, path), dim))


def export_lines(
    table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", metadata: str | None = None, active: str | None = None
):
    """One JSON text per row: id, vector with six significant digits, metadata as it is.

    With ``active`` named, rows for which that column is not true are left out.
    """
    table = table.where(F.col(active)) if active else table
    numbers = F.array_join(F.transform(F.col(vector), J.number_g6), ", ")
    head = F.concat(
        F.lit('{"id": '), F.col(id_col).cast("string"), F.lit(', "vector": ['), numbers, F.lit("]")
    )
    tail = F.lit("")
    if metadata:
        m = F.coalesce(F.col(metadata), F.lit(""))
        tail = F.when(m != "", F.concat(F.lit(', "metadata": '), m)).otherwise("")
    return table.select(F.col(id_col), F.concat(head, tail, F.lit("}")).alias("line"))


def export_jsonl(table: DataFrame, path: str, id_col: str = "vec_id", **kwargs) -> None:
    """Write the export as text files, in id order across the files."""
    lines = export_lines(table, id_col, **kwargs)
    lines.repartitionByRange(id_col).sortWithinPartitions(id_col).select("line").write.text(path)
