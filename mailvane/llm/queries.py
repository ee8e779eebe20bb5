"""The registered queries of this subpackage, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailvane.llm.alignment import alignment_report
from mailvane.llm.fingerprints import fingerprint_report
from mailvane.llm.licenses import scan, scan_sql
from mailvane.llm.mixing import MIX_SQL, mix_report
from mailvane.llm.neardup import near_duplicate_groups
from mailvane.llm.negatives import HARD_NEGATIVES_SQL, hard_negative_report
from mailvane.llm.packing import packed
from mailvane.llm.quality import quality_report
from mailvane.llm.repeats import without_repeats
from mailvane.llm.retrieval import TOP_PRODUCTS_SQL, top_products_report
from mailvane.llm.secrets import secret_report
from mailvane.llm.sharding import shard_report
from mailvane.llm.shared import table
from mailvane.llm.toxicity import toxicity_report

Query = Callable[[SparkSession, str], DataFrame]


def _documents(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


def _embeddings(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "embeddings"))


def _labelled(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_interleaved_shards": _documents(shard_report),
    "op2_near_duplicates": _documents(near_duplicate_groups),
    "op3_source_mix": _documents(mix_report),
    "op4_toxicity": _labelled(toxicity_report),
    "op5_secrets": _documents(secret_report),
    "op6_repeated_strings": _documents(without_repeats),
    "op7_quality": _labelled(quality_report),
    "op8_fingerprints": _documents(fingerprint_report),
    "op9_packing": _documents(packed),
    "op10_licenses": _documents(scan),
    "op11_hard_negatives": _embeddings(hard_negative_report),
    "op12_top_products": _embeddings(top_products_report),
    "op13_token_alignment": _documents(alignment_report),
}

CHECK_SQL: dict[str, str] = {
    "op3_source_mix": MIX_SQL,
    "op10_licenses": scan_sql(),
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_top_products": TOP_PRODUCTS_SQL,
}
