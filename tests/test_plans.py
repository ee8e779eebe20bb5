"""Plan shapes, and the registered queries against their check SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, queries
from mailvane.operators import knn
from mailvane.plans import CHECK_SQL, QUERIES
from mailvane.plans import vector_queries as vq
from tools.check_queries import check, connect

# the widest query of each family; MAILVANE_ALL_QUERIES=1 runs them all
WIDEST = """
load_vectors_jsonl load_vectors_rejects parse_vector_csv export_jsonl append_ids upsert_latest delete_by_id
category_stats vec_cosine_distance vec_normalize knn_single knn_join_euclidean knn_join_blocks knn_similarity
knn_per_category ann_assign_cells knn_ann_probe class_distance_matrix knn_confidence classify_unknown
tokenize_ascii stopwords fnv_hash sign_hash boosted_unigrams char_trigrams two_pass_features vectorize_basic
vectorize_enhanced vectorize_counts vectorize_json collision_words profile_diff
load_mail_jsonl load_mail_tsv mail_unfold mail_headers_long parse_mail extract_urls url_domains risk_score
risk_text_only classify_raw classify_summary evaluate_misses train_corpus
knn_join_query_broadcast knn_per_category_query_broadcast knn_active export_active metadata_round_trip bigrams
unigram_counts classify_text_index classify_missing_category evaluate_text evaluate_raw corpus_append corpus_replace
""".split()
CHECKED = sorted(CHECK_SQL) if os.environ.get("MAILVANE_ALL_QUERIES") else WIDEST


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(sf_dir) -> duckdb.DuckDBPyConnection:
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_check_sql(spark, con, sf_dir, name):
    verdict, _, _ = check(spark, con, name, sf_dir)
    assert verdict.startswith("ok"), verdict


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(CHECK_SQL) == {
        "ann_index_build", "knn_ann", "knn_ann_clustered", "ann_recall", "ann_recall_clustered", "knn_pruned_visits", "lsh_recall"
    }


def test_no_cross_join_anywhere(spark, sf_dir):
    for name in [*WIDEST, "knn_ann", "ann_recall", "classify_raw_joined"]:
        text = plan(queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_rules_and_parsing_run_without_python(spark, sf_dir):
    for name in ("parse_mail", "risk_score", "risk_text_only", "typosquat", "extract_urls", "fnv_hash"):
        assert "EvalPython" not in plan(queries()[name](spark, sf_dir)), name


def test_flagship_is_one_narrow_stage(spark, sf_dir):
    text = plan(entry(spark))
    assert text.count("ArrowEvalPython") == 1  # vectorizing and searching share one Python stage
    assert "Exchange hashpartitioning" not in text


def test_vectors_are_computed_once(spark, sf_dir):
    for name in ("vectorize_basic", "vectorize_enhanced", "vectorize_json", "knn_per_category", "train_corpus"):
        assert plan(queries()[name](spark, sf_dir)).count("EvalPython [") <= 2, name
    assert plan(queries()["vectorize_enhanced"](spark, sf_dir)).count("EvalPython [") == 1


def test_features_are_counted_within_the_row(spark, sf_dir):
    for name in ("unigram_counts", "boosted_unigrams", "bigrams", "char_trigrams", "two_pass_features"):
        text = plan(queries()[name](spark, sf_dir))
        assert "Exchange hashpartitioning(doc_id" not in text and "Exchange hashpartitioning(mail_id#" not in text.split("Generate")[0], name


def test_block_join_shuffles_each_side_once(spark, sf_dir):
    text = plan(queries()["knn_join_blocks"](spark, sf_dir))
    assert "WindowGroupLimit" in text
    assert text.count("Exchange hashpartitioning") == 3  # two sides, and the merge by query


def test_column_pruning_and_pushdown(spark, sf_dir):
    text = plan(queries()["get_by_id"](spark, sf_dir))
    assert "struct<vec_id:bigint,label:int>" in text
    lookup = plan(vq.tb.get_by_id(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 42))
    assert "EqualTo(vec_id,42)" in lookup


def test_size_check_reads_no_more_than_the_bound(spark):
    df = spark.range(1000)
    assert not knn.fits_broadcast(df, 1, 8 * 999) and knn.fits_broadcast(df, 1, 8 * 1000)
