"""Each stage of the pipeline on what the one before kept, and the registration."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailvane.llm import mixing, neardup, quality, queries
from mailvane.llm.shared import durable, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of every stage."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = durable(stage(spark, docs, sf_dir))
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_return_documents(stages, spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    assert [n for n in stages] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_quality_stage(stages, spark, sf_dir):
    before, after = stages["quality_rules"]
    kept = {r["doc_id"] for r in quality.quality_report(before, table(spark, sf_dir, "labels")).collect() if r["kept"]}
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in before.collect() if r["doc_id"] in kept)
    assert 0 < after.count() < before.count()


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    kept = {r["doc_id"] for r in neardup.near_duplicate_groups(before).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(kept)
    groups = neardup.near_duplicate_groups(after).collect()
    assert all(r["kept"] for r in groups)  # one document of each component is left, so no links are


def test_secret_stage(stages):
    before, after = (stages["secret_scan"][k].collect() for k in (0, 1))
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    assert not any(re.search(r"[0-9a-f]{24,}", r["text"] or "") for r in after)
    old = {r["doc_id"]: r for r in before}
    for r in after:
        if "[SECRET]" not in r["text"]:
            assert r == old[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_secret_stage_replaces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(20)
    marked = docs.withColumn("text", F.concat("text", F.lit(" key 0123456789abcdef0123456789abcdef"))).withColumn("n_chars", F.length("text").cast("long"))
    rows = corpus_pipeline.secrets(spark, marked, sf_dir).collect()
    assert len(rows) == 20 and all(r["text"].endswith(" key [SECRET]") and r["n_chars"] == len(r["text"]) for r in rows)


def test_mix_stage(stages):
    before, after = stages["source_mix"]
    times = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix_report(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in times.items() if n})


def test_packing_stage(stages):
    before, after = (stages["packing"][k].collect() for k in (0, 1))
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after if r["piece"] == 0)
    room = Counter()
    for r in after:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    _, last = stages["packing"]
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(last)


#: Names of steps and results inside the stages.
CLASHING = [
    "_trusted", "_gone", "_gone_", "_key", "_rows", "_n", "_target", "_words", "carried", "row", "size", "target", "taken", "shard", "slot",
    "block", "score", "kept", "component_id", "spans", "piece", "key", "copy", "dotted",
]


def test_stages_with_clashing_columns_and_nulls(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", len(text)), (2, None, None, None, None), (None, text, "en", None, 3), (3, "", "en", "b", 0), (1, text, "en", "a", len(text))]
    for data in (rows, []):
        docs = spark.createDataFrame(data, names).withColumns({n: F.lit(n) for n in CLASHING}).withColumnRenamed("dotted", "a.b")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = durable(stage(spark, docs, sf_dir))
            assert docs.columns == columns, name
        left = {r["doc_id"]: r for r in docs.collect()}
        assert set(left) == ({1, None} if data else set())
        assert all(r["_gone"] == "_gone" and r["a.b"] == "dotted" and r["text"] == text for r in left.values())
        assert (durable(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)).count() > 0) == bool(data)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.CHECK_SQL) <= set(names) and set(queries.CHECK_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_check_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(queries.CHECK_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].itertuples(index=False)))
    assert rows(got) == rows(want)


def test_guard_for_missing_subpackage():
    """Without the subpackage and the pipeline the entry point still has all other queries."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'mailvane.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'classify_raw' in e.queries() and not any(x.startswith('op') or x == 'pipeline' for x in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
