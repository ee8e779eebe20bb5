"""Ids of several writers, class distances over pairs of blocks, and comparison of stored tables."""

import math
import random
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mailvane.operators.classdist import class_distances, class_distances_by_pairs
from mailvane.operators.vectorize import table_diff
from mailvane.sources import ledger
from mailvane.sources.corpus import read_corpus, write_corpus
from mailvane.streaming.training import train_stream

ROWS = "vec_id long, category string, embedding array<float>, metadata string"


def some(spark, n, category="spam", first=None):
    rows = [(first + i if first else None, category, [float(i), 1.0], f"m{i}") for i in range(n)]
    return spark.createDataFrame(rows, ROWS).withColumn("_order", F.col("metadata"))


def test_ranges_follow_each_other_and_stay(spark, tmp_path):
    path = str(tmp_path / "corpus")
    write_corpus(some(spark, 4, first=10).drop("_order"), path, batch="old")
    assert ledger.claim_ids(spark, path, "a", 5) == 14
    assert ledger.claim_ids(spark, path, "b", 0) == 19
    assert ledger.claim_ids(spark, path, "c", 2) == 19
    assert ledger.claim_ids(spark, path, "a", 5) == 14
    with pytest.raises(ValueError):
        ledger.claim_ids(spark, path, "a", 6)
    assert read_corpus(spark, path).count() == 4  # the ledger is no part of the corpus


def test_an_entry_is_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "corpus")
    entry = {"entry": 1, "owner": "a", "first": 1, "n": 3}
    assert ledger._offer(spark, path, entry)
    assert not ledger._offer(spark, path, entry | {"owner": "b"})
    assert [e["owner"] for e in ledger._entries(spark, path)] == ["a"]
    # what was offered in vain is gone
    assert not [f.name for f in (tmp_path / "corpus" / "_ids").iterdir() if f.name.startswith(".offer")]


def test_a_writer_that_is_overtaken_looks_again(spark, tmp_path, monkeypatch):
    path, offer = str(tmp_path / "corpus"), ledger._offer
    overtaken = []

    def slow(spark, corpus, entry):
        if entry["owner"] == "slow" and not overtaken:
            overtaken.append(offer(spark, corpus, entry | {"owner": "quick"}))
        return offer(spark, corpus, entry)

    monkeypatch.setattr(ledger, "_offer", slow)
    assert ledger.claim_ids(spark, path, "slow", 3) == 4
    assert overtaken == [True]


def test_loads_side_by_side_share_no_id(spark, tmp_path):
    path = str(tmp_path / "corpus")
    read_corpus(spark, path)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: ledger.load_batch(some(spark, 5 + n, ["safe", "spam", "attack"][n]), path, f"load-{n}"), range(3)))
    before = {r["metadata"] + r["category"]: r["vec_id"] for r in read_corpus(spark, path).collect()}
    assert sorted(before.values()) == list(range(1, 19))
    ledger.load_batch(some(spark, 6, "spam"), path, "load-1")  # again: same rows, same ids
    assert {r["metadata"] + r["category"]: r["vec_id"] for r in read_corpus(spark, path).collect()} == before


def test_two_streams_train_one_corpus(spark, tmp_path):
    row = '{"category": "%s", "subject": "%s%d", "body": "free prize %d"}'
    streams = []
    for name, category in (("one", "spam"), ("two", "safe")):
        for part in range(3):
            folder = tmp_path / name
            folder.mkdir(exist_ok=True)
            (folder / f"{part}.jsonl").write_text("\n".join(row % (category, name, i, part) for i in range(4 + part)))
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).withColumnRenamed("value", "line")
        streams.append(train_stream(lines, f"{tmp_path}/corpus", f"{tmp_path}/out-{name}", f"{tmp_path}/checkpoint-{name}", once=True))
    for s in streams:
        s.awaitTermination()
    rows = read_corpus(spark, f"{tmp_path}/corpus").collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(1, 31))
    batches = defaultdict(list)
    for r in rows:
        batches[r["batch"]].append(r["vec_id"])
    assert len(batches) == 6
    for ids in batches.values():
        assert sorted(ids) == list(range(min(ids), min(ids) + len(ids)))


def vectors(n, dim=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab") if i else "z", [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return [*rows[:-3], *[(n + j, "a", rows[0][2]) for j in range(3)], (n + 9, None, rows[0][2])]


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
@pytest.mark.parametrize("block_rows", [4096, 13])
def test_class_distances_by_pairs(spark, metric, block_rows):
    rows = vectors(90)
    far = {"euclidean": math.dist, "dot": lambda a, b: -sum(x * y for x, y in zip(a, b))}[metric]
    sums = defaultdict(list)
    held = [r for r in rows if r[1] is not None]
    for i, (_, la, a) in enumerate(held):
        for _, lb, b in held[i + 1 :]:
            sums[min(la, lb), max(la, lb)].append(far(a, b))
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    got = {(r[0], r[1]): (r[2], r[3]) for r in class_distances_by_pairs(df, metric=metric, block_rows=block_rows).collect() if r[3]}
    assert set(got) == set(sums)
    for key, d in sums.items():
        assert got[key][1] == len(d) and got[key][0] == pytest.approx(sum(d) / len(d), abs=1e-6)


def test_cosine_has_its_closed_form(spark):
    df = spark.createDataFrame(vectors(40), "vec_id long, label string, embedding array<double>").where("label IS NOT NULL")
    rows = lambda d: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in d.collect())
    assert rows(class_distances_by_pairs(df, metric="cosine")) == rows(class_distances(df))


def test_table_diff(spark):
    schema = "vec_id long, embedding array<float>"
    left = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (5, None)], schema)
    right = spark.createDataFrame([(1, [1.0, 0.0005, 2.0]), (2, [1.0, -1.0, 3.0]), (4, [2.0])], schema)
    got = {r["vec_id"]: (r["side"], round(r["distance"], 5), r["n_diff"]) for r in table_diff(left, right).collect()}
    assert got == {
        1: ("both", 0.0, 0), 2: ("both", 1.0, 2), 3: ("left", 1.0, 0), 4: ("right", 1.0, 1), 5: ("left", 1.0, 0)
    }
