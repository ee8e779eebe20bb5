"""Line numbers over files read in many splits, and searches that leave out the own row."""

import random

import pytest
from pyspark.sql import functions as F

from mailvane.operators import ann, knn
from mailvane.operators.classify import Classifier
from mailvane.sources.lines import located_lines
from mailvane.sources.mail import load_mail_jsonl, load_mail_tsv
from mailvane.sources.vectors import load_vectors_jsonl


@pytest.fixture
def small_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def folder_of(tmp_path, name, files):
    folder = tmp_path / name
    for i, lines in enumerate(files):
        (folder / f"sub{i % 2}").mkdir(parents=True, exist_ok=True)
        (folder / f"sub{i % 2}" / f"f{i}.txt").write_text("\n".join(lines) + ("\n" if i % 3 else ""))
    return folder


def test_line_numbers_over_splits(spark, small_splits, tmp_path):
    rng = random.Random(1)
    files = [[rng.choice(["", "x", "y" * rng.randrange(1, 900), "z" * 20]) + str(j) * (j % 3) for j in range(n)] for n in (1, 40, 200, 3, 77)]
    folder = folder_of(tmp_path, "lines", files)
    lines = located_lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 3 * len(files)
    got = {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in lines.collect()}
    want = {}
    for i, f in enumerate(files):
        text = (folder / f"sub{i % 2}" / f"f{i}.txt").read_text()
        lines = text.removesuffix("\n").split("\n") if text else []
        want |= {(f"f{i}.txt", n + 1): x for n, x in enumerate(lines)}
    assert got == want


def test_rejects_name_their_line(spark, small_splits, tmp_path):
    good, bad, short = '{"vector":[1,2],"metadata":{"a":1}}', "{broken", '{"vector":[1]}'
    files = [[good, "", bad, good, short] * 30, [bad], [good] * 40 + [bad]]
    rows, rejects = load_vectors_jsonl(spark, str(folder_of(tmp_path, "vectors", files)), 2, located=True)
    reason = {bad: "invalid_json", short: "wrong_dimension"}
    want = {(f"f{i}.txt", n + 1, reason[x], x) for i, f in enumerate(files) for n, x in enumerate(f) if x in reason}
    assert {(r["path"].rsplit("/", 1)[1], r["line_no"], r["reason"], r["line"]) for r in rejects.collect()} == want
    assert rows.columns == ["embedding", "metadata"] and rows.count() == 100

    mails = [['{"category":"spam","subject":"a","body":"b"}', "# note", " ", '{"category":"odd"}'] * 20]
    rows, rejects = load_mail_jsonl(spark, str(folder_of(tmp_path, "mails", mails)), located=True)
    assert sorted(r["line_no"] for r in rejects.collect()) == [4 * i + 4 for i in range(20)]
    assert rows.count() == 20
    tsv = [["a\tb", "no tab", ""] * 25]
    rows, rejects = load_mail_tsv(spark, str(folder_of(tmp_path, "tsv", tsv)), located=True)
    assert sorted(r["line_no"] for r in rejects.collect()) == [3 * i + 2 for i in range(25)]
    assert rows.count() == 25


def test_no_lines_at_all(spark, tmp_path):
    folder = folder_of(tmp_path, "none", [[""], [""]])
    assert [(r["line_no"], r["line"]) for r in located_lines(spark, str(folder)).collect()] == [(1, "")]


@pytest.fixture(scope="module")
def corpus(spark):
    """Groups of copies, so that an own row is among rows of equal distance."""
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(25)]
    rows = [(i, "ab"[i % 2], base[rng.randrange(25)]) for i in range(160)]
    return spark.createDataFrame([*rows, (160, "c", base[0])], "vec_id long, category string, embedding array<double>")


def asked(df):
    return df.select(F.col("vec_id").alias("qid"), "embedding")


def rows_of(df):
    return {(r["qid"], r["category"], r["rank"]): r["vec_id"] for r in df.collect()}


def without_own(corpus, k, category):
    """From a search of everything, own rows dropped and ranks counted anew."""
    near = knn.knn_join(asked(corpus), corpus, 500, category=category).collect()
    kept, out = {}, {}
    for r in sorted(near, key=lambda r: (r["qid"], r["category"] or "", r["rank"])):
        if r["vec_id"] != r["qid"]:
            n = kept[r["qid"], r["category"]] = kept.get((r["qid"], r["category"]), 0) + 1
            if n <= k:
                out[r["qid"], r["category"], n] = r["vec_id"]
    return out


@pytest.mark.parametrize("plan", ["corpus", "queries", "blocks"])
@pytest.mark.parametrize("category", [None, "category"])
def test_own_row_is_left_out(corpus, plan, category):
    found = knn.knn_join(asked(corpus), corpus, 3, category=category, plan=plan, block_rows=40, leave_out_own=True)
    assert rows_of(found) == without_own(corpus, 3, category)


def test_own_row_is_left_out_of_the_index(corpus):
    index = ann.build_index(corpus, 4)
    found = ann.search(index, asked(corpus), corpus, 3, n_probe=4, leave_out_own=True)
    assert rows_of(found) == without_own(corpus, 3, None)


def test_a_mail_alone_in_its_category_has_no_vote_for_it(spark):
    mails = spark.createDataFrame(
        [(1, "attack", "verify your password now"), (2, "safe", "minutes of the meeting"), (3, "safe", "notes of the meeting")],
        "vec_id long, category string, text string",
    )
    from mailvane.operators.vectorize import vectorize

    rows = mails.select("vec_id", "category", vectorize(F.col("text"), "basic").alias("embedding"))
    for limit in (0, knn.BROADCAST_BYTES):
        c = Classifier(rows, profile="basic", leave_out_own=True, broadcast_bytes=limit)
        got = {r["vec_id"]: r for r in c.stage1(mails, "vec_id", F.col("text")).collect()}
        assert got[1]["category"] == "safe" and sum(got[1]["counts"]) == 2
        assert got[2]["category"] == "safe" and sum(got[2]["counts"]) == 2
