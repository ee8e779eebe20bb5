import json

import pytest
from pyspark.sql import functions as F

from mailvane.operators import classify as C
from mailvane.operators import table as tb
from mailvane.sources import corpus as corpus_io
from mailvane.sources import mail as msrc
from mailvane.sources import vectors as vsrc


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_vector_lines(spark, tmp_path):
    lines = [
        '{"vector": [1, 2.5], "metadata": {"b": 1, "a": "x"}}',
        '{"vector": ["1", null], "metadata": "m"}',
        '{"vector": [3, 4]}',
        '{"vector": [1, 2]} trailing',
        '{"vector": [1, 2]}]',
        '{"vector": [1, 2]}, {}',
        "[1, 2]",
        '{"vec": [1, 2]}',
        '{"vector": "1,2"}',
        '{"vector": [1]}',
        '{"vector": [1, 2',
        "",
        "  ",
    ]
    path = write(tmp_path / "v.jsonl", "\n".join(lines) + "\n")
    good, rejects = vsrc.load_vectors_jsonl(spark, path, 2)
    assert sorted((r["embedding"], r["metadata"]) for r in good.collect()) == [
        ([0.0, 0.0], '"m"'), ([1.0, 2.5], '{"b":1,"a":"x"}'), ([3.0, 4.0], "")
    ]
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == ["invalid_json"] * 6 + ["missing_vector"] * 2 + ["wrong_dimension"]
    counts = {r["outcome"]: r["n_lines"] for r in
              vsrc.reject_counts(vsrc.tag_vector_lines(vsrc.text_lines(spark, path), 2)).collect()}
    assert counts == {"loaded": 3, "invalid_json": 6, "missing_vector": 2, "wrong_dimension": 1}


def test_vector_export_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(2, [0.5, -1.25], '{"x":1}'), (1, [1e-7, 3.0], "")],
                              "vec_id long, embedding array<float>, metadata string")
    vsrc.export_jsonl(t, f"{tmp_path}/out", metadata="metadata")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines) == [
        '{"id": 1, "vector": [1e-07, 3]}', '{"id": 2, "vector": [0.5, -1.25], "metadata": {"x":1}}'
    ]
    good, rejects = vsrc.load_vectors_jsonl(spark, f"{tmp_path}/out", 2)
    assert good.count() == 2 and rejects.count() == 0


def test_mail_lines(spark, tmp_path):
    rows = [
        '{"category": "ATTACK", "subject": "s", "body": "b"}',
        '{"category": "safe", "subject": null}',
        "# comment", "   ",
        '{"category": "other"}', '{"subject": "x"}',
        '{"category": "safe", "subject": 5}', "not json", '{"category": "safe"} x',
    ]
    good, bad = msrc.load_mail_jsonl(spark, write(tmp_path / "m.jsonl", "\n".join(rows)))
    assert sorted((r["category"], r["subject"], r["body"]) for r in good.collect()) == [
        ("attack", "s", "b"), ("safe", "", "")
    ]
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid_category"] * 2 + ["invalid_json"] * 3


def test_tsv(spark, tmp_path):
    good, bad = msrc.load_mail_tsv(spark, write(tmp_path / "m.tsv", "a\tb\tc\r\nno tab\n\n\tonly body\n"))
    assert sorted((r["subject"], r["body"]) for r in good.collect()) == [("", "only body"), ("a", "b\tc")]
    assert [r["reason"] for r in bad.collect()] == ["no_tab"]


def test_whole_file_mail(spark, tmp_path):
    write(tmp_path / "one.eml", "First line\nsecond\nthird")
    write(tmp_path / "two.eml", "Only line")
    assert msrc.load_raw_mail(spark, str(tmp_path)).count() == 2
    plain = {(r["subject"], r["body"]) for r in msrc.load_plain_mail(spark, str(tmp_path)).collect()}
    assert plain == {("First line", "second\nthird"), ("Only line", "")}


def test_subject_metadata_is_json_and_capped(spark):
    subjects = ['say "hi"\\\n\t\r', "é" * 2000]
    df = spark.createDataFrame([(s,) for s in subjects], "subject string")
    a, b = [r["m"] for r in df.select(msrc.subject_metadata(F.col("subject")).alias("m")).collect()]
    assert json.loads(a) == {"subject": subjects[0]}
    assert json.loads(b) == {"subject": subjects[1]}


def vectors(spark, n, start=1):
    return spark.range(start, start + n).select(
        F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")
    )


def test_append_ids_are_dense_and_repeatable(spark):
    table = vectors(spark, 5)
    incoming = spark.range(1000, 3000).select(
        (F.col("id") * 7 - 3).alias("line"), F.array(F.lit(0.5).cast("float")).alias("embedding")
    )
    for n in (1, 6):
        ids = tb.append_ids(table, incoming.repartition(n).select("line", "embedding"), "line").select("vec_id")
        assert sorted(r[0] for r in ids.collect()) == list(range(1, 2006))
    ranked = tb.dense_rank_ids(incoming.repartition(5), "line", F.lit(6), "new")
    numbered = ranked.select("line", "new").collect()
    assert len(numbered) == 2000
    assert all(r["line"] == (r["new"] - 6 + 1000) * 7 - 3 for r in numbered)
    assert tb.append_ids(table, incoming.where("line < 0"), "line").count() == 5


def test_ids_of_equal_rows_and_ties(spark):
    rows = spark.range(3000).select(F.lit(7).alias("line"), (F.col("id") % 3).alias("x"))
    for n in (1, 5):
        got = tb.dense_rank_ids(rows.repartition(n), "line", F.lit(1), "new").collect()
        assert sorted(r["new"] for r in got) == list(range(1, 3001))
    runs = [x for x, _ in __import__("itertools").groupby(r["x"] for r in sorted(got, key=lambda r: r["new"]))]
    assert len(runs) == 3  # ties go by the other columns
    assert tb.dense_rank_ids(rows.limit(0), "line", F.lit(1), "new").count() == 0


def test_repeated_keys_and_long_metadata(spark):
    note = "n" * 3000
    lines = spark.createDataFrame(
        [
            ('{"vector":[1,2],"vector":[3,4],"metadata":{"a":1}}',),
            ('{"vector":[5,6],"metadata":{"a":1,"a":2}}',),
            (json.dumps({"vector": [7, 8], "metadata": {"note": note}}, separators=(",", ":")),),
            ('{"vector":[1,2]} {}',),
        ],
        "line string",
    )
    good, bad = vsrc.split_rejects(vsrc.tag_vector_lines(lines, 2))
    got = {tuple(r["embedding"]): r["metadata"] for r in good.collect()}
    assert got[(1.0, 2.0)] == '{"a":1}' and "a" in json.loads(got[(5.0, 6.0)])
    assert json.loads(got[(7.0, 8.0)]) == {"note": note} and bad.count() == 1
    again, _ = vsrc.split_rejects(
        vsrc.tag_vector_lines(vsrc.export_lines(good.withColumn("vec_id", F.lit(1)), metadata="metadata").select("line"), 2)
    )
    assert sorted(r["metadata"] for r in again.collect()) == sorted(got.values())
    mails = spark.createDataFrame(
        [('{"Category":"SPAM","subject":"a","Subject":"b","body":null}',), ('{"category":"safe","category":5}',)], "line string"
    )
    rows, rejected = msrc.split_rejects(msrc.tag_mail_lines(mails))
    assert [tuple(r) for r in rows.select("category", "subject", "body").collect()] == [("spam", "b", "")]
    assert [r["reason"] for r in rejected.collect()] == ["invalid_json"]


def test_upsert_last_write_wins(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    changes = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2), ("c", 7.0, 3), ("c", None, 4)],
                                    "id string, v double, seq long")
    got = {r["id"]: r["v"] for r in tb.upsert_latest(t, changes, "id", "seq").collect()}
    assert got == {"a": 1.0, "b": 6.0, "c": None}


def test_delete_lookup_stats(spark):
    t = vectors(spark, 5)
    ids = spark.createDataFrame([(2,), (2,), (99,)], "vec_id long")
    left, missing = tb.delete_by_id(t, ids)
    assert sorted(r[0] for r in tb.list_ids(left).collect()) == [1, 3, 4, 5]
    assert [r["vec_id"] for r in missing.collect()] == [99]
    assert tb.get_by_id(left, 2).count() == 0 and tb.get_by_id(left, 3).count() == 1
    flagged = t.withColumns({"active": F.col("vec_id") > 2, "category": F.lit("x")})
    assert tb.active_rows(flagged).count() == 3
    s = tb.category_stats(flagged, active=F.col("active")).first()
    assert (s["total_rows"], s["active_rows"], s["max_dim"]) == (5, 3, 1)
    good, bad = tb.validate_dim(t.unionByName(t.limit(1).withColumn("embedding", F.lit(None).cast("array<float>"))), 1)
    assert good.count() == 5 and bad.count() == 1


def labelled(spark):
    rows = [
        (1, "safe", "Lunch", "see you at noon with the whole team"),
        (2, "safe", "Minutes", "the meeting notes are in the folder"),
        (3, "spam", "Winner", "free prize lottery winner congratulations"),
        (4, "spam", "Offer", "cheap discount offer buy now limited deal"),
        (5, "attack", "Urgent", "verify your password immediately account locked"),
        (6, "attack", "Wire", "urgent wire transfer needed confirm bank account"),
    ]
    return spark.createDataFrame(rows, "mail_id long, category string, subject string, body string")


def test_corpus_append_and_replace(spark, tmp_path):
    path = f"{tmp_path}/corpus"
    rows = C.train_corpus(labelled(spark))
    corpus_io.write_corpus(rows, path)
    corpus_io.write_corpus(rows.where("category = 'spam'"), path)
    assert corpus_io.read_corpus(spark, path).count() == 8
    corpus_io.write_corpus(rows.where("vec_id = 3"), path, mode="replace")
    left = {(r["category"], r["vec_id"]) for r in corpus_io.read_corpus(spark, path).collect()}
    assert left == {("safe", 1), ("safe", 2), ("spam", 3), ("attack", 5), ("attack", 6)}
    with pytest.raises(Exception, match="unknown category"):
        corpus_io.write_corpus(rows.withColumn("category", F.lit("other")), path)
    with pytest.raises(ValueError):
        corpus_io.write_corpus(rows, path, mode="other")


def cases(spark):
    return spark.createDataFrame(
        [
            (10, "attack", "Password", "confirm your password, account locked, urgent"),
            (11, "spam", "Prize", "you are a lottery winner, free prize"),
            (12, "safe", "Team lunch", "the whole team meets at noon"),
        ],
        "mail_id long, expected string, subject string, body string",
    )


def test_classify_and_evaluate(spark):
    corpus = C.train_corpus(labelled(spark))
    results = []
    for kw in ({}, {"broadcast_bytes": 0}):
        out = C.Classifier(corpus, **kw).classify_text(cases(spark))
        results.append({r["mail_id"]: (r["category"], round(r["confidence"], 9), r["subtype"], r["counts"]) for r in
                        out.collect()})
    assert results[0] == results[1]
    assert {k: v[0] for k, v in results[0].items()} == {10: "attack", 11: "spam", 12: "safe"}
    assert results[0][10][2] == "CREDENTIAL_HARVEST" and results[0][12][2] is None
    detail = C.evaluate(out, cases(spark))
    s = C.evaluation_summary(detail).first()
    assert (s["total"], s["correct"], s["skipped"], s["accuracy"]) == (3, 3, 0, 100.0)
    assert C.evaluation_misses(detail).count() == 0
    share = {r["category"]: round(r["percent"], 3) for r in C.category_summary(out).collect()}
    assert share == {"attack": 33.333, "spam": 33.333, "safe": 33.333}


def test_missing_and_empty_categories(spark):
    corpus = C.train_corpus(labelled(spark))
    some = C.Classifier(corpus.where("category = 'spam'")).classify_text(cases(spark)).collect()
    assert {(r["category"], r["confidence"]) for r in some} == {("spam", 0.0)}
    assert all(r["scores"][0] is None and r["counts"] == [0, 2, 0] for r in some)
    for kw in ({}, {"broadcast_bytes": -8 * 256}):
        none = C.Classifier(corpus.where("vec_id < 0"), **kw).classify_text(cases(spark))
        assert {(r["category"], r["confidence"]) for r in none.collect()} == {("UNKNOWN", 0.0)}
    s = C.evaluation_summary(C.evaluate(none, cases(spark))).first()
    assert (s["total"], s["correct"], s["skipped"], s["accuracy"]) == (0, 0, 3, 0.0)


def test_classify_with_index(spark):
    from mailvane.operators import ann

    corpus = C.train_corpus(labelled(spark))
    index = ann.class_mean_index(corpus, "category")
    out = C.Classifier(corpus, index=index, n_probe=3).classify_text(cases(spark))
    exact = C.Classifier(corpus).classify_text(cases(spark))
    pick = lambda df: {(r["mail_id"], r["category"], round(r["confidence"], 9)) for r in df.collect()}
    assert pick(out) == pick(exact)
    for bad in ({"method": "ann"}, {"method": "other"}, {"method": "exact", "index": index}):
        with pytest.raises(ValueError):
            C.Classifier(corpus, **bad)
