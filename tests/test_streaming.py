from pyspark.sql import functions as F

from mailvane.operators import classify as C
from mailvane.plans import stream_queries as S
from mailvane.plans.mails import mails
from mailvane.sources.corpus import read_corpus, write_corpus
from mailvane.sources.vectors import text_lines
from mailvane.streaming.scoring import score_raw_stream
from mailvane.streaming.training import train_stream


def test_stream_scores_equal_batch(spark, sf_dir, tmp_path):
    m = mails(spark, sf_dir)
    corpus = C.train_corpus(m.where("category IS NOT NULL"))
    raw = m.where("category IS NULL").select("mail_id", "raw")
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    pick = ["mail_id", "category", "subtype", "risk_level"]
    want = {tuple(r) for r in C.Classifier(corpus).classify_raw(raw).select(*pick).collect()}
    for name, kw in (("narrow", {}), ("joined", {"broadcast_bytes": 0})):
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        q = score_raw_stream(
            stream, C.Classifier(corpus, **kw), f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", once=True
        )
        q.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").select(*pick).collect()]
        assert len(got) == len(want) and set(got) == want


def test_stream_training_appends_and_numbers(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()

    def run():
        stream = spark.readStream.text(str(folder)).withColumnRenamed("value", "line")
        train_stream(
            stream, f"{tmp_path}/corpus", f"{tmp_path}/outcomes", f"{tmp_path}/checkpoint", once=True
        ).awaitTermination()

    row = '{"category": "%s", "subject": "s%d", "body": "free prize %d"}'
    (folder / "a.jsonl").write_text("\n".join([row % ("spam", i, i) for i in range(5)] + ["broken", "# note"]))
    run()
    (folder / "b.jsonl").write_text("\n".join([row % ("safe", i, i) for i in range(3)] + [row % ("odd", 1, 1)]))
    run()
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    assert sorted(r["vec_id"] for r in corpus.collect()) == list(range(1, 9))
    assert corpus.where("batch LIKE '%-1'").agg(F.min("vec_id")).first()[0] == 6
    assert corpus.where(F.size("embedding") != 256).count() == 0
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/outcomes").groupBy("outcome").sum("n_lines").collect()}
    assert counts == {"loaded": 8, "invalid_json": 1, "invalid_category": 1}
    assert text_lines(spark, str(folder)).count() == 11


def test_scoring_restarted_with_another_plan_loses_nothing(spark, sf_dir, tmp_path):
    m = mails(spark, sf_dir)
    corpus = C.train_corpus(m.where("category IS NOT NULL"))
    raw = m.where("category IS NULL").select("mail_id", "raw")
    raw.limit(5).write.parquet(f"{tmp_path}/in")
    for kw in ({}, {"broadcast_bytes": 0}):
        stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
        score_raw_stream(stream, C.Classifier(corpus, **kw), f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True).awaitTermination()
        if not kw:
            first = spark.read.parquet(f"{tmp_path}/out").drop("batch").schema
            raw.exceptAll(raw.limit(5)).limit(4).write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.drop("batch").schema == first
    assert got.count() == got.select("mail_id").distinct().count() == 9


def test_training_after_rejects_on_an_old_corpus_with_a_new_checkpoint(spark, tmp_path):
    old = C.train_corpus(spark.createDataFrame([(41, "safe", "s", "old mail")], "mail_id long, category string, subject string, body string"))
    write_corpus(old, f"{tmp_path}/corpus")
    folder = tmp_path / "lines"
    folder.mkdir()
    good = '{"category": "spam", "subject": "s", "body": "free prize"}'

    def run(checkpoint):
        stream = spark.readStream.text(str(folder)).withColumnRenamed("value", "line")
        train_stream(stream, f"{tmp_path}/corpus", f"{tmp_path}/outcomes", f"{tmp_path}/{checkpoint}", once=True).awaitTermination()

    (folder / "a.jsonl").write_text("broken\nbroken too\n")
    run("one")
    (folder / "b.jsonl").write_text((good + "\n") * 500)
    run("one")
    run("two")
    ids = sorted(r["vec_id"] for r in read_corpus(spark, f"{tmp_path}/corpus").collect())
    assert ids == [41, *range(42, 542), *range(542, 1042)]


def test_documents_may_be_a_folder_of_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words about item {i}", 24) for i in range(36)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 36, 2)] + [(27, 1, 1)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    scored = S.stream_classify_raw(spark, str(tmp_path)).select("mail_id").collect()
    assert sorted(r["mail_id"] for r in scored) == sorted(set(range(36)) - set(range(0, 36, 2)) - {27})
    trained = S.stream_train(spark, str(tmp_path)).collect()
    assert {r["n_ids"] for r in trained} == {9}  # numbers 0, 8, 10, 16, 18, 26, 27, 28, 34
    assert {r["outcome"]: r["n_lines"] for r in trained}["invalid_json"] == 4  # numbers 6, 14, 24, 32
