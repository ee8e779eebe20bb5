"""Messages written as files of one folder, and read back under their ids."""

import os

from pyspark.sql import functions as F

from mailvane.sources import mail as msrc


def test_a_file_for_each_message(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(msrc, "FILES_A_TASK", 7)  # more tasks than cores
    rows = [(i, f"Subject: {i}\r\n\r\nline\n{'x' * i}") for i in range(90)] + [(5, "again\n"), (None, "no id"), (91, ""), (92, "\n\n")]
    folder = str(tmp_path / "inbox")
    index = msrc.write_raw_mail(spark.createDataFrame(rows, "mail_id long, raw string"), folder)
    names = [n for n in os.listdir(folder) if n.startswith("part-")]
    # no folder for a message: its cost is above that of the file
    assert len(names) == len(rows) and all(os.path.isfile(f"{folder}/{n}") for n in names)
    read = msrc.named_raw_mail(msrc.load_raw_mail(spark, folder), index)
    found = [(r["mail_id"], r["raw"]) for r in read.select("mail_id", F.col("raw")).collect()]
    assert sorted(found, key=str) == sorted(rows, key=str)


def test_local_files_are_written_without_a_process_for_each(spark, tmp_path, monkeypatch):
    rows = [(i, f"Subject: {i}\n\ntext é") for i in range(9)] + [(9, None), (9, "twice")]
    mails = spark.createDataFrame(rows, "mail_id long, raw string")
    read = lambda folder, index: sorted((r["mail_id"], r["raw"]) for r in msrc.named_raw_mail(msrc.load_raw_mail(spark, folder), index).collect())
    folder = f"file://{tmp_path}/inbox"
    direct = read(folder, msrc.write_raw_mail(mails, folder))
    names = os.listdir(tmp_path / "inbox")
    # Hadoop's writer adds a checksum to each, and sets the mode of both by a process
    assert len(names) == len(rows) and all(n.startswith("part-") for n in names)
    monkeypatch.setattr(msrc, "local_folder", lambda *_: None)  # as in any other store
    other = str(tmp_path / "other")
    assert read(other, msrc.write_raw_mail(mails, other)) == direct
