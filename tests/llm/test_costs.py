"""What operators shuffle and compute, where a limit depends on it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailvane.llm import quality, repeats


def test_quality_cuts_a_word_once_for_all_its_places(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 9) for i in range(20)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    plan = quality.ratio_model(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    counted = plan.index("Aggregate [_word")
    assert plan.index("substring") < counted < plan.rindex("Generate explode(_words")  # cut above the count, in a plan read upwards


def test_repeats_sends_texts_well_compressed():
    r = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + x) for x in r.integers(0, 26, r.integers(2, 10))) for _ in range(2000)]
    text = " ".join(vocabulary[i] for i in np.minimum(r.zipf(1.3, 40_000), 2000) - 1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int64()), pa.array([1], pa.int64()), pa.array([0], pa.int64()), pa.array([text])], names=["block", "doc_id", "mark", "text"]
    )
    sent = next(repeats._texts_by_block(iter([batch])))["texts"][0].as_py()
    assert pa.decompress(sent, len(text), codec="zstd", asbytes=True) == text.encode()
    assert len(sent) < len(pa.compress(text.encode(), codec="zstd", asbytes=True))
