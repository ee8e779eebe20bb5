"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run twice into a no-op sink, planning included; the second time counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mailvane.plans import QUERIES
from mailvane.session import local_session

HEADLINE = [
    "knn_join_cosine",
    "knn_per_category",
    "knn_join_blocks",
    "knn_ann",
    "class_distance_matrix",
    "load_vectors_jsonl",
    "append_ids",
    "vectorize_basic",
    "vectorize_enhanced",
    "vectorize_mails",
    "hash_collisions",
    "parse_mail",
    "extract_urls",
    "typosquat",
    "risk_score",
    "classify_basic",
    "classify_raw",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        first, second = run(spark, name, sf_dir), run(spark, name, sf_dir)
        times[name] = round(second, 3)
        print(f"{name:24s} {first:7.2f} {second:7.2f}", file=sys.stderr, flush=True)
    recall = QUERIES["ann_recall"](spark, sf_dir).first()["recall"] if not sys.argv[1:] else None
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "ann_recall": recall,
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
