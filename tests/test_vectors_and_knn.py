import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailvane.functions import vectors as M
from mailvane.operators import ann, classdist, knn, vote
from mailvane.operators.kernels import Block, matrix, pair_distance, sort_key

METRICS = ("cosine", "euclidean", "dot")


def table(spark, vectors, labels=None):
    labels = labels or ["x"] * len(vectors)
    return spark.createDataFrame(
        [(i, [float(x) for x in v], c) for i, (v, c) in enumerate(zip(vectors, labels))],
        "vec_id long, embedding array<float>, label string",
    )


def brute(queries, corpus, labels, k, metric):
    out = set()
    q32, c32 = np.float32(queries).astype(float), np.float32(corpus).astype(float)
    for i, q in enumerate(q32):
        d = pair_distance(np.broadcast_to(q, c32.shape), c32, metric)
        for lab in set(labels):
            own = [j for j in range(len(c32)) if labels[j] == lab]
            for rank, j in enumerate(sorted(own, key=lambda j: (sort_key(d[j : j + 1])[0], j))[:k], 1):
                out.add((i, lab, j, round(float(d[j]), 9), rank))
    return out


def found(df):
    return {(r["qid"], r["category"], r["vec_id"], round(r["distance"], 9), r["rank"]) for r in df.collect()}


def test_metric_names():
    assert [M.metric_name(n) for n in ("cos", "cosine", "euc", "l2", "dot", "other", None)] == [
        "cosine", "cosine", "euclidean", "euclidean", "dot", "cosine", "cosine"
    ]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            M.check_dim(bad)


def test_distances_on_edge_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        M.cosine_distance(a, b).alias("c"), M.cosine_similarity(a, b).alias("s"), M.euclidean_distance(a, b).alias("e"),
        M.negative_dot(a, b).alias("d"), M.normalize(b).alias("n"), M.distance("l2")(a, b).alias("e2"),
    ).collect()
    assert [r["c"] for r in got] == [1.0, 0.0, 2.0, 1.0]
    assert [r["s"] for r in got] == [0.0, 1.0, -1.0, 0.0]
    assert [round(r["e"], 6) for r in got] == [1.414214, 1.0, 2.0, 1.0]
    assert [r["e2"] for r in got] == [r["e"] for r in got]
    assert [r["d"] for r in got] == [0.0, -2.0, 1.0, 0.0]
    assert got[1]["n"] == [1.0, 0.0]
    assert df.select(M.normalize(a).alias("n")).collect()[3]["n"] == [0.0, 0.0]


def test_vector_text_forms(spark):
    df = spark.createDataFrame([("1.5, 2,x,3",), ("",), ("1e3,-2",)], "t string")
    assert [r["v"] for r in df.select(M.parse_vector(F.col("t")).alias("v")).collect()] == [
        [1.5, 2.0], [], [1000.0, -2.0]
    ]
    v = spark.createDataFrame([([0.5, -1.0],)], "v array<float>")
    assert v.select(M.format_vector(F.col("v")).alias("t")).first()["t"] == "0.500000,-1.000000"


@pytest.mark.parametrize("metric", METRICS)
def test_all_plans_equal_brute_force(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(90, 8))
    corpus[30:60] = corpus[7]  # a third of the rows are copies
    corpus[61] = 0
    corpus[70] = 2 * corpus[71]
    labels = ["abc"[i % 3] if i < 80 else "a" for i in range(90)]
    queries = np.vstack([corpus[::9], rng.normal(size=(3, 8))])
    c, q = table(spark, corpus, labels), table(spark, queries).withColumnRenamed("vec_id", "qid")
    want = brute(queries, corpus, labels, 4, metric)
    run = lambda **kw: found(knn.knn_join(q, c, 4, metric=metric, category="label", **kw))
    assert run() == want
    assert run(broadcast_bytes=0, block_rows=16) == want
    sizes = iter([False, True])
    monkeypatch.setattr(knn, "fits_broadcast", lambda *a: next(sizes))
    assert run() == want


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(60, 4)) + 0.0  # many ties
    c = table(spark, v)
    q = c.withColumnRenamed("vec_id", "qid")
    want = brute(v, v, ["x"] * 60, 3, "euclidean")
    for n in (1, 5):
        got = knn.knn_join(q.repartition(n), c.repartition(7 - n), 3, metric="euclidean", broadcast_bytes=0, block_rows=9)
        assert {x[:1] + x[2:] for x in found(got)} == {x[:1] + x[2:] for x in want}


def test_k_edges(spark):
    c = table(spark, np.eye(3))
    q = c.withColumnRenamed("vec_id", "qid")
    assert knn.knn_join(q, c, 10).count() == 9  # fewer rows than k
    many = table(spark, np.random.default_rng(1).normal(size=(25, 3)))
    assert knn.knn_join(q, many, 0).count() == 30  # k = 0 means 10
    assert knn.knn_single(many, [1, 0, 0]).count() == 10
    assert knn.knn_join(q, c.where("vec_id < 0"), 3).count() == 0
    assert [r["vec_id"] for r in knn.knn_similarity(q.where("qid = 1"), c, 2).orderBy("rank").collect()] == [1, 0]


def test_string_ids(spark):
    c = table(spark, np.eye(3)).select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    q = c.withColumnRenamed("vec_id", "qid")
    for kw in ({}, {"broadcast_bytes": 0, "block_rows": 2}):
        got = knn.knn_join(q, c, 1, **kw).collect()
        assert {(r["qid"], r["vec_id"]) for r in got} == {("v0", "v0"), ("v1", "v1"), ("v2", "v2")}


def test_mixed_dimensions_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        matrix(pa.array([[1.0, 2.0], [1.0]]))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_block_search_property(data):
    import pyarrow as pa

    n, dim = data.draw(st.integers(1, 40)), data.draw(st.integers(1, 4))
    cell = st.integers(-2, 2)
    rows = np.array(data.draw(st.lists(st.lists(cell, min_size=dim, max_size=dim), min_size=n, max_size=n)), float)
    metric, k = data.draw(st.sampled_from(METRICS)), data.draw(st.integers(1, 6))
    block = Block(pa.array(range(n)), rows, None, metric, k)
    r, c, d, rank = block.search(rows[:5])
    got = {(int(a), int(block.ids[int(b)].as_py()), int(e)) for a, b, e in zip(r, c, rank)}
    assert got == {(x[0], x[2], x[4]) for x in brute(rows[:5], rows, ["x"] * n, k, metric)}


def test_ann_all_cells_is_exact_and_recall_is_high(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16)) * 4
    v = np.vstack([c + rng.normal(size=(40, 16)) * 0.5 for c in centres])
    c = table(spark, v)
    q = c.where("vec_id < 240").withColumnRenamed("vec_id", "qid")
    for metric in METRICS:
        index = ann.build_index(c, 6, metric=metric)
        assert found(ann.search(index, q, c, 5, n_probe=6)) == found(knn.knn_join(q, c, 5, metric=metric))
    index = ann.build_index(c, 6)
    near = ann.search(index, q, ann.assign(index, c), 5, n_probe=2, block_rows=16)
    assert ann.recall(near, knn.knn_join(q, c, 5)).first()["recall"] > 0.95
    assert (ann.build_index(c, 6).centroids == index.centroids).all()  # seeded


def test_ann_hot_cell_is_split(spark):
    v = np.vstack([np.tile([1.0, 0.1], (50, 1)) + np.arange(50)[:, None] * 1e-3, [[0.0, 1.0]] * 3])
    c = table(spark, v)
    q = c.withColumnRenamed("vec_id", "qid")
    index = ann.CellIndex(np.array([[1.0, 0.0], [0.0, 1.0]]), "euclidean")
    got = ann.search(index, q, c, 3, n_probe=2, block_rows=4)
    assert found(got) == found(knn.knn_join(q, c, 3, metric="euclidean"))


def test_index_round_trip(spark, tmp_path):
    index = ann.CellIndex(np.array([[1.0, 0.5], [0.25, 1.0]]), "dot")
    ann.save_index(spark, index, f"{tmp_path}/ix")
    back = ann.load_index(spark, f"{tmp_path}/ix")
    assert back.metric == "dot" and (back.centroids == index.centroids).all()


def test_class_distances_equal_pair_means(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 5))
    labels = ["a"] * 12 + ["b"] * 7 + ["c"]
    got = {(r["label_a"], r["label_b"]): (r["mean_distance"], r["n_pairs"]) for r in
           classdist.class_distances(table(spark, v, labels)).collect()}
    u = np.float32(v).astype(float)
    for (a, b), (mean, n) in got.items():
        pairs = [(i, j) for i in range(20) for j in range(20)
                 if labels[i] == a and labels[j] == b and (i < j if a == b else True)]
        assert n == len(pairs)
        if pairs:
            d = pair_distance(u[[i for i, _ in pairs]], u[[j for _, j in pairs]], "cosine")
            assert abs(mean - d.mean()) < 1e-9
    assert classdist.discrimination(classdist.class_distances(table(spark, v, labels))).first()["ratio"] > 0


def test_vote_edges(spark):
    scores = spark.createDataFrame(
        [
            ("tie", "spam", 0.4), ("tie", "safe", 0.4), ("tie", "attack", 0.9),
            ("one", "attack", 0.2),
            ("tiny", "safe", 0.00001), ("tiny", "spam", 0.0001),
            ("half", "attack", 0.2), ("half", "safe", 0.4), ("half", "spam", 0.8),
        ],
        "qid string, category string, score double",
    )
    order = ["safe", "spam", "attack"]
    got = {r["qid"]: (r["category"], round(r["confidence"], 6)) for r in vote.vote(scores, order).collect()}
    assert got == {"tie": ("safe", 0.0), "one": ("attack", 0.0), "tiny": ("safe", 0.0), "half": ("attack", 0.5)}
    queries = spark.createDataFrame([("half",), ("none",)], "qid string")
    full = {r["qid"]: r["category"] for r in vote.with_unknown(queries, vote.vote(scores, order)).collect()}
    assert full == {"half": "attack", "none": "UNKNOWN"}


def test_vote_in_place_equals_vote(spark):
    rng = np.random.default_rng(8)
    c = table(spark, rng.normal(size=(30, 4)), ["safe", "spam", "attack"] * 10)
    q = table(spark, rng.normal(size=(7, 4))).withColumnRenamed("vec_id", "qid")
    near = knn.neighbours_udf(c, 5, category="label")
    cols = vote.vote_columns(F.col("n"))
    rows = q.select("qid", near(F.col("embedding")).alias("n")).withColumns({k: cols[k] for k in ("scores", "counts")})
    a = {(r["qid"], r["category"], round(r["confidence"], 9)) for r in
         rows.withColumns({k: cols[k] for k in ("category", "confidence")}).collect()}
    s = vote.category_scores(knn.knn_join(q, c, 5, category="label"))
    b = {(r["qid"], r["category"], round(r["confidence"], 9)) for r in vote.vote(s, ["safe", "spam", "attack"]).collect()}
    assert a == b


def test_plans_agree_over_several_batches(spark):
    """More than three Arrow batches a task, repeated query ids, ties by copies."""
    rows = spark.range(0, 32_000, 1, 1).select(
        F.col("id").alias("vec_id"),
        F.array(*[F.sin(F.col("id") % 9_000 * (i + 1)).cast("float") for i in range(8)]).alias("embedding"),
        (F.col("id") % 3).cast("string").alias("label"),
    )
    queries = rows.where("vec_id % 800 = 0").select((F.col("vec_id") % 4_000).alias("qid"), "embedding")
    order = ["qid", "category", "rank", "vec_id"]
    for category in (None, "label"):
        found = [
            sorted(tuple(r[c] for c in order) for r in knn.knn_join(queries, rows, 4, category=category, plan=plan, block_rows=9_000).collect())
            for plan in ("corpus", "queries", "blocks")
        ]
        assert found[0] == found[1] == found[2]
        assert len(found[0]) == 40 * 4 * (3 if category else 1)


def test_dimension_has_no_upper_bound(spark):
    from mailvane.functions.vectors import check_dim

    assert check_dim(100_000) == 100_000
    with pytest.raises(ValueError):
        check_dim(0)
