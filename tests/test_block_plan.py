"""Searches that hold little, whatever the number of rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailvane.functions import hashing
from mailvane.operators import ann, kernels, knn, lsh
from mailvane.operators.kernels import Block, Nearest


def rows(spark, n, dim=6, seed=3):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(n, dim)), 1)  # ties
    v[n // 2 : n // 2 + 9] = v[0]
    return spark.createDataFrame([(i, [float(x) for x in v[i]], str(i % 3)) for i in range(n)], "vec_id long, embedding array<double>, label string")


def found(df):
    return sorted((r["qid"], r["category"] or "", r["rank"], r["vec_id"], round(r["distance"], 9)) for r in df.collect())


def test_queries_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    e = rows(spark, 80)
    q = e.withColumnRenamed("vec_id", "qid")
    expected = found(knn.knn_join(q, e, 3, category="label", plan="queries"))
    monkeypatch.setattr(knn, "_query_broadcast", None)
    assert found(knn.knn_join(q, e, 3, category="label", plan="queries", broadcast_bytes=1024)) == expected


def test_all_cells_probed_sends_a_query_once(spark):
    e = rows(spark, 90)
    q = e.withColumnRenamed("vec_id", "qid")
    searched = ann.search(ann.class_mean_index(e, "label"), q, e, 5, n_probe=3)
    assert "cells(" not in searched._jdf.queryExecution().toString()  # not once for every cell
    assert found(searched) == found(knn.knn_join(q, e, 5, plan="corpus"))


def test_nearest_keeps_what_no_later_block_improves():
    near = Nearest(np.array([[1.0, 0.0]]), 1)
    for at, v in enumerate(([[1.0, 0.0]], [[0.0, 1.0]], [[1.0, 0.0]])):
        near.meet(Block(pa.array([7 - at]), np.array(v), None, "euclidean", 1))
    assert [ids.to_pylist() for _, _, ids, _ in near.batches()] == [[5]]  # of equal rows the smallest id


def test_nearest_of_blocks_in_turn():
    r = np.random.default_rng(5)
    v, q = np.round(r.normal(size=(200, 8)), 1), r.normal(size=(7, 8))
    names = pa.array([None if i % 5 == 0 else str(i % 3) for i in range(200)])
    near = Nearest(q, 3)
    for at in range(0, 200, 23):
        near.meet(Block(pa.array(np.arange(200)[at : at + 23]), v[at : at + 23], names[at : at + 23], "cosine", 3))
    whole = Block(pa.array(np.arange(200)), v, names, "cosine", 3)
    a, c, d, _ = whole.search(q)
    expected = {(int(x), [None, *whole.names][whole.code[y] + 1], whole.ids[int(y)].as_py()) for x, y in zip(a, c)}
    assert {(int(x), n.as_py(), i.as_py()) for rs, ns, ids, _ in near.batches(10) for x, n, i in zip(rs, ns, ids)} == expected


def test_hashing_works_on_slices_of_bytes(spark, monkeypatch):
    lists = pa.array([["ab", "c"], None, [], ["x" * 50], ["d"]], pa.list_(pa.string()))
    assert hashing.token_bytes(lists).tolist() == [19, 0, 0, 58, 9]
    assert hashing.row_slices(np.array([19, 0, 0, 58, 9]), 2, 30) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert hashing.row_slices(np.zeros(0, dtype=int), 2, 30) == []
    words = spark.range(40).select("id", F.sequence(F.lit(1), F.col("id") + 1).cast("array<string>").alias("w"))
    vectors = lambda: [r["v"] for r in words.orderBy("id").select(hashing.hash_vectors([(F.col("w"), 1.0)], 16, bigrams=0.5, trigrams=0.2).alias("v")).collect()]
    once = vectors()
    monkeypatch.setattr(hashing, "SLICE_BYTES", 40)
    assert vectors() == once


def test_hash_bucket_is_searched_by_products(monkeypatch):
    measured, plain = [], kernels.pair_distance
    monkeypatch.setattr(kernels, "pair_distance", lambda a, b, metric: measured.append(len(a)) or plain(a, b, metric))
    r = np.random.default_rng(2)
    q, v, n, m = r.normal(size=(300, 8)), r.normal(size=(700, 8)), 300, 700
    vectors = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    zeros = lambda k: pa.array(np.zeros(k, dtype=np.int64))
    left = pa.table({"qrow": np.arange(n), "qid": np.arange(n) + 5, "qv": vectors(q), "tab": zeros(n), "code": zeros(n)})
    ids = r.permutation(m)
    right = pa.table({"row": np.arange(m), "id": ids, "v": vectors(v), "tab": zeros(m), "code": zeros(m)})
    got = lsh._compare(4)(left, right)
    # not every pair is taken apart: of a whole bucket only candidates are
    assert 0 < sum(measured) < 10 * n
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    nearest = np.argsort(1 - unit(q) @ unit(v).T, axis=1)[:, :4]
    assert {(x, y) for x, y in zip(got["qrow"].to_pylist(), got["row"].to_pylist())} == {(i, j) for i in range(n) for j in nearest[i].tolist()}
    assert all(ids[row] == vec_id for row, vec_id in zip(got["row"].to_pylist(), got["vec_id"].to_pylist()))


def test_what_two_large_sides_send_grows_with_them():
    sent = lambda q, c: (lambda parts: q * parts[1] + c * parts[0])(knn.grid(q, c, 64, 12))
    assert sent(600_000, 400_000) <= 10 * 1.01 * sent(60_000, 40_000)
    # not one copy of a side for every block of the other
    assert sent(600_000, 400_000) < (600_000 * (400_000 // knn.BLOCK_ROWS) + 400_000 * (600_000 // knn.BLOCK_ROWS)) / 3


def test_what_two_large_sides_send_grows_no_faster_than_they_do():
    sent = lambda q, c: (lambda parts: q * parts[1] + c * parts[0])(knn.grid(q, c, 256, 12))
    assert sent(1_840_000, 1_230_000) <= 6 * 1.1 * sent(307_000, 205_000)  # 6 and 1 GB of classify_basic


def test_queries_of_a_part_are_opened_in_turn(spark, monkeypatch):
    opened, plain = [], knn.Nearest
    monkeypatch.setattr(knn, "Nearest", lambda q, k: opened.append(len(q)) or plain(q, k))
    e = rows(spark, 90).toArrow()
    vectors = pa.table({"qrow": e["vec_id"], "qid": e["vec_id"], "qv": e["embedding"]}), pa.table({"id": e["vec_id"], "v": e["embedding"], "c": e["label"]})

    def blocks(t, n):
        values = []
        for at in range(0, len(t), n):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t.slice(at, n))
            values.append(sink.getvalue().to_pybytes())
        return pa.table({"rows": pa.array(values, pa.binary())})

    schema = pa.schema([("qrow", pa.int64()), ("qid", pa.int64()), ("category", pa.string()), ("vec_id", pa.int64()), ("distance", pa.float64()), ("dkey", pa.int64())])
    got = knn._meet_parts(3, "cosine", schema, 16, 40)(*[blocks(t, 10) for t in vectors])
    assert opened == [40, 40, 10]
    whole = knn.meet_blocks(3, "cosine")(*vectors)
    key = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("qrow", "category", "vec_id", "dkey"))))
    assert key(got) == key(whole)


@pytest.mark.parametrize("n", [(1, 1), (5, 90_000), (90_000, 5), (2_000_000, 1_300_000)])
def test_parts_of_both_sides_are_bounded(n):
    q_parts, c_parts = knn.grid(*n, 256, 12)
    assert n[0] * 2048 / q_parts <= knn.HELD_BYTES and n[1] * 2048 / c_parts <= knn.SENT_BYTES
    assert q_parts * c_parts >= min(48, -(-n[0] // knn.SMALL_ROWS) * -(-n[1] // knn.SMALL_ROWS))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_parts_of_both_sides_give_the_rows_of_the_broadcast(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "SMALL_ROWS", 30)  # many parts
    monkeypatch.setattr(knn, "HELD_BYTES", 60 * 64)
    e = rows(spark, 170)
    q = e.withColumnRenamed("vec_id", "qid").unionByName(e.withColumnRenamed("vec_id", "qid").limit(9))
    with_category = dict(k=4, metric=metric, category="label", leave_out_own=True)
    blocks = knn.knn_join(q, e, plan="blocks", block_rows=16, **with_category)
    assert found(blocks) == found(knn.knn_join(q, e, plan="corpus", **with_category))
    assert found(knn.knn_join(q, e.where("false"), plan="blocks", dim=8)) == []


def test_search_in_slices_of_any_size(monkeypatch):
    r = np.random.default_rng(9)
    v, q = np.round(r.normal(size=(150, 8)), 1), r.normal(size=(40, 8))
    block = Block(pa.array(np.arange(150)), v, pa.array([None if i % 4 == 0 else "abc"[i % 3] for i in range(150)]), "cosine", 3)
    whole = block.search(q)
    monkeypatch.setattr(kernels, "_BLOCK_CELLS", 150 * 7)
    assert all((a == b).all() for a, b in zip(whole, block.search(q)))


def near_rows(n, dim=64, seed=4):
    """Vectors around a few directions, some of them copies, one without length."""
    centres, r = np.random.default_rng(1).normal(size=(6, dim)), np.random.default_rng(seed)
    v = centres[r.integers(0, 6, n)] + 0.2 * r.normal(size=(n, dim))
    v[n // 2 : n // 2 + 9], v[7] = v[0], 0.0
    return v


@pytest.mark.parametrize("n", [2100, 2600])
def test_tiles_out_of_reach_are_skipped(monkeypatch, n):
    v, q = near_rows(n), near_rows(700, seed=5)
    names = pa.array([None if i % 7 == 0 else "rare" if i in (30, 31) else "ab"[i % 2] for i in range(n)])

    def nearest(tiles):
        near = Nearest(q, 4)
        near.tiles = tiles
        for at in range(0, n, 1300):
            near.meet(Block(pa.array(np.arange(n)[::-1][at : at + 1300]), v[at : at + 1300], names[at : at + 1300], "cosine", 4))
        assert near.tiles == tiles
        return sorted((int(r), c.as_py() or "", i.as_py(), d) for rs, cs, ids, ds in near.batches() for r, c, i, d in zip(rs, cs, ids, ds))

    whole = nearest(False)
    measured, plain = [], kernels._tiles
    monkeypatch.setattr(kernels, "_tiles", lambda *a: measured.append(1) or plain(*a))
    monkeypatch.setattr(kernels, "TILE_ROWS", 32)
    assert nearest(True) == whole and len(measured) > 1  # of the queries, and of a block


def test_vectors_without_structure_go_without_tiles():
    r = np.random.default_rng(6)
    near = Nearest(r.normal(size=(300, 64)), 4)
    for at in (0, 2000):
        near.meet(Block(pa.array(np.arange(2000) + at), r.normal(size=(2000, 64)), None, "cosine", 4))
    assert not near.tiles


def test_places_are_no_farther_apart_than_vectors():
    v = near_rows(300)
    tiled = kernels.Tiled(v)
    x, u = kernels.places(kernels._unit(v), tiled.basis).astype(np.float64), kernels._unit(v)
    u[7], x[7] = u[0], x[0]  # of a vector without length all distances are 1
    apart = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    assert (apart(x) <= apart(u) + 1e-6).all()
    assert sorted(tiled.order.tolist()) == list(range(300))


def test_keys_sort_as_one_number_or_several():
    r = np.random.default_rng(7)
    for spread in (5, 1 << 40):
        a, b, c = r.integers(0, 9, 500), r.integers(-spread, spread, 500), r.permutation(500) * (spread >> 2)
        assert kernels._sorted(a, b, c).tolist() == np.lexsort((c, b, a)).tolist()
    assert kernels._sorted(a[:0], b[:0], c[:0]).tolist() == []


def test_copies_beyond_k_are_left_out():
    v = np.repeat(np.arange(12.0).reshape(6, 2), [1, 5, 2, 1, 7, 1], axis=0)
    code = np.r_[np.zeros(10, int), np.ones(7, int)]
    assert kernels._first_copies(v, code, 2).tolist() == [0, 1, 2, 6, 7, 8, 9, 10, 11, 16]


def test_what_queries_find_is_bounded():
    found = lambda n, parts: n * 60 / parts[0]
    assert found(720_000, knn.grid(720_000, 720_000, 64, 12, 60)) <= knn.MOST_FOUND
    returned = lambda parts: 720_000 * parts[1]
    assert returned(knn.grid(720_000, 720_000, 64, 12, 60)) < returned(knn.grid(720_000, 720_000, 64, 12)) / 2


def test_queries_open_by_what_they_find(spark, monkeypatch):
    e = rows(spark, 120)
    q = e.withColumnRenamed("vec_id", "qid")
    expected = found(knn.knn_join(q, e, 3, category="label", plan="queries"))
    monkeypatch.setattr(knn, "_query_broadcast", None)
    monkeypatch.setattr(knn, "MOST_BROADCAST_FOUND", 3 * 3 * 119)  # one query too many
    monkeypatch.setattr(knn, "MOST_FOUND", 3 * 3 * 50)
    monkeypatch.setattr(knn, "OPEN_FOUND", 3 * 3 * 10)
    monkeypatch.setattr(knn, "SMALL_ROWS", 10)
    held = []
    plain = knn._meet_parts
    monkeypatch.setattr(knn, "_meet_parts", lambda *a: held.append(a[-1]) or plain(*a))
    assert knn.sizes_of(e.select(e["label"].alias("c")), 3) == (120, 9)
    assert found(knn.knn_join(q, e, 3, category="label", plan="queries")) == expected
    assert held == [10]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_many_cells_are_probed_without_a_copy_for_each(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "SMALL_ROWS", 100)
    e = rows(spark, 300)
    q = e.withColumnRenamed("vec_id", "qid")
    index = ann.build_index(e, 24, metric=metric)
    sent = []
    plain = ann.all_pairs
    monkeypatch.setattr(ann, "all_pairs", lambda q, *a, **b: sent.append(q.columns) or plain(q, *a, **b))
    nearest = lambda p: [r["c"] for r in e.select(ann.nearest_cells(index, e["embedding"], p).alias("c")).collect()]
    assert nearest(1) == [c[:1] for c in nearest(24)]
    for n_probe in (8, 15):
        many = found(ann.search(index, q, e, 4, n_probe=n_probe, category="label", leave_out_own=True))
        assert sent.pop() == ["qrow", "qid", "qv", "probes"]  # no row for a cell
        with monkeypatch.context() as m:
            m.setattr(ann, "LEAST_SHARE", 0)
            assert found(ann.search(index, q, e, 4, n_probe=n_probe, category="label", leave_out_own=True)) == many
    few = ann.search(index, q, e, 4, n_probe=2)
    assert not sent and few.count() == 1200
