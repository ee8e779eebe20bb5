"""Centroid tree and sign codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailvane.operators import knn, lsh, tree
from mailvane.operators.ann import recall
from mailvane.operators.kernels import pair_distance
from mailvane.sources.tables import written

SCHEMA = "vec_id long, label string, embedding array<double>"


def clusters(n, dim, centres, noise, seed=3):
    """Rows near a few centres; some copies, some without direction."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, dim))
    v = middle[rng.integers(0, centres, n)] + rng.normal(0, noise, (n, dim))
    v[5::40] = v[4]
    v[7::90] = 0.0
    return [(i, "abc"[i % 3] if i % 11 else None, [float(x) for x in r]) for i, r in enumerate(v)]


@pytest.fixture(scope="module")
def corpus(spark):
    return written(spark.createDataFrame(clusters(500, 6, 12, 0.1), SCHEMA).repartition(3))


def asked(df):
    return df.select(F.col("vec_id").alias("qid"), "embedding")


def rows_of(df):
    return {(r["qid"], r["category"], r["rank"]): (r["vec_id"], round(r["distance"], 8)) for r in df.collect()}


@pytest.mark.parametrize("category", [None, "label"])
def test_a_vector_is_sent_once_for_each_group_it_visits(corpus, monkeypatch, category):
    monkeypatch.setattr(tree, "VISITORS", 25)  # several parts of visitors
    sent, plain = [], tree._to_groups
    monkeypatch.setattr(tree, "_to_groups", lambda *a, **kw: sent.append(plain(*a, **kw)) or sent[-1])
    monkeypatch.setattr(tree, "_search", None)  # would send it for each cell
    t = tree.build_tree(corpus, 60, category=category, block_rows=20)
    found, _ = tree.tree_search(t, asked(corpus), 4, block_rows=20)
    assert rows_of(found) == rows_of(knn.knn_join(asked(corpus), corpus, 4, category=category))
    n_states = corpus.count() * t.groups.select("category").distinct().count()
    sums = [r.agg(F.sum("n")).first()[0] for r in sent if r.columns == ["group", "n"]]
    assert sums[0] == n_states and n_states <= sums[1] <= corpus.count() * t.groups.count()


@pytest.mark.parametrize(
    "metric, category, schedule",
    [("cosine", None, (None,)), ("euclidean", "label", (None,)), ("dot", None, (1, 3, None)), ("cosine", "label", (2, None))],
)
def test_pruned_search_is_exact(corpus, metric, category, schedule):
    t = tree.build_tree(corpus, 40, metric=metric, category=category, block_rows=20)
    found, visits = tree.tree_search(t, asked(corpus), 4, schedule=schedule, block_rows=20)
    exact = knn.knn_join(asked(corpus), corpus, 4, metric=metric, category=category, plan="blocks")
    assert rows_of(found) == rows_of(exact)
    seen = visits.agg(F.min("closed"), F.sum("rows_compared"), F.count(F.lit(1))).first()
    assert seen[0] and seen[2] == 500 * (4 if category else 1)
    if schedule == (None,) and not category:
        assert seen[1] < 0.5 * 500 * 500


def test_every_row_has_one_cell_within_its_radius(corpus):
    t = tree.build_tree(corpus, 40, metric="euclidean", category="label")
    assert t.rows.count() == 500 and t.rows.select("id").distinct().count() == 500
    cells = {r["cell"]: r for r in t.cells.collect()}
    for r in t.rows.collect():
        cell = cells[r["cell"]]
        assert (cell["category"], cell["group"]) == (r["c"], r["group"])
        assert np.linalg.norm(np.array(r["v"]) - np.array(cell["centre"])) <= cell["radius"] + 1e-6
    assert sum(c["n_rows"] for c in cells.values()) == 500


def test_what_has_closed_is_exact(corpus):
    """Few cells allowed: queries whose bound has closed have the exact result, the others most of it."""
    t = tree.build_tree(corpus, 60)
    found, visits = tree.tree_search(t, asked(corpus), 4, schedule=(2,))
    closed = {r["qid"]: r["closed"] for r in visits.collect()}
    assert set(closed) == set(range(500)) and 0 < sum(closed.values()) < 500
    got, exact = rows_of(found), rows_of(knn.knn_join(asked(corpus), corpus, 4))
    assert all(got.get(key) == value for key, value in exact.items() if closed[key[0]])
    assert visits.agg(F.max("cells_visited")).first()[0] <= 2


def test_tree_is_a_table(spark, corpus, tmp_path):
    t = tree.build_tree(corpus, 30, metric="euclidean")
    t.save(str(tmp_path / "tree"))
    again = tree.CentroidTree.load(spark, str(tmp_path / "tree"))
    assert again.metric == "euclidean"
    few = asked(corpus.where("vec_id < 20"))
    assert rows_of(tree.tree_search(again, few, 3)[0]) == rows_of(knn.knn_join(few, corpus, 3, metric="euclidean"))


def test_a_hundred_thousand_cells(spark):
    """Two levels of a few hundred centres each; searched with bounds it is exact."""
    part = lambda n: F.sin(F.col("vec_id") * (0.37 + n) + F.col("vec_id") % (7 + 3 * n))
    rows = written(spark.range(260_000).withColumnRenamed("id", "vec_id").select("vec_id", F.array(*[part(n) for n in range(3)]).alias("embedding")))
    t = tree.build_tree(rows, 130_000, metric="euclidean", refine=0)
    assert t.cells.count() >= 100_000 and t.groups.count() < 500
    few = asked(rows.where("vec_id % 5200 = 0"))
    found, visits = tree.tree_search(t, few, 5)
    assert rows_of(found) == rows_of(knn.knn_join(few, rows, 5, metric="euclidean"))
    assert visits.agg(F.max("rows_compared")).first()[0] < 26_000


def test_empty_sides(spark, corpus):
    nothing = spark.createDataFrame([], SCHEMA)
    found, visits = tree.knn_join_pruned(asked(corpus), nothing, 3)
    assert found.count() == 0 and visits.count() == 0
    found, visits = tree.tree_search(tree.build_tree(corpus, 10), asked(nothing), 3)
    assert found.count() == 0 and visits.count() == 0
    found, compared = lsh.lsh_search(lsh.SignCodes(6, 2, 4), asked(corpus), nothing, 3)
    assert found.count() == 0 and compared.agg(F.max("rows_compared")).first()[0] == 0


def test_too_many_categories_are_refused(spark, corpus, monkeypatch):
    monkeypatch.setattr(tree, "MOST_GROUPS", 3)
    with pytest.raises(ValueError):
        tree.build_tree(corpus, 9, category="label")


def brute_codes(v, codes):
    signs = np.array(v) @ codes.planes().T >= 0
    return [tuple(row.reshape(codes.tables, codes.bits)[t]) for row in signs for t in range(codes.tables)]


@pytest.mark.parametrize("block_rows", [knn.BLOCK_ROWS, 15])
def test_sign_codes_find_who_shares_a_code(corpus, block_rows):
    """Also where copies fill a bucket that has to be split."""
    codes = lsh.SignCodes(6, 3, 5)
    rows = corpus.orderBy("vec_id").collect()
    names = np.array(brute_codes([r["embedding"] for r in rows], codes), dtype=object).reshape(len(rows), codes.tables, -1)
    want = {}
    v = np.array([r["embedding"] for r in rows])
    for i in range(0, 500, 7):
        mates = [j for j in range(500) if any((names[i][t] == names[j][t]).all() for t in range(codes.tables))]
        d = pair_distance(np.repeat(v[i : i + 1], len(mates), axis=0), v[mates], "cosine")
        best = sorted((int(np.floor(x * 1e9 + 0.5)), j, x) for x, j in zip(d, mates))[:4]
        want |= {(i, None, n + 1): (j, round(float(x), 8)) for n, (_, j, x) in enumerate(best)}
    found, _ = lsh.lsh_search(codes, asked(corpus.where("vec_id % 7 = 0")), corpus, 4, block_rows=block_rows)
    assert rows_of(found) == want


def test_sign_codes_reach_the_recall_with_few_comparisons(spark):
    rows = written(spark.createDataFrame(clusters(6000, 32, 60, 0.3), SCHEMA))
    queries = asked(rows.where("vec_id % 100 = 0"))
    found, compared = lsh.lsh_search(lsh.SignCodes(32, 12, 12), queries, rows, 10)
    assert recall(found, knn.knn_join(queries, rows, 10)).first()["recall"] >= 0.9
    assert compared.agg(F.avg("rows_compared")).first()[0] < 0.2 * 6000
