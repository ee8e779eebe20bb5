"""Hard negatives and exact top-k products against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailvane.llm.intvectors import HIGHEST, LOWEST, products
from mailvane.llm.negatives import SortedLists, hard_negatives, window_of
from mailvane.llm.retrieval import LengthBuckets, length_bin, top_products

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(v):
    return [math.floor(x * 256) if abs(x) < 2**40 else int(x * 256) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def score(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), LOWEST), HIGHEST)


def order(pair):
    """Best first: score, then id, null last."""
    s, i = pair
    return -s, i is None, i or 0


def brute_top(rows, k, every):
    held = [(i, whole(v)) for i, v, _ in rows if usable(v)]
    out = []
    for n, (q, a) in enumerate(held):
        if q is not None and q % every == 0:
            found = sorted([(score(a, b), i) for m, (i, b) in enumerate(held) if m != n], key=order)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return sorted(out, key=str)


def brute_negatives(rows, every, n_positives=5, n_negatives=3):
    held = [(i, whole(v), label) for i, v, label in rows if usable(v) and label is not None]
    out = []
    for n, (a, av, al) in enumerate(held):
        if a is None or a % every:
            continue
        others = [(score(av, v), i, label) for m, (i, v, label) in enumerate(held) if m != n]
        positives = sorted([(s, i) for s, i, label in others if label == al], key=order)[:n_positives]
        for ps, pid in positives:
            inside = [(s, i) for s, i, label in others if label != al and 50 * ps <= 100 * s <= 95 * ps]
            out += [(a, pid, r + 1, i, ps, s) for r, (s, i) in enumerate(sorted(inside, key=order)[:n_negatives])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def some_rows(kind, n=260, dim=8, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if kind == "lengths":  # a few long vectors, and clusters
            centre, far = rng.randrange(5), rng.choice([1, 1, 1, 4, 30])
            v = [far * ((2.0 if d == centre else 0.0) + rng.gauss(0, 0.1)) for d in range(dim)]
        elif kind == "ties":
            v = [float(rng.randrange(-1, 2)) for _ in range(dim)]
        elif kind == "peaks":  # one large component each
            v = [0.0] * dim
            v[rng.randrange(dim)] = rng.choice([-1, 1]) * rng.random() ** 4 * 50
        else:
            v = [rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 3])))
    return rows


ODD = [
    (0, [1.0, 2.0, 3.0], 1),
    (0, [1.0, 2.0, 3.0], 1),
    (10, [1.0, 2.0], 1),
    (20, [], 2),
    (30, None, 1),
    (40, [1.0, None], 1),
    (50, [float("nan")], 1),
    (60, [float("inf"), 1.0], 1),
    (70, [0.0, 0.0, 0.0], None),
    (80, [0.0, 0.0, 0.0], 2),
    (None, [0.5, 1.0, 1.0], 1),
    (None, [0.5, 1.0, 1.0], 2),
    (1, [0.5, 1.0, 1.0], 2),
    (2, [0.75, 1.0, 1.5], 2),
    (3, [-1.0, -2.0, -3.0], 1),
    (90, [-4.0, 0.0, 0.0], 3),
    (-10, [0.5, 1.0, 1.0], 2),
]
HUGE = [(0, [1e300, 1.0], 1), (10, [-3e14, 2.0], 1), (20, [1e12, 1e12], 1), (1, [3e9, -3e9], 2), (2, [1.5, 2.5], 2), (3, [4e8, 1.0], 2), (4, [1e300, 0.0], 2)]


@pytest.mark.parametrize("kind", ["lengths", "ties", "peaks", "plain"])
def test_top_products_equal_brute_force(spark, kind):
    rows = some_rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = top_products(df, F.col("vec_id") % 10 == 0, 4, block_rows=50, block_queries=10, seed_bytes=8 * 8 * 12)
    assert rows_of(found) == brute_top(rows, 4, 10)


@pytest.mark.parametrize("rows", [ODD, HUGE], ids=["odd", "huge"])
def test_odd_vectors(spark, rows):
    """Nulls, empty, short and zero vectors, repeated rows and ids, scores beyond a long."""
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(top_products(df, F.col("vec_id") % 10 == 0, 3)) == brute_top(rows, 3, 10)
    assert rows_of(hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))) == brute_negatives(rows, 10)


@pytest.mark.parametrize("kind", ["lengths", "ties", "peaks", "plain"])
def test_hard_negatives_equal_brute_force(spark, kind):
    """Label 0 holds half of all rows and is cut into blocks."""
    rows = some_rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), block_rows=50, block_anchors=10)
    assert rows_of(found) == brute_negatives(rows, 10)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    asked = F.col("vec_id") % 10 == 0
    assert top_products(empty, asked).count() == 0
    assert hard_negatives(empty, asked, F.col("label")).count() == 0
    rows = some_rows("plain", 60)
    none = spark.createDataFrame(rows, SCHEMA).where("vec_id % 10 <> 0")
    assert top_products(none, asked).count() == 0
    assert hard_negatives(none, asked, F.col("label")).count() == 0
    names = ["row", "id", "v", "length", "bin", "part", "asked", "anchor", "cell", "least", "score", "rank", "a.b"]
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in names})
    assert rows_of(top_products(clashing, asked, 4)) == brute_top(rows, 4, 10)
    assert rows_of(hard_negatives(clashing, asked, F.col("label"))) == brute_negatives(rows, 10)


def test_labels_of_any_type(spark):
    rows = some_rows("plain", 80)
    df = spark.createDataFrame(rows, SCHEMA)
    text = hard_negatives(df, F.col("vec_id") % 10 == 0, F.concat(F.lit("label "), F.col("label").cast("string")))
    assert rows_of(text) == brute_negatives(rows, 10)


# what the two methods leave undone


def matrix_of(kind, n, dim):
    return np.floor(256 * np.array([v for _, v, _ in some_rows(kind, n, dim)]))


def exact_best(q, m, k):
    s = products(q, m)
    return [sorted(((int(-x), j) for j, x in enumerate(line)))[:k] for line in s]


@pytest.mark.parametrize("kind", ["lengths", "plain", "peaks"])
def test_length_buckets_prune_and_stay_exact(kind):
    m, k = matrix_of(kind, 4000, 16), 5
    rows = np.arange(len(m))
    block = LengthBuckets(rows, m, rows)
    q = m[::97]
    qi, position, s = block.search(np.full(len(q), -1), q, np.full(len(q), LOWEST), k)
    got = [sorted((-int(b), int(block.row[a])) for i, a, b in zip(qi, position, s) if i == n) for n in range(len(q))]
    assert got == exact_best(q, m, k)
    if kind != "plain":
        assert block.verified < 0.6 * len(q) * len(m)
        assert block.left_out > 0


def test_length_buckets_search_by_coordinates():
    rng = np.random.default_rng(3)
    centre = np.eye(16)[rng.integers(0, 16, 4000)] * 900
    m = centre + rng.normal(0, 20, centre.shape)
    m = np.floor(900 * m / np.linalg.norm(m, axis=1)[:, None])  # all of one length: it decides nothing
    rows = np.arange(len(m))
    block = LengthBuckets(rows, m, rows)
    q = m[::101]
    qi, position, s = block.search(np.full(len(q), -1), q, np.full(len(q), LOWEST), 5)
    got = [sorted((-int(b), int(block.row[a])) for i, a, b in zip(qi, position, s) if i == n) for n in range(len(q))]
    assert got == exact_best(q, m, 5)
    assert block.by_coordinate > 0
    assert block.verified < 0.5 * len(q) * len(m)


def test_length_bins_grow_with_length():
    lengths = np.array([0.0, 5e-324, 1e-9, 0.5, 1.0, 1.01, 2.0, 1e300, np.inf])
    bins = length_bin(lengths)
    assert bins[0] == -1 and (np.diff(bins) >= 0).all() and bins[3] < bins[4] < bins[6]


def test_threshold_algorithm_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    m = np.floor(rng.normal(0, 1, (5000, 6)) * 40)
    m[rng.integers(0, 5000, 60), rng.integers(0, 6, 60)] += 5000  # a few rows that stand out
    lists = SortedLists(m)
    anchors = np.floor(np.eye(6) * 300 + rng.normal(0, 1, (6, 6)))
    n = len(anchors)
    w, p, s = lists.search(anchors, lambda i: np.ones((len(i), len(m)), bool), np.arange(n), np.full(n, LOWEST), np.full(n, HIGHEST), 3)
    got = [sorted((-int(b), int(a)) for i, a, b in zip(w, p, s) if i == j) for j in range(n)]
    assert got == exact_best(anchors, m, 3)
    assert lists.read_whole == 0 and lists.accessed < 0.2 * n * len(m)


def test_threshold_algorithm_keeps_ties_at_the_stop():
    """Rows that tie with the k-th score are met before the lists stop: smaller positions win."""
    m = np.array([[5.0, 0.0]] * 3 + [[9.0, 0.0]] * 4 + [[0.0, 1.0]] * 400)
    lists = SortedLists(m)
    w, p, s = lists.search(np.array([[2.0, 0.0]]), lambda i: np.ones((1, len(m)), bool), np.zeros(1, int), np.array([LOWEST]), np.array([17]), 2)
    assert list(zip(p, s)) == [(0, 10), (1, 10)]


def test_windows():
    assert window_of(100, 50, 95) == (50, 95)
    assert window_of(101, 50, 95) == (51, 95)
    low, high = window_of(-10, 50, 95)
    assert low > high
    assert window_of(0, 50, 95) == (0, 0)
