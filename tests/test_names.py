"""Similar names against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailvane.operators.names import first_resembled, similar_names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b, bound):
    return a != b and np.float32(1) - np.float32(np.float32(edits(a, b)) / np.float32(max(len(a), len(b)))) > np.float32(bound)


def made(rnd, n):
    """Short names over few letters, some with an ending, and edited copies of them."""
    out = []
    while len(out) < n:
        base = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) + rnd.choice(["", ".com", ".co.uk", ".x"])
        out.append(base)
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(base) + 1)
            out.append(base[:at] + rnd.choice(["", "b", "q"]) + base[at + rnd.randint(0, 1) :])
    return out


@pytest.mark.parametrize("bound", [0.5, 0.7, 0.85])
def test_similar_names_by_brute_force(spark, bound):
    rnd = random.Random(int(bound * 100))
    a, b = made(rnd, 120), made(rnd, 120)
    rows = [(x, 1) for x in [*a, None, "", a[0], a[1].upper()]]
    left = spark.createDataFrame(rows, "name string, entry int")
    right = spark.createDataFrame([(x, "clash") for x in [*b, None, "", b[0]]], "entry string, name string")
    out = similar_names(left, right, bound).collect()
    want = {(x, y) for x in set(a) - {""} for y in set(b) - {""} if similar(x, y, bound)}
    assert len(out) == len(want) > 0 and {(r["name"], r["entry"]) for r in out} == want
    assert similar_names(left.limit(0), right, bound).count() == 0
    assert similar_names(left, right.limit(0), bound).count() == 0


def test_a_table_of_ten_thousand_names(spark):
    """All pairs of a few hundred domains with the table, in place, against the join."""
    rnd = random.Random(9)
    stem = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 15)))
    brands = sorted({stem() + rnd.choice([".com", ".org"]) for _ in range(10_000)})
    domains = []
    for b in rnd.sample(brands, 200):
        at = rnd.randrange(len(b))
        domains += [b, b[:at] + "q" + b[at + 1 :], b[:at] + b[at + 1 :]]
    left = spark.createDataFrame([(d,) for d in domains], "name string")
    right = spark.createDataFrame(list(enumerate(brands)), "place int, entry string")
    got = {(r["name"], r["entry"]) for r in similar_names(left, right, 0.7).collect()}
    # 1 - edits / longest > 0.7 in single precision, all pairs
    longest = F.greatest(F.length("name"), F.length("entry")).cast("float")
    ratio = (F.levenshtein("name", "entry").cast("float") / longest).cast("float")
    close = (F.lit(1.0).cast("float") - ratio).cast("float") > F.lit(0.7).cast("float")
    want = {(r["name"], r["entry"]) for r in left.distinct().crossJoin(right).filter((F.col("name") != F.col("entry")) & close).collect()}
    assert got == want and len(want) >= 200


def test_first_brand_in_order(spark):
    brands = spark.createDataFrame([(1, "paypol.com"), (0, "paypel.com"), (2, "paypal.com")], "place int, brand string")
    domains = spark.createDataFrame([("paypal.com",), ("nothing.example",), (None,)], "domain string")
    assert [tuple(r) for r in first_resembled(domains, brands, 0.7).collect()] == [("paypal.com", "paypel.com")]
