import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions import text as X
from mailvane.functions.hashing import bucket, fnv1a, sign
from mailvane.functions.jsontext import json_text, number_g6
from mailvane.operators import vectorize as vz


def fnv_py(data: bytes, offset=V.FNV_OFFSET) -> int:
    h = offset
    for b in data:
        h = ((h ^ b) * V.FNV_PRIME) & 0xFFFFFFFF
    return h


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("r")).first()["r"]


WORDS = ["password", "a", "", "é", "naïve", "日本語", "𝒳y", "straße", "x" * 300, "key:k"]


def test_fnv_matches_bytes(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = {r["w"]: r["h"] for r in df.select("w", fnv1a(F.col("w")).alias("h")).collect()}
    assert got == {w: fnv_py(w.encode()) for w in WORDS}
    assert got["password"] == 910909208


def test_sign_equals_the_second_hash(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    rows = df.select("w", sign(fnv1a(F.col("w"))).alias("s"), bucket(fnv1a(F.col("w")), 256).alias("b")).collect()
    for r in rows:
        assert r["s"] == (1 if fnv_py(r["w"].encode(), 2147483647) & 1 else -1)
        assert (r["b"] % 2 == 1) == (r["s"] == 1)


def test_tokenizers(spark):
    t = "Hello, WORLD! a-b c_d 42 Ärger naïve é ½"
    assert one(spark, t, X.ascii_tokens("text")) == [
        "hello", "world", "a", "b", "c", "d", "42", "Ärger", "naïve", "é", "½"
    ]
    assert one(spark, t, X.unicode_tokens("text"))[:9] == [
        "hello", "world", "a", "b", "c", "d", "42", "ärger", "naïve"
    ]
    assert one(spark, "", X.ascii_tokens("text")) == []
    assert one(spark, None, X.unicode_tokens("text")) == []


def test_leet_only_touches_words_with_letters(spark):
    assert one(spark, "acc0unt  45000 p@$$w0rd!\n$5", X.normalize_leet("text")) == "account 45000 passwordi $5"


def test_bigrams_and_trigrams_of_short_lists(spark):
    words = X.unicode_tokens("text")
    assert one(spark, "", X.bigrams(words)) == []
    assert one(spark, "one", X.bigrams(words)) == []
    assert one(spark, "one two three", X.bigrams(words)) == ["one_two", "two_three"]
    assert one(spark, "ab abc éa", X.byte_trigrams_hex(words)) == ["616263", "C3A961"]


def reference_vector(text, profile):
    """Straightforward per-feature model of the vectorizers."""
    import regex

    dim = V.COUNTS_DIM if profile == "counts" else V.ENHANCED_DIM
    out = np.zeros(dim)

    def add(feature: bytes, weight):
        h = fnv_py(feature)
        out[h % dim] += weight * (1 if profile == "counts" or h & 1 else -1)

    def words(t):
        if profile == "basic":
            t = "".join(c.lower() if c.isascii() else c for c in t)
            return regex.findall(r"[0-9a-z\x80-\U0010FFFF]+", t)
        return [w for w in regex.findall(r"[\p{L}\p{Nd}]+", t.lower()) if w not in V.STOP_WORDS]

    def run(ws, base):
        for w in ws:
            boost = V.ATTACK_BOOST.get(w, V.SPAM_BOOST.get(w, 1.0)) if profile == "enhanced" else 1.0
            add(w.encode(), boost * base)
        if profile != "counts":
            for a, b in zip(ws, ws[1:]):
                add(f"{a}_{b}".encode(), V.BIGRAM_WEIGHT * base)
        if profile == "enhanced":
            for w in ws:
                d = w.encode()
                for i in range(len(d) - 2):
                    add(d[i : i + 3], V.TRIGRAM_WEIGHT * base)

    run(words(text), 1.0)
    if profile == "enhanced":
        low = text.lower()
        table = str.maketrans(V.LEET_FROM, V.LEET_TO)
        leet = " ".join(w.translate(table) if regex.search(r"\p{L}", w) else w for w in low.split())
        if leet != low:
            run(words(leet), V.LEET_PASS_WEIGHT)
    n = math.sqrt((out * out).sum())
    return out / n if n else out


TEXTS = [
    "Urgent: verify your acc0unt password now!",
    "",
    "the and of",
    "one",
    "日本語 テキスト naïve café\nnew line  double",
    "a b c " * 50,
    "no leet here",
    "Ünïcödé wörds with 𝒳 symbols",
]


@pytest.mark.parametrize("profile", vz.PROFILES)
def test_vectorizers_match_the_model(spark, profile):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {r["id"]: r["v"] for r in df.select("id", vz.vectorize(F.col("text"), profile).alias("v")).collect()}
    for i, t in enumerate(TEXTS):
        np.testing.assert_allclose(got[i], reference_vector(t, profile), atol=1e-12)


def test_vector_dimension_and_norm(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for dim in (64, 100, 512):
        for r in df.select(vz.vectorize(F.col("text"), "basic", dim).alias("v")).collect():
            n = np.linalg.norm(r["v"])
            assert len(r["v"]) == dim and (abs(n - 1) < 1e-9 or n == 0)


def test_leet_spelling_is_nearer_than_other_text(spark):
    rows = spark.createDataFrame(
        [("a", "verify your account password"), ("b", "v3rify your acc0unt passw0rd"), ("c", "lunch on thursday then")],
        "id string, text string",
    ).select("id", vz.vectorize(F.col("text")).alias("v")).collect()
    v = {r["id"]: np.array(r["v"]) for r in rows}
    assert 1 - v["a"] @ v["b"] < 1 - v["a"] @ v["c"]


def test_json_text(spark):
    cases = {
        '{"b": {"x": [1, 2.5, "two"]}, "a": true, "n": null}': "key:b key:x 1 2.5 two key:a true key:n",
        "[1e20, 0.0000123456789, 123456789, false]": "1e+20 1.23457e-05 1.23457e+08 false",
        '{"k": 1, "k": 2}': "key:k 1 key:k 2",
        '{"broken"': None,
        '"text"': "text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r["j"]: r["t"] for r in df.select("j", json_text(F.col("j")).alias("t")).collect()}
    assert got == cases


def test_number_text_is_that_of_printf(spark):
    values = [0.0, 1.0, -1.5, 0.1, 123456.0, 1234567.0, 0.0001, 0.00001234, 1e-30, -9.9999999e5, 1e20, 3.14159265]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["t"] for r in df.select("v", number_g6(F.col("v")).alias("t")).collect()]
    assert got == ["%.6g" % v for v in values]


def test_boosts_and_collisions(spark):
    df = spark.createDataFrame([(1, "urgent urgent lunch free")], "id int, text string")
    got = {r["word"]: r["weight"] for r in vz.boosted_unigrams(df, "id", X.unicode_tokens("text")).collect()}
    assert got == {"urgent": 4.0, "lunch": 1.0, "free": 1.8}
    vocab = vz.vocabulary(df, X.unicode_tokens("text"), 2)
    assert sum(r["n_words"] for r in vz.hash_collisions(vocab).collect()) == vz.collision_words(vocab).count()


def test_profile_diff_of_equal_profiles_is_zero(spark):
    df = spark.createDataFrame([(1, "some words")], "id int, text string")
    r = vz.profile_diff(df, "id", F.col("text"), "basic", "basic").first()
    assert abs(r["distance"]) < 1e-9 and r["n_diff"] == 0


def test_counted_features_equal_brute_force_and_take_long_words(spark):
    import re
    import time
    from collections import Counter

    from mailvane.operators import vectorize as vz
    from mailvane.operators.features import weighted_features

    long = "".join(chr(97 + i * i % 26) for i in range(300_000))
    texts = ["", None, "a", "ab b abc abc abcd", "é ñandú 東京都 x abc", "one " * 40, long, "b abc a", "abc abc"]
    docs = spark.createDataFrame([(i % 8, t) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    want, weights = Counter(), Counter()
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"\s+", t or "") if w]
        for w in words:
            b = w.encode()
            grams = [b[j : j + 3].hex().upper() for j in range(len(b) - 2)]
            want.update((i, g) for g in grams)
            weights[i, b.hex().upper()] += 2.0 if w == "abc" else 1.0
            for g in grams:
                weights[i, g] += 0.3
        for x, y in zip(words, words[1:]):
            weights[i, f"{x}_{y}".encode().hex().upper()] += 0.7
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    start = time.time()
    # ids 0 and 8 are the same number: two rows, counted apart
    got = vz.trigram_counts(docs, "id", tokens).collect()
    assert sorted((r["id"], r["trigram"], r["n"]) for r in got) == sorted((i % 8, g, n) for (i, g), n in want.items())
    got = weighted_features(docs, "id", [(tokens, 1.0)], {"abc": 2.0}).collect()
    assert sorted((r["id"], r["feature"], round(r["weight"], 6)) for r in got) == sorted((i % 8, g, round(n, 6)) for (i, g), n in weights.items())
    assert time.time() - start < 60  # quadratic in the length of a word before
