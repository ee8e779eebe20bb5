"""Text vectorizers and the feature tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions import text as X
from mailvane.functions.hashing import bucket, fnv1a, hash_vectors
from mailvane.functions.jsontext import json_text
from mailvane.functions.vectors import check_dim, cosine_distance
from mailvane.operators.features import weighted_features, window_counts

# attack words come first: a word on both lists gets the attack weight
BOOSTS = {**V.SPAM_BOOST, **V.ATTACK_BOOST}
PROFILES = ("basic", "enhanced", "counts")


def token_passes(text: Column) -> list[tuple[Column, float]]:
    """Token lists of the enhanced profile: the text, and its leet-normalised form if that differs."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = lambda t: X.remove_stop_words(X.unicode_tokens(t))
    nothing = F.array().cast("array<string>")
    second = X.let(
        F.struct(lowered.alias("old"), X.normalize_leet(lowered).alias("new")),
        lambda t: F.when(t["new"] != t["old"], words(t["new"])).otherwise(nothing),
    )
    return [(words(lowered), 1.0), (second, V.LEET_PASS_WEIGHT)]


def vectorize(text: Column, profile: str = "enhanced", dim: int | None = None) -> Column:
    """Unit feature vector of a text (zero vector for a text without features).

    Vectors of different profiles are not comparable; a corpus and its queries use one.
    """
    if profile == "basic":
        return hash_vectors([(X.ascii_tokens(text), 1.0)], check_dim(dim or V.ENHANCED_DIM), bigrams=V.BIGRAM_WEIGHT)
    if profile == "enhanced":
        return hash_vectors(
            token_passes(text),
            check_dim(dim or V.ENHANCED_DIM),
            bigrams=V.BIGRAM_WEIGHT,
            trigrams=V.TRIGRAM_WEIGHT,
            boosts=BOOSTS,
        )
    if profile == "counts":
        words = X.remove_stop_words(X.unicode_tokens(text))
        return hash_vectors([(words, 1.0)], check_dim(dim or V.COUNTS_DIM), signed=False)
    raise ValueError(f"profile is one of {PROFILES}")


def vectorize_json(value: Column, dim: int | None = None) -> Column:
    """Basic-profile vector of a JSON value's keys and scalars; null if it is not valid JSON."""
    text = json_text(value)
    return F.when(text.isNotNull(), vectorize(text, "basic", dim))


def sparse(vectors: DataFrame, id_col: str, vector: str = "vector") -> DataFrame:
    """``(id, bucket, value)`` of the non-zero items.

    The outer form keeps Spark from adding a size filter below, for which it would
    compute the vector a second time; the null rows it adds fail the condition.
    """
    return vectors.select(id_col, F.posexplode_outer(vector).alias("bucket", "value")).where(F.col("value") != 0)


def _runs(items: Column, value) -> Column:
    """Distinct items of an array, each with ``value(its equal items)``, within the row.

    Sorting brings equal ones together, so no row is exploded before it has been counted.
    """

    def of_sorted(s: Column) -> Column:
        placed = F.transform(s, lambda x, i: F.struct(x["item"].alias("item"), i.alias("at")))
        first = F.filter(placed, lambda e: (e["at"] == 0) | (e["item"] != F.get(s, e["at"] - 1)["item"]))
        upto = lambda starts, j: F.coalesce(F.get(starts, j + 1)["at"], F.size(s))
        return X.let(
            first,
            lambda starts: F.transform(
                starts, lambda e, j: F.struct(e["item"].alias("item"), value(F.slice(s, e["at"] + 1, upto(starts, j) - e["at"])).alias("v"))
            ),
        )

    return X.let(F.sort_array(items), of_sorted)


def feature_counts(docs: DataFrame, id_col: str, features: Column, name: str) -> DataFrame:
    """``(id, feature, n)``: how often each feature of an array occurs in its row."""
    items = F.transform(features, lambda t: F.struct(t.alias("item")))
    counted = docs.select(id_col, F.explode(_runs(items, lambda same: F.size(same).cast("long"))).alias("e"))
    return counted.select(id_col, F.col("e.item").alias(name), F.col("e.v").alias("n"))


def unigram_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    return feature_counts(docs, id_col, tokens, "word")


def trigram_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(id, trigram, n)`` of the 3-byte windows of all tokens, named by their hex."""
    return window_counts(docs, id_col, tokens, "trigram")


def boosted_unigrams(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """Word weights with keyword boosts: a join with the (fixed, 39 row) boost table."""
    table = docs.sparkSession.createDataFrame(sorted(BOOSTS.items()), "word string, boost double")
    return (
        unigram_counts(docs, id_col, tokens)
        .join(F.broadcast(table), "word", "left")
        .select(id_col, "word", "n", (F.col("n") * F.coalesce("boost", F.lit(1.0))).alias("weight"))
    )


def enhanced_features(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Weight of every feature of the enhanced profile, features named by the hex of their bytes."""

    return weighted_features(docs, id_col, token_passes(text), BOOSTS)


def vocabulary(docs: DataFrame, tokens: Column, dim: int) -> DataFrame:
    """Distinct words with hash and bucket; each word is hashed once."""
    words = docs.select(F.explode(tokens).alias("word")).distinct()
    return words.withColumn("hash", fnv1a(F.col("word"))).withColumn("bucket", bucket(F.col("hash"), dim))


def hash_collisions(vocab: DataFrame) -> DataFrame:
    """Buckets that more than one distinct word falls into: count, first and last word.

    The words themselves stay rows of ``vocab``; no list of unbounded length is built.
    """
    return (
        vocab.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))
        .where(F.col("n_words") > 1)
    )


def collision_words(vocab: DataFrame) -> DataFrame:
    """The words of colliding buckets, one row each.

    There are at most as many buckets as dimensions, so they are broadcast: a shuffle
    by bucket would give each task a whole share of the vocabulary.
    """
    crowded = F.broadcast(hash_collisions(vocab).select("bucket"))
    return vocab.join(crowded, "bucket", "left_semi").select("bucket", "word", "hash")


def profile_diff(docs: DataFrame, id_col: str, text: Column, left: str = "basic", right: str = "enhanced") -> DataFrame:
    """Cosine distance, and dimensions that differ by more than 0.001, of two profiles on one text.

    Both vectors are computed next to each other, so nothing is joined.
    """
    both = docs.select(
        id_col, vectorize(text, left, V.ENHANCED_DIM).alias("a"), vectorize(text, right, V.ENHANCED_DIM).alias("b")
    )
    gaps = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    return both.select(
        id_col,
        cosine_distance(F.col("a"), F.col("b")).alias("distance"),
        F.size(F.filter(gaps, lambda g: g > 0.001)).alias("n_diff"),
    )


def table_diff(
    left: DataFrame, right: DataFrame, id_col: str = "vec_id", vector: str = "embedding", tolerance: float = 0.001
) -> DataFrame:
    """``id, side, distance, n_diff`` of two stored vector tables: rows of both, or of one of them only.

    One full outer join by id (ids are unique in each table); dimensions are compared
    within the row, missing ones and missing rows as zeros.  ``side`` is ``both``, ``left`` or
    ``right``; ``distance`` is the cosine distance, 1 where a row has no counterpart.
    """
    a = left.select(F.col(id_col), F.col(vector).alias("_a"), F.lit(True).alias("_left"))
    b = right.select(F.col(id_col), F.col(vector).alias("_b"), F.lit(True).alias("_right"))
    side = F.when(F.col("_left").isNull(), "right").when(F.col("_right").isNull(), "left").otherwise("both")
    none = F.array().cast("array<double>")
    at = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    both = a.join(b, id_col, "full").select(
        id_col, side.alias("side"), F.zip_with(F.coalesce("_a", none), F.coalesce("_b", none), lambda x, y: F.struct(at(x).alias("x"), at(y).alias("y"))).alias("p")
    )
    part = lambda name: F.transform("p", lambda e: e[name])
    return both.select(
        id_col,
        "side",
        cosine_distance(part("x"), part("y")).alias("distance"),
        F.size(F.filter("p", lambda e: F.abs(e["x"] - e["y"]) > tolerance)).alias("n_diff"),
    )
