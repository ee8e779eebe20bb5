"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Every word gives its first three characters, its last three (a shorter word: all of it), the
fourth to sixth (what there is of them), and a longer word what follows as well, three by three,
so that every character is in an n-gram; each of these four kinds is hashed to buckets of its
own.  Such n-grams are few in any language, so buckets do not fill up as the corpus
grows.  They are counted over the trusted
documents (target) and over all others (raw corpus).  Both multinomials give a fixed share
evenly to all buckets, the raw one more: an n-gram that neither has seen always scores
log(TARGET_FLOOR / RAW_FLOOR), below 0, whatever the size of the corpus.  A text's score is
the mean of log(target / raw) over its n-grams; a text below the threshold is rejected.  A
few plain rules come before.

DataFrame functions only; words are counted before they are cut, by partial aggregates, so each
distinct word of a task, and then its buckets, are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.llm.shared import SPACE_CLASS, named, words

#: Of each kind of n-gram; a power of two.
BUCKETS = 65_536
KINDS = 4
GRAM = 3
#: Shares that the two multinomials spread evenly over the buckets.
TARGET_FLOOR = 0.01
RAW_FLOOR = 0.1
#: Bound on the labelled documents that make up the target.
TRUSTED_DOCS = 20_000
THRESHOLD = -1.0
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of at most ``most`` documents labelled as good, by hash order; bounded, so it may be broadcast."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return good.orderBy(F.md5(F.col("_trusted").cast("string")), "_trusted").limit(most)


def _next(array: str, i: Column, by: int) -> Column:
    return F.get(F.col(array), i + by)


def _buckets(array: str) -> Column:
    """Buckets of the n-grams of the words in column ``array``, kind after kind."""
    grams = lambda start, kind: F.transform(
        array, lambda w: F.hash(F.substring(w, start, GRAM)).bitwiseAND(F.lit(BUCKETS - 1)) + kind * BUCKETS
    )
    long = F.filter(array, lambda w: F.length(w) > 2 * GRAM)
    # one pass over the rest of a word, however long it is
    rest = F.flatten(F.transform(long, lambda w: F.regexp_extract_all(F.substr(w, F.lit(1 + 2 * GRAM)), F.lit(f"(?s).{{1,{GRAM}}}"), F.lit(0))))
    return F.concat(grams(1, 0), grams(-GRAM, 1), grams(1 + GRAM, 2), F.transform(rest, lambda g: F.hash(g).bitwiseAND(F.lit(BUCKETS - 1)) + 3 * BUCKETS))


def ratio_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``model``: the log ratio of every bucket, as an array.

    Shares are those within a kind; a kind that one side lacks has only its floor there.

    Without trusted documents, or without others, all ratios are equal to 0.
    """
    trusted = F.broadcast(trusted_ids(labels))
    narrow = docs.select(F.col("doc_id"), F.col("text"))  # no other column may bear the name of the trusted ids
    split = narrow.join(trusted, F.col("doc_id") == F.col("_trusted"), "left").select(
        words(F.col("text")).alias("_words"), F.col("_trusted").isNotNull().alias("_target")
    )
    # a word is cut into n-grams once for all its places in a task's rows, not at each of them
    by_word = split.select(F.explode("_words").alias("_word"), "_target").groupBy("_word")
    seen = by_word.agg(F.count_if(~F.col("_target")).alias("raw"), F.count_if(F.col("_target")).alias("target")).withColumn("_word", F.array("_word"))
    counts = seen.select(F.explode(_buckets("_word")).alias("bucket"), "raw", "target").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(KINDS * BUCKETS).select(F.col("id").cast("int").alias("_bucket"))
    dense = every.join(counts, F.col("_bucket") == F.col("bucket"), "left").select("_bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    totals = lambda n: F.array(*[F.sum(F.when(F.floor(F.col("_bucket") / BUCKETS) == kind, F.col(n)).otherwise(0)) for kind in range(KINDS)])
    # one row each for the buckets, which are bounded
    listed = dense.agg(F.sort_array(F.collect_list(F.struct("_bucket", "raw", "target"))).alias("all"), totals("raw").alias("raws"), totals("target").alias("targets"))
    total = lambda x, name: F.greatest(F.get(F.col(name), F.floor(x["_bucket"] / BUCKETS).cast("int")), F.lit(1))
    share = lambda x, n, name, floor: (1 - floor) * x[n] / total(x, name) + floor / BUCKETS
    ratio = lambda x: F.when(
        (F.get("targets", F.lit(0)) > 0) & (F.get("raws", F.lit(0)) > 0),
        F.log(share(x, "target", "targets", TARGET_FLOOR)) - F.log(share(x, "raw", "raws", RAW_FLOOR)),
    ).otherwise(F.lit(0.0))
    return listed.select(F.transform("all", ratio).alias("model"))


def _repeated_words(tri: str, tagged: str, places: str) -> tuple[Column, Column, Column]:
    """Steps to count the words in three-word windows that occur twice or more.

    Windows are sorted by hash with their place; equal neighbours are repeated, and each
    adds three words, less where the next repeated window overlaps.
    """
    several = F.size(F.array_distinct(tri)) < F.size(tri)
    sort = F.when(several, F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, j: (x["h"] == F.get(F.col(tagged), j - 1)["h"]) | (x["h"] == F.get(F.col(tagged), j + 1)["h"])
    found = F.sort_array(F.transform(F.filter(tagged, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
    width = F.transform(places, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(F.col(places), j + 1) - v, F.lit(3))))
    total = F.coalesce(F.aggregate(width, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return sort, found, total


def judged(docs: DataFrame, model: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` as a struct ``carried`` with the counts, ``score`` and verdicts of every document.

    Null and empty texts have no words and fail the first rule.  Rows are judged one by
    one, so repeated rows and null ids change nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE_CLASS}]")))
    first = docs.select(
        F.struct(*named(carry)).alias("carried"),
        words(F.col("text")).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    tri = F.transform(
        F.slice(F.col("_hashes"), F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, _next("_hashes", i, 1), _next("_hashes", i, 2)),
    )
    held = ["carried", "n_symbols"]
    second = first.select(
        *held,
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        _buckets("_words").alias("_buckets"),
    )
    sort, found, total = _repeated_words("_tri", "_tagged", "_places")
    held += ["word_chars", "n_words", "n_dup_lines"]
    third = second.select(*held, "_buckets", tri.alias("_tri")).select(*held, "_buckets", sort.alias("_tagged")).select(*held, "_buckets", found.alias("_places"))
    log_ratio = F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(F.col("_model"), b)) / F.greatest(F.size("_buckets"), F.lit(1))
    fourth = third.select(*held, total.alias("n_repeat_words"), "_buckets", model.scalar().alias("_model"))
    fifth = fourth.select(*held, "n_repeat_words", F.round(log_ratio, 9).alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return fifth.select("*", failed.alias("base_failed")).select("*", (~F.col("base_failed") & (F.col("score") >= THRESHOLD)).alias("kept"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows, one per document.

    Null and empty texts have no words and fail the first rule; long texts are read whole.
    Repeated rows, and rows without an id, are judged like any other.  An empty table gives
    no rows; without trusted documents, or without others, every score is 0.  Other columns are not read.
    """
    out = judged(docs, ratio_model(docs, labels), ["doc_id"])
    return out.select("carried.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones, all columns unchanged, whatever their names; else as :func:`quality_report`."""
    # the row number keeps the filter above the projections, whose work it would repeat
    rows = judged(docs, ratio_model(docs, labels), docs.columns).select("carried", "kept", F.monotonically_increasing_id().alias("_n"))
    return rows.filter("kept and _n >= 0").select("carried.*")
