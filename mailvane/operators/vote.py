"""From neighbours to a category: mean distance per category, winner, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V


def _confidence(ascending: Column) -> Column:
    """1 - best/second of the sorted scores; 0 without a usable second one."""
    best, second = F.get(ascending, F.lit(0)), F.get(ascending, F.lit(1))
    raw = F.when(second > V.MIN_SECOND_SCORE, 1.0 - best / second).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def category_rank(category: Column, categories: list[str] | None) -> Column:
    """Tie-break: position in ``categories``, or the category itself."""
    if categories is None:
        return category
    return F.array_position(F.array(*[F.lit(c) for c in categories]), category)


def category_scores(neighbours: DataFrame) -> DataFrame:
    """``(qid, category, score, n_matches)`` from a per-category k-NN result."""
    return neighbours.groupBy("qid", "category").agg(
        F.avg("distance").alias("score"), F.count(F.lit(1)).alias("n_matches")
    )


def vote(scores: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Winning category and confidence of every query that has a score."""
    order = F.struct("score", category_rank(F.col("category"), categories).alias("ord"))
    # one score per category, so the list is as long as the category set
    return scores.groupBy("qid").agg(
        F.min_by("category", order).alias("category"),
        _confidence(F.array_sort(F.collect_list("score"))).alias("confidence"),
    )


def with_unknown(queries: DataFrame, voted: DataFrame, query_id: str = "qid") -> DataFrame:
    """Every query, ``UNKNOWN`` with confidence 0 where no category had a match."""
    return (
        queries.select(F.col(query_id).alias("qid"))
        .join(voted, "qid", "left")
        .select(
            "qid",
            F.coalesce("category", F.lit("UNKNOWN")).alias("category"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
    )


def vote_columns(neighbours: Column, categories: list[str] = V.CATEGORIES) -> dict[str, Column]:
    """The vote on a neighbour array, in place: ``scores, counts, category, confidence``.

    ``scores`` and ``counts`` follow ``categories``; a category without match has a
    null score and cannot win.
    """

    def of_category(c: str) -> Column:
        return F.transform(F.filter(neighbours, lambda n: n["category"] == c), lambda n: n["distance"])

    distances = [of_category(c) for c in categories]
    sizes = [F.size(d) for d in distances]
    means = [
        F.when(n > 0, F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n) for d, n in zip(distances, sizes)
    ]
    valid = F.array_sort(F.array_compact(F.col("scores")))
    ranked = F.array_min(
        F.filter(
            F.array(
                *[
                    F.struct(F.get("scores", F.lit(i)).alias("score"), F.lit(i).alias("ord"))
                    for i in range(len(categories))
                ]
            ),
            lambda s: s["score"].isNotNull(),
        )
    )
    names = F.array(*[F.lit(c) for c in categories])
    return {
        "scores": F.array(*means),
        "counts": F.array(*sizes),
        "category": F.coalesce(F.get(names, ranked["ord"]), F.lit("UNKNOWN")),
        "confidence": _confidence(valid),
    }
