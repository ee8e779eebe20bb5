"""Mail classification against a labelled corpus, one-stage and two-stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions.mail import parse_mail
from mailvane.functions.risk import RULE_COLUMNS, analyze
from mailvane.functions.text import combine_mail
from mailvane.operators import ann, knn
from mailvane.operators.vectorize import vectorize
from mailvane.operators.vote import vote_columns
from mailvane.sources.mail import subject_metadata

STAGE2 = [*RULE_COLUMNS, "risk_score", "signals", "subtype", "risk_level"]


def train_corpus(mails: DataFrame, id_col: str = "mail_id", profile: str = "enhanced") -> DataFrame:
    """Corpus rows ``(vec_id, category, embedding, metadata)`` of labelled mails."""
    return mails.select(
        F.col(id_col).alias("vec_id"),
        "category",
        vectorize(combine_mail("subject", "body"), profile).cast("array<float>").alias("embedding"),
        subject_metadata(F.col("subject")).alias("metadata"),
    )


class Classifier:
    """Scores mails against a corpus; the corpus must have been made with ``profile``.

    ``method`` is ``exact``, ``ann`` (needs ``index``) or ``auto``: the index if there
    is one, else exact.  A corpus within ``broadcast_bytes`` is searched in place:
    parsing, vectorizing, searching, voting and the rules are then one narrow stage.
    ``leave_out_own`` scores a mail against all others: the corpus row of its id has no vote.
    """

    def __init__(
        self, corpus: DataFrame, *, k: int = V.VOTE_K, profile: str = "enhanced", method: str = "auto",
        index: ann.CellIndex | None = None, n_probe: int = 8, broadcast_bytes: int = knn.BROADCAST_BYTES,
        dim: int = V.ENHANCED_DIM, leave_out_own: bool = False,
    ):
        if method == "auto":
            method = "ann" if index else "exact"
        if method not in ("exact", "ann") or (method == "ann") != (index is not None):
            raise ValueError("method is 'exact', or 'ann' together with an index")
        self.corpus, self.k, self.profile, self.index, self.n_probe = corpus, k, profile, index, n_probe
        self.broadcast_bytes, self.leave_out_own = broadcast_bytes, leave_out_own
        self._near = None
        if method == "exact" and knn.fits_broadcast(corpus, dim, broadcast_bytes):
            self._near = knn.neighbours_udf(corpus, k + 1 if leave_out_own else k, category="category")

    @property
    def in_place(self) -> bool:
        """Whether scoring is a narrow projection (which a streaming plan can hold)."""
        return self._near is not None

    def _neighbours(self, queries: DataFrame, id_col: str, text) -> DataFrame:
        vector = vectorize(text, self.profile)
        if self._near is not None:
            near = queries.withColumn("neighbours", self._near(vector))
            return near.withColumn("neighbours", knn.others(F.col("neighbours"), F.col(id_col), self.k)) if self.leave_out_own else near
        q = queries.select(F.col(id_col).alias("qid"), vector.alias("embedding"))
        if self.index is not None:
            found = ann.search(
                self.index, q, self.corpus, self.k, n_probe=self.n_probe, category="category", leave_out_own=self.leave_out_own
            )
        else:
            found = knn.knn_join(
                q, self.corpus, self.k, category="category", broadcast_bytes=self.broadcast_bytes, leave_out_own=self.leave_out_own
            )
        item = F.struct("category", "vec_id", "distance", "rank")
        # at most k rows per category
        lists = found.groupBy("qid").agg(F.collect_list(item).alias("neighbours")).withColumnRenamed("qid", id_col)
        return queries.join(lists, id_col, "left").withColumn(
            "neighbours", F.coalesce("neighbours", F.array().cast(lists.schema["neighbours"].dataType))
        )

    def stage1(self, queries: DataFrame, id_col: str, text) -> DataFrame:
        """Add ``category, confidence, scores, counts`` for a text column."""
        votes = vote_columns(F.col("neighbours"))
        out = self._neighbours(queries.drop("category"), id_col, text)
        out = out.withColumns({n: votes[n] for n in ("scores", "counts")})
        return out.withColumns({n: votes[n] for n in ("category", "confidence")}).drop("neighbours")

    def classify_text(self, mails: DataFrame, id_col: str = "mail_id") -> DataFrame:
        """Stage 1 on subject and body; content rules only where stage 1 says attack."""
        scored = self.stage1(mails, id_col, combine_mail("subject", "body"))
        analyzed = analyze(scored, headers=False)
        attack = F.col("category") == "attack"
        return analyzed.withColumns({c: F.when(attack, F.col(c)) for c in STAGE2})

    def classify_raw(self, mails: DataFrame, id_col: str = "mail_id", raw: str = "raw") -> DataFrame:
        """Parse, stage 1 on subject and body, all rules on every mail.

        The rules never change the category of stage 1.
        """
        parsed = parse_mail(mails, raw)
        return analyze(self.stage1(parsed, id_col, combine_mail("subject", "body")))


def category_summary(classified: DataFrame, category: str = "category") -> DataFrame:
    """Rows and share of every category; ``UNKNOWN`` is a group of its own."""
    counts = classified.groupBy(category).agg(F.count(F.lit(1)).alias("n_mails"))
    total = F.sum("n_mails").over(Window.partitionBy())  # over one row per category
    return counts.select(category, "n_mails", (F.lit(100.0) * F.col("n_mails") / total).alias("percent"))


def evaluate(classified: DataFrame, expected: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """Per-case result against ``expected(id, expected)``; UNKNOWN cases are skipped ones."""
    joined = expected.select(id_col, "expected").join(classified.drop("expected"), id_col)
    return joined.withColumns(
        {
            "skipped": F.col("category") == "UNKNOWN",
            "correct": F.col("category") == F.col("expected"),
        }
    )


def evaluation_summary(detail: DataFrame) -> DataFrame:
    """One row: total (without skipped), correct, skipped, accuracy in percent."""
    done, right = F.count_if(~F.col("skipped")), F.count_if(F.col("correct"))
    return detail.agg(
        done.alias("total"),
        right.alias("correct"),
        F.count_if(F.col("skipped")).alias("skipped"),
        F.coalesce(F.lit(100.0) * right / F.nullif(done, F.lit(0)), F.lit(0.0)).alias("accuracy"),
    )


def evaluation_misses(detail: DataFrame) -> DataFrame:
    return detail.where(~F.col("correct") & ~F.col("skipped"))
