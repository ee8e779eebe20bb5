"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Tokens are runs of letters and digits; features are the folded word and its beginnings.
Documents are labelled as wholes, so a training token counts as toxic when its document
is and one of its features is far more common in toxic documents.  Forward and backward
passes give each token's marginal; marginals make the document's score, by a small
logistic fit on documents the field was not trained on, and the offending spans.

Only features with evidence have weights.  All other tokens have the same potential, so a
run of n of them is the n-th power of one 2 x 2 matrix: a text costs as many steps as it
has telling tokens, and inference stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.llm.wordhash import LETTERS, U64, mix, slices, text_column, word_runs
from mailvane.shipping import ship_package

#: Bounds of the training sample: labelled rows of each class by hash order, and their length.
TOXIC_ROWS, CLEAN_ROWS, MOST_CHARS = 2000, 4000, 20_000
PREFIXES = (5, 6, 7, 8)
LEAST_DOCS = 3
LEAST_LOG_ODDS = 1.0
TOXIC_LOG_ODDS = 2.0
MOST_FEATURES = 4000
FLAGGED = 0.3
STEPS = 40


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def token_features(runs: dict) -> list[np.ndarray]:
    """Hashed features of the runs, one array for each kind; 0 is none."""
    salted = lambda h, k: np.where(h == 0, U64(0), mix(h + U64(k)))
    return [salted(runs["hash"], 1), *(salted(runs["prefix"][k], k) for k in PREFIXES)]


def _runs(raw: np.ndarray, offsets: np.ndarray) -> dict:
    return word_runs(raw, offsets, LETTERS, lower=True, prefixes=PREFIXES)


class Weights:
    """Feature weights found by hash."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.features & U64(0xFFFF)).astype(np.int64)] = True

    def find(self, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Token and feature number of every known feature."""
        tokens, found = [], []
        for h in kinds:
            likely = np.flatnonzero(self.maybe[(h & U64(0xFFFF)).astype(np.int64)])
            if len(self.features) and len(likely):
                at = np.minimum(np.searchsorted(self.features, h[likely]), len(self.features) - 1)
                hit = self.features[at] == h[likely]
                tokens.append(likely[hit])
                found.append(at[hit])
        if not tokens:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(tokens), np.concatenate(found)


class Chains:
    """Texts as telling tokens and the lengths of the gaps around them, padded."""

    def __init__(self, token: np.ndarray, ptr: np.ndarray):
        """``token``: sorted numbers of the telling tokens; ``ptr``: first token of each text."""
        at = np.searchsorted(token, ptr)
        self.length = np.diff(at)
        self.rows, self.width = len(ptr) - 1, int(self.length.max()) if len(ptr) > 1 and len(token) else 0
        self.row = np.repeat(np.arange(self.rows), self.length)
        self.column = np.arange(len(token)) - at[self.row]
        before = np.where(self.column == 0, ptr[self.row] - 1, np.append(-1, token[:-1])) if len(token) else token
        self.gap = np.zeros((self.rows, self.width + 1), dtype=np.int64)
        self.gap[self.row, self.column] = token - before - 1
        last = np.where(self.length > 0, token[np.maximum(at[1:] - 1, 0)] if len(token) else -1, ptr[:-1] - 1)
        self.end_gap = ptr[1:] - last - 1

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, max(self.width, 1)))
        out[self.row, self.column] = values
        return out

    def marginals(self, scores: np.ndarray, shape: np.ndarray, backward: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of each telling token, and each text's log partition sum.

        ``shape``: bias, and the scores of going clean to toxic, toxic to clean, and
        staying toxic; staying clean scores 0, and a text begins after a clean token.
        Without the backward pass only the partition sums are right.
        """
        bias, into, out, stay = shape
        step = np.exp(np.array([[0.0, into], [out, stay]]))
        plain = step * np.exp([0.0, bias])
        half, spread = (plain[0, 0] + plain[1, 1]) / 2, np.sqrt(((plain[0, 0] - plain[1, 1]) / 2) ** 2 + plain[0, 1] * plain[1, 0])
        big, small = half + spread, half - spread
        top = (plain - small * np.eye(2)) / (big - small)
        rest = np.eye(2) - top

        def across(n: np.ndarray) -> np.ndarray:
            """The matrix of a gap of n plain tokens, over its largest eigenvalue to the n."""
            return top + (small / big) ** n[:, None, None] * rest

        emission = np.exp(np.clip(self.spread(scores) + bias, -30, 30))
        log_z = np.zeros(self.rows)
        ahead = np.zeros((self.width, self.rows, 2))
        v = np.zeros((self.rows, 2))
        v[:, 0] = 1
        for k in range(self.width):
            live = np.flatnonzero(self.length > k)
            gap = self.gap[live, k]
            x = np.einsum("ri,rij->rj", v[live], across(gap)) @ step
            x[:, 1] *= emission[live, k]
            total = x.sum(axis=1)
            v[live] = x / total[:, None]
            log_z[live] += np.log(total) + gap * np.log(big)
            ahead[k, live] = v[live]
        tail = np.einsum("ri,rij->rj", v, across(self.end_gap))
        log_z += np.log(tail.sum(axis=1)) + self.end_gap * np.log(big)

        p = np.zeros((self.rows, max(self.width, 1)))
        if not backward:
            return p[self.row, self.column], log_z
        u = across(self.end_gap).sum(axis=2)
        for k in range(self.width - 1, -1, -1):
            live = np.flatnonzero(self.length > k)
            both = ahead[k, live] * u[live]
            p[live, k] = both[:, 1] / both.sum(axis=1)
            x = u[live].copy()
            x[:, 1] *= emission[live, k]
            x = np.einsum("rij,rj->ri", across(self.gap[live, k]), x @ step.T)
            u[live] = x / x.sum(axis=1)[:, None]
        return p[self.row, self.column], log_z

    def gold(self, toxic: np.ndarray, scores: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Each text's log score of the labelled path; plain tokens are clean."""
        bias, into, out, stay = shape
        moves = np.array([[0.0, into], [out, stay]])
        total = np.bincount(self.row, weights=toxic * (scores + bias), minlength=self.rows)
        if len(toxic):
            gap = self.gap[self.row, self.column]
            before = np.where((self.column > 0) & (gap == 0), np.append(0, toxic[:-1]), 0)
            total += np.bincount(self.row, weights=moves[before, toxic], minlength=self.rows)
            # a toxic token followed by a plain one
            follows = np.append(self.row[1:] == self.row[:-1], False)
            next_gap = np.where(follows, np.append(gap[1:], 0), self.end_gap[self.row])
            total += np.bincount(self.row, weights=out * toxic * (next_gap > 0), minlength=self.rows)
        return total


def _learn_field(docs: list[tuple[list[np.ndarray], np.ndarray]], toxic: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Features, weights and shape from ``(features by kind, ptr)`` of one-text slices."""
    seen = [np.unique(np.concatenate(kinds)) for kinds, _ in docs]
    every = lambda flag: np.concatenate([s for s, t in zip(seen, toxic) if t == flag] or [np.zeros(0, dtype=U64)])
    features, bad = np.unique(every(1), return_counts=True)
    clean, good = np.unique(every(0), return_counts=True)
    at = np.minimum(np.searchsorted(clean, features), max(len(clean) - 1, 0))
    good_of = np.where(clean[at] == features, good[at], 0) if len(clean) else np.zeros(len(features))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good_of + 0.5) / ((1 - toxic).sum() + 1))
    kept = np.flatnonzero((features != 0) & (bad >= LEAST_DOCS) & (odds >= LEAST_LOG_ODDS))
    kept = kept[np.argsort(-odds[kept] * np.log1p(bad[kept]), kind="stable")[:MOST_FEATURES]]
    weights = Weights(features[kept], odds[kept])
    odds_of = weights.weights.copy()

    tokens, numbers, ptr, labels = [], [], [0], []
    for (kinds, one), is_toxic in zip(docs, toxic):
        token, number = weights.find(kinds)
        tokens.append(token + ptr[-1])
        numbers.append(number)
        strong = np.zeros(one[-1], dtype=np.int64)
        strong[token[odds_of[number] >= TOXIC_LOG_ODDS]] = is_toxic
        labels.append(strong)
        ptr.append(ptr[-1] + int(one[-1]))
    token, number, label = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (tokens, numbers, labels))
    telling, place = np.unique(token, return_inverse=True)
    chains, y = Chains(telling, np.array(ptr)), label[telling] if len(telling) else telling
    if not len(telling) or not y.any():
        return Weights(np.zeros(0, dtype=U64), np.zeros(0)), np.array([-6.0, 0.0, 0.0, 0.0])

    theta, shape = 0.5 * odds_of, np.array([-4.0, -1.0, 0.0, 0.0])
    rate, square_t, square_s = 0.3, np.zeros(len(theta)), np.zeros(4)
    for _ in range(STEPS):
        scores = np.bincount(place, weights=theta[number], minlength=len(telling))
        p, log_z = chains.marginals(scores, shape)
        gradient = np.bincount(number, weights=(y - p)[place], minlength=len(theta)) - 0.1 * (theta - 0.5 * odds_of)
        value = (chains.gold(y, scores, shape) - log_z).sum()
        slope = np.zeros(4)
        for j in range(4):
            moved = shape.copy()
            moved[j] += 1e-4
            slope[j] = ((chains.gold(y, scores, moved) - chains.marginals(scores, moved, backward=False)[1]).sum() - value) / 1e-4
        slope -= 0.1 * shape
        square_t += gradient**2
        square_s += slope**2
        theta = theta + rate * gradient / np.sqrt(square_t + 1e-9)
        shape = shape + rate * slope / np.sqrt(square_s + 1e-9)
    return Weights(weights.features, theta), shape


def _tagged(weights: Weights, shape: np.ndarray, kinds: list[np.ndarray], ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Telling tokens, their marginals, and each text's evidence (three numbers)."""
    token, number = weights.find(kinds)
    telling, place = np.unique(token, return_inverse=True)
    scores = np.bincount(place, weights=weights.weights[number], minlength=len(telling))
    chains = Chains(telling, ptr)
    p, _ = chains.marginals(scores, shape)
    n = np.maximum(np.diff(ptr), 1)
    doubt = np.bincount(chains.row, weights=-np.log1p(-np.minimum(p, 0.999)), minlength=chains.rows)
    most = np.zeros(chains.rows)
    np.maximum.at(most, chains.row, p)
    rate = 100 * np.bincount(chains.row, weights=p, minlength=chains.rows) / n
    return telling, p, np.column_stack([np.log1p(doubt), most, np.log1p(rate)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, by Newton steps with a small penalty; none is negative but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.append(np.ones(x.shape[1] - 1), -3.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.05 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


class Model:
    def __init__(self, weights: Weights, shape: np.ndarray, fit: np.ndarray):
        self.weights, self.shape, self.fit = weights, shape, fit

    def scored(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Score and toxic spans (code points) of each text."""
        raw, offsets = text_column(texts)
        for lo, hi in slices(offsets):
            base = offsets[lo]
            part, edges = raw[base : offsets[hi]], offsets[lo : hi + 1] - base
            runs = _runs(part, edges)
            ptr = runs["ptr"]
            telling, p, evidence = _tagged(self.weights, self.shape, token_features(runs), ptr)
            scores = 1 / (1 + np.exp(-np.clip(evidence @ self.fit[:-1] + self.fit[-1], -30, 30)))
            points = np.append(0, np.cumsum((part & 0xC0) != 0x80))
            bad = telling[p >= 0.5]
            at = np.searchsorted(bad, ptr)
            for i in range(hi - lo):
                spans: list[tuple[int, int]] = []
                before = -2
                for t in bad[at[i] : at[i + 1]]:
                    s, e = (int(points[x] - points[edges[i]]) for x in (runs["start"][t], runs["end"][t]))
                    if t == before + 1:
                        spans[-1] = (spans[-1][0], e)
                    else:
                        spans.append((s, e))
                    before = t
                yield float(scores[i]), spans


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold.

    The sample is drawn by hash among texts of at most ``MOST_CHARS`` characters.  Two
    thirds train the field, one third fits the score; rows are weighted back to the shares
    of the classes among all labelled rows.  Without toxic (or clean) rows all scores are low
    (0.02).
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    picked = F.broadcast(picked.withColumnRenamed("doc_id", "_labelled"))  # bounded by the two limits
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") <= MOST_CHARS)
    sample = rows.join(picked, F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    toxic = np.array(sample["toxic"].to_pylist(), dtype=np.int64)
    if len(toxic) < 10 or len(set(toxic)) < 2:
        return Model(Weights(np.zeros(0, dtype=U64), np.zeros(0)), np.array([-6.0, 0.0, 0.0, 0.0]), np.array([0.0, 0.0, 0.0, -4.0]))
    documents = []
    for text in sample["text"].to_pylist():
        raw, offsets = text_column(pa.array([text]))
        runs = _runs(raw, offsets)
        documents.append((token_features(runs), runs["ptr"]))
    part = np.array([hash_third(i) for i in sample["doc_id"].to_pylist()])
    field = part < 2
    weights, shape = _learn_field([d for d, f in zip(documents, field) if f], toxic[field])
    rest = [d for d, f in zip(documents, field) if not f]
    y = toxic[~field]
    if len(set(y)) < 2:
        rest, y = documents, toxic
    evidence = np.concatenate([_tagged(weights, shape, kinds, ptr)[2] for kinds, ptr in rest])
    taken = np.bincount(toxic, minlength=2)
    back = np.array([shares.get(0, 1) / taken[0], shares.get(1, 1) / taken[1]])
    back = back / back.min()
    return Model(weights, shape, _logistic(evidence, y, back[y]))


def hash_third(doc_id: int) -> int:
    return int(mix(np.array([doc_id], dtype=np.int64).view(U64))[0] % U64(3))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row; null texts are empty.

    A score depends on the text alone.  ``spans`` lists start:end in code points of the
    tokens with a marginal of at least one half, neighbours joined.
    """
    ship_package()
    model = train(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(model.scored(batch.column(2)))
            scores = pa.array([s for s, _ in out], pa.float64())
            spans = pa.array([",".join(f"{a}:{b}" for a, b in x) for _, x in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, spans], ["doc_id", "held_out", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, spans string")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted"), "spans")
