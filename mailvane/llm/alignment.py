"""Alignment of two tokenizers over the same bytes: interval coalescing.

All tokens of both sides, as byte ranges, are sorted by start; the running maximum of
their ends shows where a group breaks, which is where a start reaches it.  Within a
group every pair of overlapping tokens is a link.  A batch of documents is one run of
bytes, so it is coalesced at once: two documents never overlap.

Counts of linked id pairs are taken over all documents.  The most frequent pairs, at
most ``HOT_PAIRS``, are looked up in place; what is left is joined, and none of those
keys is frequent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.llm.shared import durable
from mailvane.shipping import ship_package

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Pairs that every task may hold for looking up (17 bytes each).
HOT_PAIRS = 2_000_000
#: Text that is coalesced at once, about; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20

#: How the byte-level vocabulary splits a text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Side A: byte-level merges read from a vocabulary file; special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of_character()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        made = [ranks[bytes(byte_of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.encoding = tiktoken.Encoding("side-a", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(" " + t), dtype=np.int64) for t in texts]


class Pieces:
    """Side B: pieces with byte fallback; the model puts the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.model.id_to_piece(list(range(n))))
        ]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.int64) for x in self.model.encode(texts, num_threads=1)]


class _Side:
    """A tokenizer with what its tokens weigh and how their ids are written."""

    def __init__(self, tokenizer, ends: tuple[str, ...]):
        self.ids, n = tokenizer.ids, len(tokenizer.tokens)
        self.length = np.array([len(t) for t in tokenizer.tokens], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokenizer.tokens), dtype=np.uint8)
        width = len(str(n - 1)) + 1
        self.written = np.array([[f"{i}{e}".encode() for e in ends] for i in range(n)], dtype=f"S{width}")
        self.count = n

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        length = self.length[ids]
        shift = self.first[ids] - (np.cumsum(length) - length)
        return self.bytes[np.arange(length.sum()) + np.repeat(shift, length)]

    def text(self, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.written[ids, end]


_COMMA, _BAR_OR_SEMICOLON, _NOTHING = 0, 1, 2


@lru_cache(maxsize=4)
def _sides(a_path: str | None, b_path: str | None) -> tuple[_Side, _Side]:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path(TOKENIZER_A), b_path or public_tokenizers.path(TOKENIZER_B)
    return _Side(ByteLevel(a_path), (",", "|", "")), _Side(Pieces(b_path), (",", ";", ""))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; a run may be empty."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    at = np.r_[0, np.cumsum(counts)]
    return total[at[1:]] - total[at[:-1]]


def groups_of(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A token and every B token, from 0; both sides cover the same bytes."""
    end = np.concatenate([np.cumsum(a_len), np.cumsum(b_len)])
    start = end - np.concatenate([a_len, b_len])
    side = np.repeat([0, 1], [len(a_len), len(b_len)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.r_[False, start[order][1:] >= reached[:-1]]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_len)], group[len(a_len) :]


def links_of(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all overlapping tokens, A and B; what overlaps a token is one run of the other side."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    low = np.searchsorted(b_end, a_end - a_len, side="right")
    n = np.searchsorted(b_end - b_len, a_end, side="left") - low
    return np.repeat(np.arange(len(a_len)), n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


class _Batch:
    """Some documents as one run of bytes: token ids, lengths, and the document of each token."""

    def __init__(self, texts: list[str | None], a: _Side, b: _Side):
        self.a, self.b, self.n = a, b, len(texts)
        held = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        given = [texts[i] for i in held]
        a_ids, b_ids = a.ids(given), b.ids(given)
        raw = [b" " + t.encode() for t in given]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        fine = np.array([a.length[x].sum() == s == b.length[y].sum() for x, y, s in zip(a_ids, b_ids, size)], dtype=bool)
        keep = np.flatnonzero(fine)
        if len(keep):
            same = np.frombuffer(b"".join([raw[i] for i in keep]), dtype=np.uint8)
            spelled = lambda side, ids: side.spelled(np.concatenate([ids[i] for i in keep]))
            wrong = (spelled(a, a_ids) != same) | (spelled(b, b_ids) != same)
            keep = keep[_sums(wrong, size[keep]) == 0]
        self.a_count, self.b_count = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        self.a_count[held[keep]] = [len(a_ids[i]) for i in keep]
        self.b_count[held[keep]] = [len(b_ids[i]) for i in keep]
        none = np.zeros(0, dtype=np.int64)
        self.a_ids = np.concatenate([none, *[a_ids[i] for i in keep]])
        self.b_ids = np.concatenate([none, *[b_ids[i] for i in keep]])
        self.a_len, self.b_len = a.length[self.a_ids], b.length[self.b_ids]
        self.a_group, self.b_group = groups_of(self.a_len, self.b_len)
        first = np.r_[True, self.a_group[1:] != self.a_group[:-1]][: len(self.a_group)]
        self.group_count = _sums(first, self.a_count)

    def digests(self) -> list[str]:
        """Of each document, the hash of its groups as they are written out."""
        last = lambda g: np.r_[g[1:] != g[:-1], True][: len(g)]
        a_last, b_last = last(self.a_group), last(self.b_group)
        b_end = np.where(b_last, _BAR_OR_SEMICOLON, _COMMA)
        b_end[np.cumsum(self.b_count)[self.b_count > 0] - 1] = _NOTHING
        a_text = self.a.text(self.a_ids, np.where(a_last, _BAR_OR_SEMICOLON, _COMMA))
        b_text = self.b.text(self.b_ids, b_end)
        # a group's A tokens, then its B tokens: each token goes behind all of the other side that come before it
        b_before = np.searchsorted(self.b_group, self.a_group, side="left")
        a_before = np.searchsorted(self.a_group, self.b_group, side="right")
        out = np.empty(len(a_text) + len(b_text), dtype=f"S{max(a_text.dtype.itemsize, b_text.dtype.itemsize)}")
        out[np.arange(len(a_text)) + b_before] = a_text
        out[np.arange(len(b_text)) + a_before] = b_text
        cells = out.view(np.uint8).reshape(len(out), -1) if len(out) else np.zeros((0, 1), np.uint8)
        sizes = _sums((cells != 0).sum(axis=1), self.a_count + self.b_count)
        flat = cells[cells != 0]
        at = np.r_[0, np.cumsum(sizes)]
        return [hashlib.sha256(flat[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:])]

    def links(self):
        """Link count of each document, and its distinct linked pairs with how often: counts, codes, times."""
        at_a, at_b = links_of(self.a_len, self.b_len)
        of = np.repeat(np.arange(self.n), self.a_count)[at_a]
        space = self.a.count * self.b.count
        keys, times = np.unique(of * space + self.a_ids[at_a] * self.b.count + self.b_ids[at_b], return_counts=True)
        return np.bincount(of, minlength=self.n), np.bincount(keys // space, minlength=self.n), keys % space, times


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``BATCH_BYTES`` of text."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = (np.cumsum(size + 64) - 1) // BATCH_BYTES
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(lo, hi - lo)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), values).cast(pa.list_(values.type))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package()
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"


def linked(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its counts and its distinct linked id pairs, written to the shared folder.

    ``codes`` are the pairs (A id times the size of B's vocabulary, plus B id), ``times``
    how often each is linked in the document; ``row`` numbers the rows.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(a_path, b_path)
        for whole in batches:
            for rows in _slices(whole, 2):
                batch = _Batch(rows.column(2).to_pylist(), a, b)
                n_links, n_codes, codes, times = batch.links()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(batch.a_count), pa.array(batch.b_count),
                        pa.array(batch.group_count), pa.array(n_links), pa.array(batch.digests(), pa.string()),
                        _lists(n_codes, pa.array(codes)), _lists(n_codes, pa.array(times)),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"],
                )

    numbered = _documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return durable(numbered.mapInArrow(align, _LINKED))


_GROUP = "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>"


def token_groups(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The groups themselves: ``doc_id, group`` (from 0), byte range in space+text, ids of both sides in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(a_path, b_path)
        for whole in batches:
            for rows in _slices(whole, 1):
                x = _Batch(rows.column(1).to_pylist(), a, b)
                n = int(x.group_count.sum())
                of = np.repeat(np.arange(x.n), x.group_count)
                number = np.arange(n) - np.repeat(np.cumsum(x.group_count) - x.group_count, x.group_count)
                a_n, b_n = np.bincount(x.a_group, minlength=n), np.bincount(x.b_group, minlength=n)
                end = np.cumsum(_sums(x.a_len, a_n))
                size = _sums(_sums(x.a_len, a_n), x.group_count)  # bytes of each document
                base = np.repeat(np.cumsum(size) - size, x.group_count)
                start = np.r_[0, end[:-1]][:n]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(of)), pa.array(number), pa.array(start - base), pa.array(end - base),
                        _lists(a_n, pa.array(x.a_ids.astype(np.int32))), _lists(b_n, pa.array(x.b_ids.astype(np.int32))),
                    ],
                    ["doc_id", "group", "start", "end", "a_ids", "b_ids"],
                )

    return _documents(docs, id_col, text_col).mapInArrow(cut, _GROUP)


def pair_counts(linked_docs: DataFrame, b_count: int) -> DataFrame:
    """``code, n, best``: documents that hold a pair, and whether no pair of its A id is held by more."""
    pairs = durable(linked_docs.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    a_id = F.expr(f"code div {b_count}L")
    highest = pairs.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))  # one row per id of A's vocabulary
    return pairs.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


_REPORT = "n_best long, count_sum long"
_DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(linked_docs: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds the sums over the pairs in ``hot``, and ``cold``, the pairs that are not there."""
    t = hot.orderBy("code").toArrow()
    column = lambda name: t[name].combine_chunks().to_numpy(zero_copy_only=False)
    shared = linked_docs.sparkSession.sparkContext.broadcast((column("code"), column("n"), column("best")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                rows = whole.slice(at, 1024)
                held = np.asarray(rows.column("codes").value_lengths().fill_null(0), dtype=np.int64)
                codes, times = rows.column("codes").flatten().to_numpy(), rows.column("times").flatten().to_numpy()
                place = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
                known = code[place] == codes if len(code) else np.zeros(len(codes), bool)
                count = np.where(known, n[place], 0) if len(code) else np.zeros(len(codes), np.int64)
                top = known & best[place] if len(code) else known
                cold = _sums(~known, held)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(c) for c in ("row", *_DIGEST[:5], "groups_sha256")],
                        pa.array(_sums(np.where(top, times, 0), held)), pa.array(_sums(count * times, held)),
                        _lists(cold, pa.array(codes[~known])), _lists(cold, pa.array(times[~known])),
                    ],
                    ["row", *_DIGEST[:5], "groups_sha256", "n_best", "count_sum", "cold", "cold_times"],
                )

    out = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return linked_docs.mapInArrow(look, f"{out}, {_REPORT}, cold array<long>, cold_times array<long>")


def alignment_report(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose pair no pair of the same A id exceeds, ``count_sum``
    adds up, over all links, in how many documents their pair is linked.  A text that is
    null or empty, or that its tokens do not spell (B writes U+2581 as a space), has no tokens:
    zeros and an empty digest.  Every row is a document of its own, also where ids or
    texts repeat; null ids stay null; other columns are not read.  Texts are encoded
    whole, however long.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = linked(docs, a_path, b_path, id_col, text_col)
    b_count = len(_sides(a_path, b_path)[1].length)
    pairs = durable(pair_counts(rows, b_count))
    n_pairs, total = pairs.agg(F.count(F.lit(1)), F.sum("n")).first()
    # fewer than hot_pairs pairs can be held by so many documents each
    least = 1 if n_pairs <= hot_pairs else total // hot_pairs + 1
    found = _looked_up(rows, pairs.where(F.col("n") >= least))
    if least == 1:
        return found.select(*_DIGEST)
    found = durable(found)
    cold = found.select("row", F.explode(F.arrays_zip("cold", "cold_times")).alias("c")).select("row", F.col("c.cold").alias("code"), F.col("c.cold_times").alias("times"))
    rest = cold.join(pairs.where(F.col("n") < least), "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return found.join(rest, "row", "left").select(
        *_DIGEST[:5], plus("n_best", F.col("more_best")), plus("count_sum", F.col("more_sum")), "groups_sha256"
    )
