"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, and long lines at words chosen by their hash, so
that an edit changes only the paragraphs around it.  Each paragraph's digest is added to
three cells of a sketch.  Two sketches are subtracted cell by cell and the difference is
peeled: a cell with one digest gives it away, and taking it out opens others.  When
peeling gets stuck, both texts are sketched again, larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.llm.wordhash import U64, mix, slices, text_column, word_runs
from mailvane.shipping import ship_package

#: Cells of a fingerprint, in three parts; a digest has one cell in each.
CELLS = 15
GROWTH = 8
#: One word in so many ends a paragraph within a line.
WORDS_A_PARAGRAPH = 16
#: Neighbouring documents that are handled together, about; more of them once there are many
#: runs, but never above ``MOST_ROWS``.
RUN_ROWS = 2000
MANY_RUNS = 4096
MOST_ROWS = 20_000

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, U64(base), dtype=U64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def paragraph_digests(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the distinct digests of its paragraphs, sorted; white space does not count."""
    raw, offsets = text_column(texts)
    for lo, hi in slices(offsets):
        base = offsets[lo]
        part = raw[base : offsets[hi]]
        runs = word_runs(part, offsets[lo : hi + 1] - base, lower=False)
        h, ptr = runs["hash"], runs["ptr"]
        n = len(h)
        if not n:
            yield from (np.zeros(0, dtype=U64) for _ in range(lo, hi))
            continue
        lines = np.append(0, np.cumsum(part == 10))
        ends = np.zeros(n, dtype=bool)
        ends[:-1] = lines[runs["start"][1:]] > lines[runs["end"][:-1]]
        ends |= (h >> U64(7)) % U64(WORDS_A_PARAGRAPH) == 0
        ends[ptr[1:][ptr[1:] > ptr[:-1]] - 1] = True
        stop = np.flatnonzero(ends) + 1
        begin = np.append(0, stop[:-1])
        sums = np.append(U64(0), np.cumsum(h * _powers(_STEP, n)))
        digest = mix((sums[stop] - sums[begin]) * _powers(_BACK, n + 1)[begin] + (stop - begin).astype(U64))
        first = np.searchsorted(begin, ptr, "left")
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(digest[a:b])


class Sketches:
    """A sketch for each of ``rows`` texts: counts, digests and checks of ``cells`` cells.

    Digests and checks are folded by exclusive or.  ``row`` is the text of each digest.
    """

    def __init__(self, rows: int, cells: int, row: np.ndarray, digests: np.ndarray):
        self.shape = (rows, cells)
        self.count = np.zeros(rows * cells, dtype=np.int64)
        self.digest = np.zeros(rows * cells, dtype=U64)
        self.check = np.zeros(rows * cells, dtype=U64)
        self._put(row, digests, np.ones(len(digests), dtype=np.int64))

    def _put(self, row: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        cells = self.shape[1]
        part, check = cells // 3, _check(digests)
        for k in range(3):
            at = row * cells + (mix(digests + U64(101 + k)) % U64(part)).astype(np.int64) + k * part
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, digests)
            np.bitwise_xor.at(self.check, at, check)

    def less(self, other: Sketches) -> Sketches:
        none = np.zeros(0, dtype=np.int64)
        out = Sketches(*self.shape, none, none.astype(U64))
        out.count = self.count - other.count
        out.digest = self.digest ^ other.digest
        out.check = self.check ^ other.check
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, digest and side (1 first, -1 second) of all that came out, and which texts peeled to the end."""
        rows, digests, sides = [], [], []
        # a digest taken out wrongly would put others in; a right run ends well before
        for _ in range(3 * self.shape[1] + 8):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.check[pure] == _check(self.digest[pure])]
            if not len(pure):
                break
            row, digest, side = pure // self.shape[1], self.digest[pure], self.count[pure]
            order = np.lexsort((digest, row))
            row, digest, side = row[order], digest[order], side[order]
            first = np.ones(len(row), dtype=bool)
            first[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            row, digest, side = row[first], digest[first], side[first]
            rows.append(row)
            digests.append(digest)
            sides.append(side)
            self._put(row, digest, -side)
        open_cells = (self.count != 0) | (self.digest != 0) | (self.check != 0)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return join(rows, np.int64), join(digests, U64), join(sides, np.int64), ~open_cells.reshape(self.shape).any(axis=1)

    def texts(self) -> list[str]:
        """Each text's fingerprint: its cells' counts, digests and checks."""
        parts = (x.reshape(self.shape).astype(kind) for x, kind in ((self.count, "<i4"), (self.digest, "<u8"), (self.check, "<u4")))
        return [base64.b64encode(b"".join(p.tobytes() for p in row)).decode() for row in zip(*parts)]


def _check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ U64(0x5DEECE66D)) & U64(0xFFFFFFFF)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return row, np.concatenate(sets) if sets else np.zeros(0, dtype=U64)


def differing(first: list[np.ndarray], second: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what is only in the first and only in the second.

    Recovered from sketches that grow, for the pairs that need it, until they peel.
    """
    found: list = [None] * len(first)
    todo, cells = np.arange(len(first)), CELLS
    while len(todo):
        a, b = [first[i] for i in todo], [second[i] for i in todo]
        if cells > 64 * (max(map(len, a)) + max(map(len, b)) + GROWTH):
            # not seen in practice: the same three cells for several digests at every size
            for i in todo:
                found[i] = (np.setdiff1d(first[i], second[i]), np.setdiff1d(second[i], first[i]))
            break
        left, right = (Sketches(len(todo), cells, *_flat(x)) for x in (a, b))
        row, digest, side, done = left.less(right).peeled()
        order = np.argsort(row, kind="stable")
        row, digest, side = row[order], digest[order], side[order]
        edges = np.searchsorted(row, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done):
            d, s = digest[edges[k] : edges[k + 1]], side[edges[k] : edges[k + 1]]
            found[todo[k]] = (d[s > 0], d[s < 0])
        todo, cells = todo[~done], cells * GROWTH
    return found


def likeness(first: list[np.ndarray], second: list[np.ndarray]) -> list[float]:
    """Share of paragraphs that each two texts have in common; 1 for two empty texts."""
    out = []
    for a, (ours, theirs) in zip(first, differing(first, second)):
        common = len(a) - len(ours)
        every = common + len(ours) + len(theirs)
        out.append(common / every if every else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The second half of ``text`` replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(doc_id, text, next text)`` from rows sorted by run, guest last; a run's guest is its successor's first row."""
    held, held_run = None, None
    for batch in batches:
        for run, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text"))):
            if guest:
                if held is not None and held_run == run:
                    yield *held, text
                    held = None
                continue
            if held is not None and held_run == run:
                yield *held, text
            held, held_run = (doc_id, text), run
    if held is not None:
        yield *held, held[1]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def some() -> Iterator[list[tuple]]:
        rows, size = [], 0
        for row in _neighbour_rows(batches):
            rows.append(row)
            size += len(row[1]) + len(row[2])
            if len(rows) >= 256 or size > 1 << 20:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows

    for rows in some():
        changed = [edited(text, following) for _, text, following in rows]
        # a row's next text is the next row's own, but for the last
        own = list(paragraph_digests(pa.array([r[1] for r in rows] + [rows[-1][2]], pa.large_string())))
        new = list(paragraph_digests(pa.array(changed, pa.large_string())))
        after = own[1:]
        odd = [i for i, r in enumerate(rows[:-1]) if r[2] != rows[i + 1][1]]
        for i, digests in zip(odd, paragraph_digests(pa.array([rows[i][2] for i in odd], pa.large_string()))):
            after[i] = digests
        own = own[: len(rows)]
        out = list(
            zip(
                [r[0] for r in rows],
                [len(r[1]) for r in rows],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                Sketches(len(rows), CELLS, *_flat(own)).texts(),
                Sketches(len(rows), CELLS, *_flat(new)).texts(),
                likeness(own, new),
                likeness(own, after),
            )
        )
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in _OUT.split(", ")])


def _ordered(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes each, in the order of the pairs."""
    pairs = np.stack([keys, hashes], axis=1).astype(np.int64) ^ np.int64(-(2**63))
    return np.ascontiguousarray(pairs).astype(np.int64).view(U64).astype(">u8").reshape(-1).view("S16")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edit takes the second half from the next document by ascending id (after the last:
    the first; of one document: itself).  Null texts are empty.  Rows without an id come
    last; rows that repeat an id follow each other by a hash of their text.  An empty table
    gives an empty result.

    Documents are cut into runs of neighbours by id and hash, so rows of one id or of none
    make many runs (only equal rows stay together); the first row of each run goes to the
    run before as well, so texts are shuffled once.  A run streams through its task.
    """
    ship_package()
    last = 2**63 - 1
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(last))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.struct(key.alias("key"), F.xxhash64(text).alias("hash")).alias("at"))
    total = keys.count()
    runs = max(1, min(MANY_RUNS, total // RUN_ROWS), total // MOST_ROWS)
    # 16 bytes for each run, as a range partitioner keeps them
    lows = keys.repartitionByRange(runs, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("low")).select("low.*").toPandas()
    firsts = np.sort(_ordered(lows["key"].to_numpy("int64"), lows["hash"].to_numpy("int64")))
    n = max(1, len(firsts))

    @F.pandas_udf("long")
    def place(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the run, plus one if the row is its first."""
        own = _ordered(keys.to_numpy(), hashes.to_numpy())
        at = np.maximum(np.searchsorted(firsts, own, "right") - 1, 0)
        return pd.Series(2 * at + (firsts[at] == own))

    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("_place", place("key", "hash"))
    run = F.expr("_place div 2")
    own = F.struct(run.alias("run"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(run - 1, F.lit(n)).alias("run"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("_at", F.explode(F.when(F.col("_place") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("_at.run", "_at.guest", "key", "hash", "doc_id", "text").repartition(n, "run")
    ordered = dealt.sortWithinPartitions("run", "guest", "key", "hash", "text").select("run", "guest", "doc_id", "text")
    return ordered.mapInArrow(_fingerprints, _OUT)
