"""Best-fit packing of tokenized documents: best-two-fit.

A sequence is filled greedily with the longest piece that fits, again and again.  If a
gap is left, its smallest piece is taken out when two unpacked pieces together fit the
widened gap more tightly.  Pieces are dealt to groups by a hash and packed group by
group, so no task sees more than its share; a group leaves one open sequence at most.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.llm.shared import durable
from mailvane.shipping import ship_package

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Pieces in a group, about; each is a few bytes.
GROUP_PIECES = 20_000
#: Words, and parts of words, whose ids a worker remembers; beyond it memory starts anew.
REMEMBERED = 1_000_000

_END = END_ID.to_bytes(4, "little")


#: Letters that are lower case and composed already, then punctuation: one or two tokens' worth
#: for the tokenizer, whatever stands around.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])*)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")


def _byte_characters() -> dict[int, str]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as they are, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Ids by word, found by ``learn`` the first time."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.learn(word)
        return ids


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit numbers, word by word.

    The tokenizer never joins across ASCII white space, so a text's ids are those of its
    words one after the other.  ASCII capitals are folded first, as the tokenizer does
    itself; a text with ``<|``, which may hold a special token, is left to it whole.
    Words of plain letters and punctuation go straight to its model, part by part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.words, self.parts = _Remembered(self._word), _Remembered(self._part)

    def _part(self, part: bytes) -> bytes:
        tokens = self.model.tokenize(part.decode("latin-1").translate(self.characters)) if part else []
        return array("I", [t.id for t in tokens]).tobytes()

    def _word(self, word: bytes) -> bytes:
        plain = _PLAIN.fullmatch(word)
        return self.parts[plain[1]] + self.parts[plain[2]] if plain else self._whole(word.decode())

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return self._whole(text)
        known = self.words
        return b"".join([known[w] for w in text.encode().lower().split()])


def _pieces(path: str | None, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(TOKENIZER)
        words = WordIds(where)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = words.ids(text or "") + _END
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((i, k, start, len(part) // 4, zlib.crc32(part)))
                who, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(who)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; lengths are 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    left = np.diff(bounds)  # unpacked pieces of each length
    # the longest unpacked length up to each length
    reach = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    taken = bounds[:-1].copy()
    number, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def use(n: int, by: int) -> None:
        nonlocal reach
        before = left[n] > 0
        left[n] -= by
        if (left[n] > 0) != before:
            reach = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    sequence = 0
    while reach[capacity]:
        held: list[int] = []
        gap = capacity
        while gap and reach[gap]:
            n = int(reach[gap])
            held.append(n)
            use(n, 1)
            gap -= n
        if gap and len(held) > 1 and reach[capacity]:
            small = min(held)
            wide = gap + small
            first = np.flatnonzero(left[: wide + 1] > 0)
            second = reach[wide - first]
            # a length that is left once cannot be both
            alone = (second == first) & (left[first] == 1)
            if alone.any():
                lower = np.where(first > 0, reach[np.maximum(first - 1, 0)], 0)
                second = np.where(alone, lower, second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                a = int(first[total.argmax()])
                b = int(second[total.argmax()])
                held.remove(small)
                use(small, -1)
                held += [a, b]
                use(a, 1)
                use(b, 1)
        at = 0
        for n in sorted(held, reverse=True):
            who = order[taken[n]]
            taken[n] += 1
            number[who], offset[who] = sequence, at
            at += n
        sequence += 1
    return number, offset


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        # the same order whatever the partitioning, so that a task run again agrees
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_two_fit(table["length"].to_numpy(), capacity)
        group = table["pack_group"].to_numpy()
        table = table.append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))
        return table.drop_columns(["pack_group"])

    return pack


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A text's ids end with ``END_ID``; a null or empty text has only that one.  Longer
    texts are cut into pieces of ``capacity`` ids, the last may be shorter.  Rows that
    repeat an id are documents of their own, and null ids stay null.  Full pieces are
    sequences by themselves but go the same way.  An empty table gives an empty result.
    """
    ship_package()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(tokenizer_path, capacity), _PIECE))
    groups = max(1, pieces.count() // GROUP_PIECES)
    # the row number keeps pieces that are equal in all columns from meeting in one group
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    return pieces.withColumn("pack_group", dealt).groupBy("pack_group").applyInArrow(_pack(capacity), f"{_PIECE}, sequence_id long, offset long")
