"""Removal of repeated byte strings: distributed prefix doubling over what winnowing leaves.

Winnowing drops most places that no other document shares, in blocks of documents:

* 24 bytes: only anchors are named.  The anchor of a 50-byte string is the place of its
  least 24-byte hash, so equal strings have equal anchors; about one byte in 14 is one.
  Anchors whose name is in one document only are done.
* Anchors left are named by all strings that share them, joined into one context of up to
  76 bytes.  Equal contexts settle all their strings at once: the first document keeps.
* Where contexts differ under one anchor, a string stays open if other contexts also have
  the anchor with those of the 7, 13 and 19 bytes before and after it that the string holds.

Prefix doubling settles the open strings.  Their places carry the names of 24 bytes as
first ranks.  Spark sorts the pairs of ranks at offset 24 and numbers them: ranks of 48
bytes.  Places with a rank of their own are dropped; the others are sorted by place, paired
at offset 2, past the threshold of 50, sorted and ranked again; each rank's smallest
document keeps.  A block sends each distinct string once, so a string that very many
documents hold is one row a block in the sort.  Names are 64-bit hashes, so two ranks are
equal where 128 bits are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailvane.llm.wordhash import U64, Prefix, mix, text_column
from mailvane.shipping import ship_package

WINDOW = 50
ANCHOR = 24
SPAN = WINDOW - ANCHOR + 1
#: Lengths beside the anchor; what a string holds before and after it adds up to 26 bytes.
SIDES = (7, 13, 19)
_PIECE = 1 << 18
_PLACE = (1 << 20) - 1

#: Text in a block, and text whose names are one bucket, about.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Level of zstd at which texts are shuffled.
TEXT_LEVEL = 5

_MESSAGE = "bucket long, block long, names binary"
_ANSWER = "block long, kind int, names binary"


class Anchors:
    """Anchors of the texts of a block, with the strings that share each."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        docs, firsts, lasts, places, names, contexts, sides, windows = [], [], [], [], [], [], [], []
        for piece_docs, starts, ends in _pieces(offsets):
            base, top = starts[0], ends[-1]
            part = raw[base:top]
            if len(part) < WINDOW:
                continue
            sums = Prefix(part)
            count = len(part) - ANCHOR + 1
            at = np.arange(count)
            name = sums.of(at, at + ANCHOR)
            least = (name & U64(~_PLACE & (2**64 - 1))) | at.astype(U64)
            size = 1
            while size * 2 <= SPAN:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
            whole = np.zeros(len(least), dtype=bool)
            for s, e in zip(starts - base, ends - base):
                whole[s : max(s, e - WINDOW + 1)] = True
            start = np.flatnonzero(whole)
            if not len(start):
                continue
            place = (least[start] & U64(_PLACE)).astype(np.int64)
            fresh = np.ones(len(start), dtype=bool)
            fresh[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            first = start[fresh]
            last = start[np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)]
            firsts.append(first + base)
            lasts.append(last + base)
            at = place[fresh]
            places.append(at + base)
            names.append(name[at])
            contexts.append(sums.of(first, last + WINDOW))
            # where a context ends before, none of its strings holds these bytes
            left = [sums.of(np.maximum(at - n, first), at + ANCHOR) for n in SIDES]
            right = [sums.of(at, np.minimum(at + ANCHOR + n, last + WINDOW)) for n in SIDES]
            sides.append(np.stack([(x & U64(0xFF)).astype(np.uint8) for x in left + right], axis=1))
            docs.append(piece_docs[np.searchsorted(starts - base, first, "right") - 1])
            windows.append((sums, base, len(first)))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.doc, self.first, self.last = join(docs, np.int64), join(firsts, np.int64), join(lasts, np.int64)
        self.place, self.name, self.context = join(places, np.int64), join(names, U64), join(contexts, U64)
        self.sides = np.concatenate(sides) if sides else np.zeros((0, 2 * len(SIDES)), dtype=np.uint8)
        self._windows, self._ends = windows, np.cumsum([w[2] for w in windows])

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, start and name of every string of the anchors ``which`` (sorted numbers)."""
        n = self.last[which] - self.first[which] + 1
        start = np.repeat(self.first[which] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        anchor = np.repeat(which, n)
        return anchor, start, self.names(anchor, start, WINDOW)

    def names(self, anchor: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Names of ``length`` bytes from each ``start``, which is within the context of its ``anchor`` (sorted)."""
        out = np.zeros(len(start), dtype=U64)
        edges = np.searchsorted(anchor, np.append(0, self._ends))
        for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                sums, base, _ = self._windows[part]
                out[lo:hi] = sums.of(start[lo:hi] - base, start[lo:hi] - base + length)
        return out


def _pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``_PIECE`` bytes; a longer text is cut so that no string is lost."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        if offsets[lo + 1] - offsets[lo] > _PIECE:
            for at in range(offsets[lo], offsets[lo + 1], _PIECE):
                yield np.array([lo]), np.array([at]), np.array([min(at + _PIECE + WINDOW - 1, offsets[lo + 1])])
            lo += 1
            continue
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= _PIECE:
            hi += 1
        yield np.arange(lo, hi), offsets[lo:hi], offsets[lo + 1 : hi + 1]
        lo = hi


_TEXTS = "block long, doc_id array<long>, mark array<long>, size array<long>, texts binary"


def _texts_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch that go to one block as one compressed row; they are most of what is shuffled."""
    codec = pa.Codec("zstd", compression_level=TEXT_LEVEL)
    for batch in batches:
        block, ids, mark = (batch[c].to_numpy() for c in ("block", "doc_id", "mark"))
        raw, offsets = text_column(batch["text"])
        size = np.diff(offsets)
        order = np.argsort(block, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
        rows = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x[order], pa.int64()))
        texts = [codec.compress(_gathered(raw, offsets, r).tobytes(), asbytes=True) for r in rows]
        columns = [pa.array(block[order][edges[:-1]], pa.int64()), lists(ids), lists(mark), lists(size), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "mark", "size", "texts"])


def _gathered(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([raw[:0], *(raw[offsets[i] : offsets[i + 1]] for i in rows)])


def _block(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, ids, bytes and offsets of a block, in an order that does not depend on how its rows arrive."""
    if not table.num_rows:
        return -1, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
    ids, mark, size = flat("doc_id"), flat("mark"), flat("size")
    whole = [sum(x) for x in table["size"].to_pylist()]
    parts = [np.frombuffer(pa.decompress(t, n, codec="zstd"), dtype=np.uint8) for t, n in zip(table["texts"].to_pylist(), whole)]
    offsets = np.append(0, np.cumsum(size))
    order = np.lexsort((size, mark, ids))
    raw = _gathered(np.concatenate(parts), offsets, order)
    return table["block"][0].as_py(), ids[order], raw, np.append(0, np.cumsum(size[order]))


def _packed(records: np.ndarray) -> bytes:
    """Field after field, which the shuffle compresses better than record after record."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    out, at = np.empty(len(blob) // kind.itemsize, dtype=kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(blob, dtype=kind[f], count=len(out), offset=at)
        at += len(out) * kind[f].itemsize
    return out


def _records(table: pa.Table, kind: np.dtype) -> np.ndarray:
    parts = [_unpacked(x, kind) for x in table["names"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _dealt(block: int, records: np.ndarray, by: np.ndarray, buckets: int) -> pa.Table:
    """Messages of one block: its records by bucket, and by document where they have one."""
    bucket = ((by >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((records["doc"], bucket)) if "doc" in records.dtype.names else np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    names = [_packed(records[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"bucket": pa.array(bucket[edges[:-1]], pa.int64()), "block": pa.array([block] * len(names), pa.int64()), "names": pa.array(names, pa.binary())})


def _answers(blocks: list, kind: int, parts: list[np.ndarray]) -> pa.Table:
    some = [(b, _packed(p)) for b, p in zip(blocks, parts) if len(p)]
    return pa.table({"block": pa.array([b for b, _ in some], pa.int64()), "kind": pa.array([kind] * len(some), pa.int32()), "names": pa.array([p for _, p in some], pa.binary())})


#: 48 bits are enough to leave out unique names; what is left is compared by 64.
_SHORT = np.dtype([("low", "<u4"), ("high", "<u2")])
_CONTEXT = np.dtype([*_SHORT.descr, ("context", "<u8"), ("doc", "<i8"), *((f"side{k}", "u1") for k in range(2 * len(SIDES)))])
_SETTLED = np.dtype([("context", "<u8"), ("doc", "<i8"), ("mixed", "u1")])
_STRING = np.dtype([("name", "<u8"), ("doc", "<i8")])



def _short(name: np.ndarray) -> np.ndarray:
    """The upper 32 bits, by which buckets are dealt, and the lowest 16."""
    out = np.empty(len(name), dtype=_SHORT)
    out["low"] = (name >> U64(32)).astype(np.uint32)
    out["high"] = (name & U64(0xFFFF)).astype(np.uint16)
    return out


def _shortened(number: np.ndarray) -> np.ndarray:
    out = np.empty(len(number), dtype=_SHORT)
    out["low"], out["high"] = (number >> U64(16)).astype(np.uint32), (number & U64(0xFFFF)).astype(np.uint16)
    return out


def _number(short: np.ndarray) -> np.ndarray:
    return (short["low"].astype(U64) << U64(16)) | short["high"].astype(U64)


def _send_anchors(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block, ids, raw, offsets = _block(table)
        found = Anchors(ids, raw, offsets)
        short = _number(_short(found.name))
        # once for each document, so a name seen twice is in two documents
        order = np.lexsort((ids[found.doc], short))
        s, d = short[order], ids[found.doc][order]
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        s = s[keep]
        again = np.zeros(len(s), dtype=int)
        again[1:] = s[1:] == s[:-1]
        # twice is as good as more
        twice = again.copy()
        twice[1:] = again[1:] * (again[:-1] + 1)
        s = s[twice < 2]
        return _dealt(block, _shortened(s), s << U64(16), buckets)

    return send


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Names that are in two documents, to every block that has them."""
    blocks = table["block"].to_pylist()
    parts = [_number(_unpacked(x, _SHORT)) for x in table["names"].to_pylist()]
    every = np.sort(np.concatenate(parts))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    return _answers(blocks, 1, [_shortened(np.unique(p[_among(p, shared)])) for p in parts])


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _send_contexts(buckets: int):
    def send(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, ids, raw, offsets = _block(table)
        found = Anchors(ids, raw, offsets)
        shared = np.sort(_number(_records(answers, _SHORT)))
        short = _short(found.name)
        mine = np.flatnonzero(_among(_number(short), shared))
        records = np.empty(len(mine), dtype=_CONTEXT)
        records["low"], records["high"] = short["low"][mine], short["high"][mine]
        records["context"], records["doc"] = found.context[mine], ids[found.doc[mine]]
        for k in range(2 * len(SIDES)):
            records[f"side{k}"] = found.sides[mine, k]
        least = _least(records, "context")
        return _dealt(block, least, _number(least) << U64(16), buckets)

    return send


def _least(records: np.ndarray, by: str) -> np.ndarray:
    """For each value of ``by`` the record of the smallest document."""
    order = np.lexsort((records["doc"], records[by]))
    r = records[order]
    keep = np.ones(len(r), dtype=bool)
    keep[1:] = r[by][1:] != r[by][:-1]
    return r[keep]


def _settle_contexts(table: pa.Table) -> pa.Table:
    """First document of each context, and on which sides of its anchor another context is alike."""
    blocks = table["block"].to_pylist()
    parts = [_unpacked(x, _CONTEXT) for x in table["names"].to_pylist()]
    least = _least(np.concatenate(parts), "context")
    # 8 bits beside the 48 of the anchor's name: too many may stay open, none too few
    side = lambda r, k: (_number(r) << U64(8)) | r[f"side{k}"].astype(U64)
    alike = []
    for k in range(2 * len(SIDES)):
        names, contexts = np.unique(side(least, k), return_counts=True)
        alike.append(names[contexts > 1])
    out = []
    for p in parts:
        r = np.empty(len(p), dtype=_SETTLED)
        at = np.searchsorted(least["context"], p["context"])
        r["context"], r["doc"], r["mixed"] = p["context"], least["doc"][at], sum(_among(side(p, k), x).astype(np.uint8) << k for k, x in enumerate(alike))
        # a block knows by itself what it has first and alone
        out.append(r[(r["mixed"] > 0) | (r["doc"] < p["doc"])])
    return _answers(blocks, 2, out)


def _first_docs(found: Anchors, ids: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the first document with its context, and the sides on which strings are open."""
    local = np.empty(len(found.context), dtype=_STRING)
    local["name"], local["doc"] = found.context, ids[found.doc]
    least = _least(local, "name")
    first = least["doc"][np.searchsorted(least["name"], found.context)] if len(least) else np.zeros(0, dtype=np.int64)
    settled = _records(answers.filter(pa.compute.equal(answers["kind"], 2)), _SETTLED)
    settled = settled[np.argsort(settled["context"], kind="stable")]
    mixed = np.zeros(len(found.context), dtype=np.uint8)
    if len(settled):
        known = _among(found.context, settled["context"])
        at = np.searchsorted(settled["context"], found.context[known])
        first[known] = np.minimum(first[known], settled["doc"][at])
        mixed[known] = settled["mixed"][at]
    return first, mixed


def _open_strings(found: Anchors, ids: np.ndarray, first: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, start, document and number of every open string; of each number its first place, least document first."""
    anchor, start, name = found.strings(np.flatnonzero((mixed > 0) & (first == ids[found.doc])))
    before = found.place[anchor] - start
    sides = np.zeros(len(start), dtype=np.uint8)
    for k, n in enumerate(SIDES):
        sides |= np.where(before >= n, 1 << k, 0).astype(np.uint8)
        sides |= np.where(WINDOW - ANCHOR - before >= n, 1 << (k + len(SIDES)), 0).astype(np.uint8)
    stay = (mixed[anchor] & sides) == sides
    anchor, start, name = anchor[stay], start[stay], name[stay]
    doc = ids[found.doc[anchor]]
    order = np.lexsort((start, doc, name))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = name[order][1:] != name[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return anchor, start, doc, number, order[fresh]


_PLACES = "part long, block long, place array<int>, doc array<long>, a array<long>, b array<long>"
#: Between the ranks of two places 24 bytes apart, and from there to the whole string.
_CLOSE = WINDOW - 2 * ANCHOR


def _send_places(parts: int):
    """Places of the open strings, and those by which they are closed, with the names of 24 bytes there and 24 bytes on."""

    def send(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, ids, raw, offsets = _block(table)
        found = Anchors(ids, raw, offsets)
        anchor, start, doc, _, one = _open_strings(found, ids, *_first_docs(found, ids, answers))
        one = np.sort(one)  # by anchor
        place = np.concatenate([start[one], start[one] + _CLOSE])
        place, at = np.unique(place, return_index=True)
        at = one[at % max(len(one), 1)]
        order = np.argsort(anchor[at], kind="stable")
        place, at = place[order], at[order]
        a, b = (found.names(anchor[at], place + k, ANCHOR) for k in (0, ANCHOR))
        part = ((mix(a ^ (b << U64(1))) >> U64(32)) % U64(parts)).astype(np.int64)
        order = np.lexsort((place, part))
        part = part[order]
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x[order], kind))
        return pa.table(
            {
                "part": pa.array(part[edges[:-1]], pa.int64()),
                "block": pa.array(np.full(len(edges) - 1, block), pa.int64()),
                "place": lists(place.astype(np.int32), pa.int32()),
                "doc": lists(doc[at], pa.int64()),
                "a": lists(a.view(np.int64), pa.int64()),
                "b": lists(b.view(np.int64), pa.int64()),
            }
        )

    return send


def _repeated(places: DataFrame, parts: int) -> DataFrame:
    """``block, place, least``: the smallest document of each string that is in a smaller one as well.

    Two rounds of prefix doubling, from 24 bytes to 48 and to 50.
    """
    rows = places.repartition("part").select("part", "block", F.inline(F.arrays_zip("place", "doc", "a", "b")))
    pair = Window.partitionBy("part").orderBy("a", "b")
    same = lambda by: (F.col("a").eqNullSafe(by(F.col("a")).over(pair))) & (F.col("b").eqNullSafe(by(F.col("b")).over(pair)))
    ranked = rows.select("part", "block", "place", "doc", F.dense_rank().over(pair).alias("n"), (same(F.lag) | same(F.lead)).alias("shared"))
    rank = F.col("n").cast("long") * parts + F.col("part")
    doubled = ranked.filter("shared").select("block", "place", "doc", rank.alias("rank"))
    along = Window.partitionBy("block").orderBy("place")
    step = [(F.lead("place", k).over(along), F.lead("rank", k).over(along)) for k in range(1, _CLOSE + 1)]
    on = F.coalesce(*[F.when(place == F.col("place") + _CLOSE, rank) for place, rank in step])
    closed = doubled.select("block", "place", "doc", "rank", on.alias("on")).filter(F.col("on").isNotNull())
    least = F.min("doc").over(Window.partitionBy("rank", "on"))
    return closed.select("block", "place", "doc", least.alias("least")).filter("least < doc").select("block", "place", "least")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(with_text: bool):
    def apply(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, ids, raw, offsets = _block(table)
        found = Anchors(ids, raw, offsets)
        first, mixed = _first_docs(found, ids, answers)
        late = first < ids[found.doc]
        begin, end = [found.first[late]], [found.last[late] + WINDOW]
        _, start, doc, number, one = _open_strings(found, ids, first, mixed)
        least = doc[one]
        told = answers.filter(pa.compute.equal(answers["kind"], 3))
        place, other = told["place"].to_numpy(), told["least"].to_numpy()
        order = np.argsort(place)
        place, other = place[order], other[order]
        known = _among(start[one], place)
        least[known] = other[np.searchsorted(place, start[one][known])]
        hit = least[number] < doc
        begin.append(start[hit])
        end.append(start[hit] + WINDOW)
        depth = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(depth, np.concatenate(begin), 1)
        np.add.at(depth, np.concatenate(end), -1)
        gone = np.cumsum(depth[:-1]) > 0
        n_removed, n_spans, digest, kept = [], [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            mask = gone[a:b]
            n_removed.append(int(mask.sum()))
            n_spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            rest = raw[a:b][~mask].tobytes()
            digest.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(rest)
        out = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return apply


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Each row's bytes left after removing strings that also start in a document of smaller id.

    Columns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes).
    Null and empty texts have no bytes.  Rows without an id count as one document after all
    others.  Rows that repeat an id are one document, so none of them loses bytes to another.
    """
    ship_package()
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = 1 + total // BLOCK_BYTES, 1 + total // BUCKET_BYTES
    last = 2**63 - 1
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("mark"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("long").alias("block"),
    )
    by_block = narrow.mapInArrow(_texts_by_block, _TEXTS).groupBy("block")

    def ask(sent: DataFrame, settle) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(settle, _ANSWER)

    def tell(answers: DataFrame, send, schema: str) -> DataFrame:
        return by_block.cogroup(answers.groupBy("block")).applyInArrow(send, schema)

    shared = ask(by_block.applyInArrow(_send_anchors(buckets), _MESSAGE), _shared_anchors)
    settled = ask(tell(shared, _send_contexts(buckets), _MESSAGE), _settle_contexts).repartition("block")
    repeated = _repeated(tell(settled, _send_places(buckets), _PLACES), buckets).withColumn("kind", F.lit(3)).repartition("block")
    out = tell(settled.unionByName(repeated, allowMissingColumns=True), _apply(with_text), _OUT + (", kept binary" if with_text else ""))
    doc_id = F.when(F.col("doc_id") < last, F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
