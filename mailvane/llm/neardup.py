"""MinHash near-dedup with odd sketches.

1. Every document's set of word shingles gives MinHash samples.  Runs of samples are band
   keys; all samples together are folded into a parity bitmap, the odd sketch.  The bits
   in which two sketches differ estimate how far two sets differ, most precisely where
   they are much alike.
2. Equal sets are one class.  The class with most company over all its buckets is the
   centre of a bucket; each class is paired with the most central of its buckets' centres.
3. Pairs whose sketches differ too much are dropped; the rest is confirmed on full sets.
4. Buckets that still hold several components have their remaining pairs compared by
   sketch, block against block inside a task; only likely pairs leave it, from the first
   bucket that they share, and are confirmed.
5. Components are found over the confirmed links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.llm.shared import broadcast_if_small, components, durable, free_name
from mailvane.llm.wordhash import U64, mix, shingle_sets
from mailvane.shipping import ship_package

SHINGLE_WORDS = 5
#: A pair of similarity 0.75 misses every one of 40 bands of 5 with probability 2e-5.
BANDS, BAND_ROWS = 40, 5
#: All samples go into the sketch, those beyond the bands as well.
SAMPLES = 1280
SKETCH_BITS = 2048
#: Sketches may make a pair look this many standard errors less alike than it is.
STANDARD_ERRORS = 4
BLOCK = 1024

_XOR = mix(np.arange(1, SAMPLES + 1, dtype=U64)).astype(np.uint32)[:, None]
_ODD = (mix(np.arange(9001, 9001 + SAMPLES, dtype=U64)) | U64(1)).astype(np.uint32)[:, None]
_STEP = 256


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The samples of a set: for each of ``SAMPLES`` orders its smallest value."""
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), _STEP):
        values = x[None, at : at + _STEP] ^ _XOR
        values *= _ODD
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(BAND_ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    place = mix(samples.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def most_differing_bits(similarity: float) -> int:
    """Sketches of sets as alike as this differ in at most so many bits, errors allowed for.

    Of 2 k (1 - s) differing samples each toggles one of n bits, so a bit differs with
    probability (1 - exp(-4 k (1 - s) / n)) / 2.  The similarity is lowered by the standard
    error of k samples, and the bits raised by their own.
    """
    low = similarity - STANDARD_ERRORS * math.sqrt(similarity * (1 - similarity) / SAMPLES)
    p = (1 - math.exp(-4 * SAMPLES * (1 - low) / SKETCH_BITS)) / 2
    return math.ceil(SKETCH_BITS * p + STANDARD_ERRORS / 2 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            size, classes, keys, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1), SHINGLE_WORDS):
                size.append(len(s))
                if len(s):
                    samples = minhash(s)
                    classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                else:
                    classes.append(None)
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "class", "bands", "sketch"],
            )


def _alike(similarity_percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                known: dict = {}
                linked = []
                # rows come in the order of u, whose text is the same for many rows
                texts_u, texts_v = batch.column(2), batch.column(3)
                ids = list(zip(batch.column(0).to_pylist(), texts_u.to_pylist()))
                fresh = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                for i, s in zip(fresh, shingle_sets(texts_u.take(pa.array(fresh, pa.int64())), SHINGLE_WORDS)):
                    known[i] = s
                left = None
                for i, right in enumerate(shingle_sets(texts_v, SHINGLE_WORDS)):
                    left = known.get(i, left)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    linked.append(100 * both >= similarity_percent * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return confirm


def _likely(limit: int):
    """Pairs of different components within a (sorted) key whose sketches are close enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            key = rows["key"].to_numpy()
            ids, comp = rows["id"].to_numpy(), rows["component"].to_numpy()
            side = rows["side"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=U64).reshape(len(ids), -1)
            bucket, bands = rows["bucket"].to_numpy(), rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            bucket = bucket.astype(np.int32)
            out_u, out_v = [], []
            if len(key):
                ends = np.searchsorted(key, key, "right") if np.all(key[1:] >= key[:-1]) else _ends(key)
                step, here = 1, np.arange(len(key))
                while True:
                    here = here[here + step < ends[here]]
                    if not len(here):
                        break
                    there = here + step
                    # side 0 and 1 are two blocks of one bucket; 2 is a block with itself
                    due = (comp[here] != comp[there]) & (ids[here] != ids[there]) & ((side[here] != side[there]) | (side[here] == 2))
                    a, b = here[due], there[due]
                    if len(a):
                        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= limit
                        a, b = a[near], b[near]
                        shared = (bands[a] == bands[b]).argmax(axis=1)
                        near = bands[a, shared] == bucket[a]
                        out_u.append(np.minimum(ids[a[near]], ids[b[near]]))
                        out_v.append(np.maximum(ids[a[near]], ids[b[near]]))
                    step += 1
            found = np.unique(np.stack([np.concatenate(out_u), np.concatenate(out_v)]), axis=1) if out_u else np.zeros((2, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            # the last key may go on in the next batch
            key = rows["key"].to_numpy()
            cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if len(key) and key[0] != key[-1] else 0
            held = rows.slice(cut).combine_chunks()
            if cut:
                yield pairs(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield pairs(held)

    return compare


def _ends(key: np.ndarray) -> np.ndarray:
    """For each place the end of its run of equal keys."""
    edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return np.repeat(edges, np.diff(np.append(0, edges)))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are alike."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(_alike(percent), "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A component is all documents reachable over links of at least ``percent`` similarity,
    named by its smallest id, which is the one kept.  Null, empty and wordless texts have
    an empty set and are linked with nothing, as are rows with a null id (their component
    is null and they are kept).  Rows that repeat an id count as one document that has the
    links of all of them.
    """
    ship_package()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = durable(rows.mapInArrow(_signatures, "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary"))
    sets = signed.filter("class is not null and doc_id is not null")
    classes = sets.groupBy("class").agg(F.min("doc_id").alias("id"))
    least = classes.select("class", F.col("id").alias("doc_id"))
    apart = durable(sets.join(least, ["class", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "bands", "sketch"))

    banded = apart.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    members = durable(banded.join(shared.select("key", "n"), "key").distinct())

    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    hub = F.struct("company", (-F.col("id")).alias("least"))
    centres = members.join(company, "id").groupBy("key").agg(F.max(hub).alias("hub"))
    nearest = members.join(centres, "key").groupBy("id").agg(F.max("hub").alias("hub"))
    starred = nearest.select((-F.col("hub.least")).alias("u"), F.col("id").alias("v")).filter("u <> v")

    limit = most_differing_bits(percent / 100)
    sketches = durable(apart.join(members.select("id").distinct(), "id", "left_semi"))
    likely = (
        starred.join(sketches.select(F.col("id").alias("u"), F.col("sketch").alias("sketch_u")), "u")
        .join(sketches.select(F.col("id").alias("v"), F.col("sketch").alias("sketch_v")), "v")
        .mapInArrow(_near(limit), "u long, v long")
    )
    likely = durable(likely)

    ids = sketches.select("id").distinct()
    wanted = broadcast_if_small(ids, sketches.count(), 64)
    keyed = rows.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    texts = durable(keyed.join(wanted, "id", "left_semi"))
    links = durable(_confirmed(likely, texts, percent))

    found = components(links)
    labelled = members.join(found, members["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = durable(labelled)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_rows = labelled.join(mixed.select("key", blocks.alias("blocks")), "key").join(sketches, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = open_rows.withColumn("own", own).withColumn("other", other)
    met = met.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
        F.col("key").alias("bucket"),
        "id",
        "component",
        "sketch",
        # half of each key tells the first bucket that two rows share
        F.transform("bands", lambda b: F.shiftright(F.shiftleft(b, 32), 32).cast("int")).alias("bands"),
    )
    more = met.repartition("key").sortWithinPartitions("key").mapInArrow(_likely(limit), "u long, v long").distinct()
    tried = likely.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = durable(_confirmed(more.join(tried, ["u", "v"], "left_anti"), texts, percent))
    if not rest.isEmpty():
        found = components(links.unionByName(rest))

    class_component = classes.join(found, classes["id"] == found["node"], "left").select("class", F.coalesce("component", "id").alias("of_class"))
    out = signed.join(class_component, "class", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _near(limit: int):
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=U64).reshape(batch.num_rows, -1) for c in ("sketch_u", "sketch_v"))
            near = np.bitwise_count(a ^ b).sum(axis=1) <= limit
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(near))

    return close


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group, all columns unchanged.

    Only the ids to drop are joined, so ``docs`` is shuffled only if they are many.  Rows
    without an id, and texts without words, stay; rows that repeat an id stay or go
    together.  An empty table stays empty; other columns may have any names.
    """
    groups = durable(near_duplicate_groups(docs, percent))
    name = free_name(docs, "_gone")
    gone = groups.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(broadcast_if_small(gone, gone.count(), 64), docs["doc_id"] == F.col(name), "left_anti")
