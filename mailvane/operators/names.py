"""Similar names by edit distance: a join of two tables of names, without comparing all pairs.

A name of the table is cut into one piece more than a pair may have edits, so a similar
name holds at least one piece unchanged; of those, the last has moved by no more places than
there are pieces before it.  So the join is on (length, length of the part that is cut,
edits, number of the piece, the piece), and only pairs that share a piece are compared.
Pieces are cut from the part before the last dot where that is long enough: an ending such
as ``.com`` that very many names share would make every pair a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, at least, where pieces are cut from the part before the last dot.
LEAST_PIECE = 2


def _edits(longest: Column, slack: float) -> Column:
    return F.floor(longest * slack + 1e-6).cast("int")


def _cut(name: Column, edits: Column) -> Column:
    """Length of the part of ``name`` that is cut: up to the last dot, if that has room for the pieces."""
    tail = F.char_length(F.substring_index(name, ".", -1))
    stem = F.char_length(name) - tail - 1
    return F.when(stem >= LEAST_PIECE * (edits + 1), stem).otherwise(F.char_length(name)).cast("int")


def _start(cut: Column, edits: Column, piece: Column) -> Column:
    return F.floor(piece * cut / (edits + 1)).cast("int")


_KEY = ["size", "cut", "edits", "piece", "held"]


def similar_names(names: DataFrame, table: DataFrame, min_similarity: float, name: str = "name", entry: str = "entry") -> DataFrame:
    """Pairs ``(name, entry, similarity)`` of different, lower-cased names with similarity above the bound.

    Similarity is 1 - edits / longer length in characters, single precision; all pairs
    above ``min_similarity`` are found (the bound must be above 0).  Null and empty names have no partners, and
    repeated ones count once.  Empty tables give no rows; other columns are not read.
    A piece shared by very many names is an ordinary skewed key of the join.
    """
    if not 0 < min_similarity < 1:
        raise ValueError("min_similarity must be between 0 and 1")
    slack = 1 - min_similarity
    left = names.select(F.lower(F.col(name)).alias("name")).filter("name <> ''").distinct()
    right = table.select(F.lower(F.col(entry)).alias("entry")).filter("entry <> ''").distinct()

    # a table name has its pieces once for every number of edits that a partner's length allows
    size = F.char_length("entry")
    most = _edits(F.floor(size / min_similarity + 1e-6), slack)
    allowed = right.select("entry", size.alias("size"), F.explode(F.sequence(_edits(size, slack), most)).alias("edits"))
    allowed = allowed.withColumn("cut", _cut(F.col("entry"), F.col("edits")))
    pieces = allowed.filter("cut > edits").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start, end = (_start(F.col("cut"), F.col("edits"), F.col("piece") + k) for k in (0, 1))
    pieces = pieces.select("entry", "size", "cut", "edits", "piece", F.substring("entry", start + 1, end - start).alias("held"))

    # the shapes there are: at most one for each length and length before the dot
    shapes = allowed.select("size", "edits", "cut").distinct()
    size = F.char_length("name")
    low, high = F.ceil(size * min_similarity - 1e-6), F.floor(size / min_similarity + 1e-6)
    sized = left.select("name", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))
    sized = sized.withColumn("edits", _edits(F.greatest(F.char_length("name"), "size"), slack))
    asked = sized.join(shapes, ["size", "edits"]).filter("cut > edits").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    asked = asked.withColumn("moved", F.explode(F.sequence(-F.col("piece"), F.col("piece"))))
    at = _start(F.col("cut"), F.col("edits"), F.col("piece"))
    length = _start(F.col("cut"), F.col("edits"), F.col("piece") + 1) - at
    asked = asked.withColumn("at", at + F.col("moved")).withColumn("length", length)
    asked = asked.filter("at >= 0 and at + length <= char_length(name)")
    asked = asked.select("name", "size", "cut", "edits", "piece", F.substring("name", F.col("at") + 1, F.col("length")).alias("held"))

    pairs = asked.join(pieces, _KEY).filter("name <> entry").select("name", "entry").distinct()
    # floats: the bound is compared in single precision, as the rule does
    longest = F.greatest(F.char_length("name"), F.char_length("entry"))
    ratio = (F.levenshtein("name", "entry").cast("float") / longest.cast("float")).cast("float")
    similarity = (F.lit(1.0).cast("float") - ratio).cast("float")
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") > F.lit(min_similarity).cast("float"))


def first_resembled(domains: DataFrame, brands: DataFrame, min_similarity: float, domain: str = "domain") -> DataFrame:
    """``(name, typosquat)``: for every distinct domain that resembles a brand, the brand of smallest ``place``.

    ``brands(brand, place)`` may be a table of any size.
    """
    pairs = similar_names(domains, brands, min_similarity, domain, "brand")
    placed = brands.select(F.lower("brand").alias("entry"), "place").groupBy("entry").agg(F.min("place").alias("place"))
    return pairs.join(placed, "entry").groupBy("name").agg(F.min_by("entry", "place").alias("typosquat"))
