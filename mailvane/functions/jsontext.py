"""JSON helpers: strict line parsing, number text, and flattening to a word text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.shipping import ship_package


def strict_variant(line: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    Spark's parser stops after the first value; wrapping the text as the first of
    two array items makes any trailing text break the array or change its length.
    An object that repeats a key counts as invalid (see :func:`object_members`).
    """
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]"))), "$", "array<variant>"
    )
    return F.when(F.size(items) == 2, F.get(items, F.lit(0)))


def variant_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    return variant_type(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def object_members(line: Column) -> Column:
    """Members of a text that is exactly one JSON object, as ``map<string,variant>``, else null.

    Repeated keys are all there, in order; looking one up finds the first.  An object that
    repeats keys deeper down is read member by member, and a member that still has no
    variant form is held as its text.
    """
    whole = F.concat(F.lit("["), line, F.lit(",{}]"))
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    read = lambda kind: F.from_json(whole, f"array<map<string,{kind}>>", options)
    only = lambda items: F.when(F.size(items) == 2, F.get(items, F.lit(0)))
    text_of = lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant"))
    return F.coalesce(only(read("variant")), F.transform_values(only(read("string")), text_of))


def last_member(members: Column, name: str) -> Column:
    """The last value of a key that is not null, upper and lower case alike."""
    same = F.filter(F.map_entries(members), lambda e: (F.lower(e["key"]) == name) & (variant_type(e["value"]) != "VOID"))
    return F.try_element_at(same, F.lit(-1))["value"]


def number_g6(x: Column) -> Column:
    """Six significant digits as C's ``%.6g`` prints them."""
    sci = F.printf(F.lit("%.5e"), x.cast("double"))
    digits = F.rtrim(F.rtrim(F.substring_index(sci, "e", 1), F.lit("0")), F.lit("."))
    exponent = F.substring_index(sci, "e", -1)
    power = exponent.cast("int")
    plain = F.rtrim(F.rtrim(sci.try_cast("decimal(24,12)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(x == 0, F.lit("0")).when(power.between(-4, 5), plain).otherwise(
        F.concat(digits, F.lit("e"), exponent)
    )


class _Pairs(list):
    """Members of a JSON object, in order, repeats included."""


def _words(value):
    if isinstance(value, _Pairs):
        for k, v in value:
            yield "key:" + k
            yield from _words(v)
    elif isinstance(value, list):
        for v in value:
            yield from _words(v)
    elif isinstance(value, bool):
        yield "true" if value else "false"
    elif isinstance(value, str):
        yield value
    elif value is not None:
        yield "%.6g" % value


def _flatten(text: str | None) -> str | None:
    try:
        return " ".join(_words(json.loads(text, object_pairs_hook=_Pairs, parse_int=float)))
    except (TypeError, ValueError, RecursionError):
        return None


def json_text(value: Column) -> Column:
    """Space-joined keys (as ``key:<name>``) and scalars, depth first; null if invalid.

    Member order matters for the bigrams taken from this text, and neither a variant
    nor a map keeps it for nested values, hence an Arrow-batched function.
    """

    ship_package()

    @F.arrow_udf("string")
    def flatten(texts: pa.Array) -> pa.Array:
        return pa.array([_flatten(t) for t in texts.to_pylist()], pa.string())

    return flatten(value)
