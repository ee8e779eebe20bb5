"""Tokenizers and text features as Column expressions (no Python at run time)."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_array(items: list[str]) -> Column:
    """Constant array column, built in one call."""
    return F.expr("array(" + ", ".join("r'" + i + "'" for i in items) + ")")


def _non_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_text(text), string.ascii_uppercase, string.ascii_lowercase)


def ascii_tokens(text: Column | str) -> Column:
    """Maximal runs of ASCII letters/digits and any non-ASCII character."""
    return _non_empty(F.split(ascii_lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"))


def unicode_tokens(text: Column | str) -> Column:
    """Lower-cased maximal runs of Unicode letters and decimal digits."""
    return _non_empty(F.split(F.lower(_text(text)), r"[^\p{L}\p{Nd}]+"))


def remove_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(V.STOP_WORDS))


def fields(text: Column) -> Column:
    """Split on runs of Unicode white space."""
    return _non_empty(F.split(text, r"(?U)\s+"))


def normalize_leet(text: Column | str) -> Column:
    """Undo digit/symbol spellings inside words that contain a letter.

    White space collapses to single blanks, so the result differs from the input
    for any text with a line break.
    """
    return F.array_join(
        F.transform(
            fields(_text(text)),
            lambda w: F.when(w.rlike(r"\p{L}"), F.translate(w, V.LEET_FROM, V.LEET_TO)).otherwise(w),
        ),
        " ",
    )


def bigrams(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)
    )


def utf8_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def byte_trigrams_hex(tokens: Column) -> Column:
    """All 3-byte windows of every token, as hex so that a window may cut a character."""

    def windows(t: Column) -> Column:
        return F.when(
            F.octet_length(t) >= 3,
            let(  # as bytes, so that a window is found without counting characters
                F.encode(t, "UTF-8"),
                lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - 2), lambda i: F.hex(F.substr(b, i, F.lit(3)))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(tokens, windows))


def combine_mail(subject: Column | str, body: Column | str) -> Column:
    """The one text a mail is vectorized from."""
    return F.concat(F.lit("subject: "), _text(subject), F.lit(" body: "), _text(body))
