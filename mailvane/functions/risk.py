"""Rule-based risk analysis of parsed mail, as Column expressions.

Weights add up in single precision in a fixed order, because the thresholds are
compared with single-precision sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions.text import fields, let, string_array


def _f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return let(text, lambda t: F.exists(string_array(phrases), lambda p: F.contains(t, p)))


def first_contained(text: Column, phrases: list[str]) -> Column:
    """First phrase in list order that occurs in ``text``, else null."""
    return let(text, lambda t: F.get(F.filter(string_array(phrases), lambda p: F.contains(t, p)), F.lit(0)))


def domains_differ(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def _similarity(edits: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    ratio = _f32(_f32(edits) / _f32(F.nullif(longest, F.lit(0))))
    return F.when(longest == 0, _f32(1.0)).otherwise(_f32(1.0) - ratio)


def domain_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance (characters) / longer length (bytes), single precision."""
    return _similarity(F.levenshtein(F.lower(a), F.lower(b)), a, b)


def typosquat_of(domain: Column) -> Column:
    """First brand, in list order, that lower-cased ``domain`` resembles without being it.

    A domain has at most 16 brands to be compared with, so it is done in place: no
    join, and a domain that sends a third of all mail costs what any other does.
    A length difference alone can rule a brand out before the edit distance runs.
    """
    floor = F.lit(V.TYPOSQUAT_MIN_SIMILARITY).cast("float")
    slack = 1 - V.TYPOSQUAT_MIN_SIMILARITY

    def resembles(d: Column, b: Column) -> Column:
        longest = F.greatest(F.octet_length(d), F.octet_length(b))
        possible = F.abs(F.char_length(d) - F.char_length(b)) <= longest * slack
        return (d != "") & (d != b) & possible & (_similarity(F.levenshtein(d, b), d, b) > floor)

    brands = string_array(V.BRAND_DOMAINS)
    return let(domain, lambda d: F.get(F.filter(brands, lambda b: resembles(d, b)), F.lit(0)))


def urgency_score(text: Column) -> Column:
    """Density of urgency terms in lower-cased ``text``, scaled by ten, at most one."""
    single = [t for t in V.URGENCY_TERMS if " " not in t]
    phrases = [t for t in V.URGENCY_TERMS if " " in t]
    is_urgent = lambda w: F.btrim(w, F.lit(V.URGENCY_STRIP)).isin(single)

    def counts(t: Column) -> Column:
        found = F.size(F.filter(string_array(phrases), lambda p: F.contains(t, p)))
        return let(
            fields(t),
            lambda ws: F.struct(
                (F.size(F.filter(ws, is_urgent)) + found).alias("hits"), F.size(ws).alias("words")
            ),
        )

    def density(c: Column) -> Column:
        share = _f32(_f32(c["hits"]) / _f32(F.nullif(c["words"], F.lit(0)))) * _f32(10.0)
        return F.when(c["words"] == 0, _f32(0.0)).otherwise(F.least(share, _f32(1.0)))

    return let(let(text, counts), density)


RULE_COLUMNS = [
    "domain_mismatch", "return_path_mismatch", "spf_fail", "dkim_fail", "dmarc_fail", "typosquat",
    "urgency", "credential_ask", "financial_ask", "suspicious_links", "malware",
]


def rule_columns(mails: DataFrame, *, headers: bool = True) -> DataFrame:
    """One column per rule.  ``headers=False`` leaves the header rules silent."""
    off, none = F.lit(False), F.lit(None).cast("string")
    text = F.lower(F.concat(F.col("subject"), F.lit(" "), F.col("body")))
    out = mails.withColumn("_text", text)
    rules: dict[str, Column] = {
        "domain_mismatch": domains_differ(F.col("reply_to_domain"), F.col("sender_domain")) if headers else off,
        "return_path_mismatch": domains_differ(F.col("return_path_domain"), F.col("sender_domain"))
        if headers
        else off,
        "spf_fail": F.col("spf").isin("fail", "softfail") if headers else off,
        "dkim_fail": (F.col("dkim") == "fail") if headers else off,
        "dmarc_fail": (F.col("dmarc") == "fail") if headers else off,
        "typosquat": typosquat_of(F.col("sender_domain")) if headers else none,
        "urgency": urgency_score(F.col("_text")),
        "credential_ask": contains_any(F.col("_text"), V.CREDENTIAL_PHRASES),
        "financial_ask": contains_any(F.col("_text"), V.FINANCIAL_PHRASES),
        "malware": first_contained(F.col("_text"), V.MALWARE_PHRASES),
        "_link_phrase": contains_any(F.lower(F.col("body")), V.LINK_PHRASES),
    }
    # a typosquatted sender counts as a suspicious link even without any link
    return (
        out.withColumns(rules)
        .withColumn("suspicious_links", F.col("_link_phrase") | F.col("typosquat").isNotNull())
        .drop("_text", "_link_phrase")
    )


# condition of every rule over RULE_COLUMNS, in evaluation order
_FIRED = {
    "reply_to_mismatch": "domain_mismatch",
    "return_path_mismatch": "return_path_mismatch",
    "spf": "spf_fail",
    "dkim": "dkim_fail",
    "dmarc": "dmarc_fail",
    "typosquat": "typosquat IS NOT NULL",
    "urgency": f"urgency > CAST({V.URGENCY_SIGNAL_ABOVE} AS FLOAT)",
    "credential": "credential_ask",
    "financial": "financial_ask",
    "links": "suspicious_links",
    "malware": "malware IS NOT NULL",
}


def risk_score() -> Column:
    """Sum of the weights of the rules that fired, at most one (over ``RULE_COLUMNS``)."""
    total = "CAST(0 AS FLOAT)"
    for rule, fired in _FIRED.items():
        weight = f"CAST({V.RISK_WEIGHTS[rule]} AS FLOAT)"
        if rule == "urgency":
            weight = f"urgency * {weight}"
        total += f" + CASE WHEN {fired} THEN {weight} ELSE CAST(0 AS FLOAT) END"
    return F.expr(f"least({total}, CAST(1 AS FLOAT))")


def signals(*, headers: bool = True) -> Column:
    """Readable description of every rule that fired, in evaluation order."""
    c, quote = F.col, F.lit("'")

    def differs(what: str, col: str) -> Column:
        return F.concat(
            F.lit(f"{what} domain '"), c(col), F.lit("' differs from sender domain '"), c("sender_domain"), quote
        )

    texts = [
        differs("Reply-To", "reply_to_domain") if headers else F.lit(""),
        differs("Return-Path", "return_path_domain") if headers else F.lit(""),
        F.lit("SPF check: FAIL"),
        F.lit("DKIM check: FAIL"),
        F.lit("DMARC check: FAIL"),
        F.concat(F.lit("Sender domain '"), c("sender_domain"), F.lit("' looks like typosquat of '"), c("typosquat"),
                 quote) if headers else F.lit(""),
        F.printf(F.lit("High urgency language (score: %.2f)"), c("urgency").cast("double")),
        F.lit("Requests credential/personal information"),
        F.lit("Contains financial/payment request"),
        F.lit("Contains suspicious link patterns"),
        F.concat(F.lit("Malware indicator: contains '"), c("malware"), quote),
    ]
    return F.array_compact(F.array(*[F.when(F.expr(f), t) for f, t in zip(_FIRED.values(), texts)]))


def attack_subtype() -> Column:
    c = F.col
    return (
        F.when(
            c("financial_ask") & (c("urgency") > F.lit(V.CEO_FRAUD_URGENCY_ABOVE).cast("float")), F.lit("CEO_FRAUD")
        )
        .when(c("credential_ask"), F.lit("CREDENTIAL_HARVEST"))
        .when(c("domain_mismatch") | c("spf_fail") | c("suspicious_links"), F.lit("PHISHING"))
        .when(c("malware").isNotNull(), F.lit("MALWARE"))
        .otherwise(F.lit("GENERIC_ATTACK"))
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score > F.lit(V.RISK_HIGH_ABOVE).cast("float"), F.lit("HIGH"))
        .when(score > F.lit(V.RISK_MEDIUM_ABOVE).cast("float"), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def analyze(mails: DataFrame, *, headers: bool = True) -> DataFrame:
    """Add rule columns, ``risk_score``, ``risk_level``, ``signals`` and ``subtype``."""
    return (
        rule_columns(mails, headers=headers)
        .withColumns({"risk_score": risk_score(), "signals": signals(headers=headers), "subtype": attack_subtype()})
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )
