"""Raw mail parsing as Column expressions: one narrow projection, no Python.

Each function evaluates its argument once (``let``).  A filter on a parsed field is
pushed below the projections with all it depends on, and without that the argument
would be computed again for every mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions.text import let

NAMED_HEADERS = {
    "from_header": "from", "to_header": "to", "subject": "subject", "date_header": "date",
    "reply_to": "reply-to", "return_path": "return-path", "content_type": "content-type",
    "x_mailer": "x-mailer", "message_id": "message-id", "auth_results": "authentication-results",
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(V.WHITESPACE))


def unify_newlines(raw: Column) -> Column:
    return F.replace(raw, F.lit("\r\n"), F.lit("\n"))


def header_section(raw: Column) -> Column:
    """Text before the first blank line, or '' when its first line has no colon."""

    def head(r: Column) -> Column:
        blank = F.instr(r, "\n\n")
        return F.when(blank > 0, F.substr(r, F.lit(1), blank - 1)).otherwise(r)

    has_colon = lambda h: F.contains(F.substring_index(h, "\n", 1), F.lit(":"))
    return let(let(raw, head), lambda h: F.when(has_colon(h), h).otherwise(F.lit("")))


def body_section(raw: Column, headers: Column) -> Column:
    def body(r: Column) -> Column:
        blank = F.instr(r, "\n\n")
        return F.when(headers == "", r).when(blank > 0, F.substr(r, blank + 2)).otherwise(F.lit(""))

    return let(raw, body)


def unfold(headers: Column) -> Column:
    """Header lines with their continuation lines joined by one blank."""
    marked = F.transform(
        F.split(headers, "\n"),
        lambda line: F.when(line.rlike("^[ \t]"), F.concat(F.lit(" "), strip(line))).otherwise(
            F.concat(F.lit("\n"), line)
        ),
    )
    # the piece before the first mark can only be a continuation of nothing
    return F.filter(F.split(F.array_join(marked, ""), "\n"), lambda _, i: i > 0)


def header_entries(lines: Column) -> Column:
    """``array<struct<key,value>>`` in order of appearance; lines without colon drop out."""
    return F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            F.lower(strip(F.substring_index(line, ":", 1))).alias("key"),
            strip(F.substr(line, F.instr(line, ":") + 1)).alias("value"),
        ),
    )


def header_values(entries: Column, key: Column | str) -> Column:
    return F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"])


def first_header(entries: Column, key: str) -> Column:
    return F.coalesce(F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"], F.lit(""))


def header_map(entries: Column) -> Column:
    """``map<string, array<string>>`` keeping repeats of a header in order."""

    def grouped(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["key"]))
        return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: header_values(es, k))))

    return let(entries, grouped)


def mail_address(header: Column) -> Column:
    """Address inside the last ``<...>``, else the bare text if it has an ``@``."""
    angle = r"<([^<>]*)>[^<]*\z"

    def address(h: Column) -> Column:
        bare = F.btrim(h, F.lit("\"' "))
        return (
            F.when(h.rlike(angle), strip(F.regexp_extract(h, angle, 1)))
            .when(F.contains(bare, F.lit("@")), bare)
            .otherwise(F.lit(""))
        )

    return let(strip(header), address)


def mail_domain(address: Column) -> Column:
    def domain(a: Column) -> Column:
        last = F.lower(F.rtrim(F.substring_index(a, "@", -1), F.lit(">. ")))
        return F.when(F.contains(a, F.lit("@")), last).otherwise(F.lit(""))

    return let(strip(address), domain)


def auth_verdict(header: Column, method: str) -> Column:
    """Verdict of ``spf``/``dkim``/``dmarc`` in an Authentication-Results value, or ''."""
    return F.regexp_extract(F.lower(header), method + "=([^ \t;\n\r]*)", 1)


def extract_urls(body: Column) -> Column:
    """URLs by prefix scan, one prefix after the other, without repeats.

    The look-ahead lets a URL nested in another one be found as well.
    """

    def scan(text: Column, prefix: str) -> Column:
        stop = "".join("\\" + c if c in "\"'" else c for c in V.URL_END_CHARS)
        pattern = "(?i)(?=(" + prefix.replace(".", r"\.") + "[^" + stop + "]*))"
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    trimmed = let(
        body,
        lambda t: F.transform(
            F.concat(*[scan(t, p) for p in V.URL_PREFIXES]), lambda u: F.rtrim(u, F.lit(V.URL_TRAILING))
        ),
    )
    found = F.filter(trimmed, lambda u: F.octet_length(u) >= V.URL_MIN_BYTES)
    return F.array_distinct(
        F.transform(found, lambda u: F.when(F.lower(u).startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u))
    )


URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::[0-9]*)?(?:[/?#].*)?$"


def url_host(url: Column) -> Column:
    """Lower-cased host without user part and port; '' when there is none."""
    return F.lower(F.regexp_extract(url, URL_HOST, 1))


def url_domains(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, url_host), lambda h: h != ""))


def parse_mail(mails: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace ``raw`` by the parsed message; every step is a narrow projection."""
    made = {*NAMED_HEADERS, "received", "headers", "body"}
    keep = [c for c in mails.columns if c != raw and c not in made]
    sections = (
        mails.withColumn("_raw", unify_newlines(F.coalesce(F.col(raw), F.lit(""))))
        .withColumn("_head", header_section(F.col("_raw")))
        .withColumn("_entries", header_entries(unfold(F.col("_head"))))
    )
    no_header = F.col("_head") == ""
    # without a header section the entry list is empty, so every named header is ''
    named = {out: first_header(F.col("_entries"), key) for out, key in NAMED_HEADERS.items()}
    named["subject"] = F.when(no_header, strip(F.substring_index(F.col("_raw"), "\n", 1))).otherwise(named["subject"])
    parsed = sections.select(
        *keep,
        *[c.alias(n) for n, c in named.items()],
        header_values(F.col("_entries"), "received").alias("received"),
        header_map(F.col("_entries")).alias("headers"),
        body_section(F.col("_raw"), F.col("_head")).alias("body"),
    )
    return parsed.withColumns(
        {
            "sender_domain": mail_domain(mail_address(F.col("from_header"))),
            "reply_to_domain": mail_domain(mail_address(F.col("reply_to"))),
            "return_path_domain": mail_domain(mail_address(F.col("return_path"))),
            "spf": auth_verdict(F.col("auth_results"), "spf"),
            "dkim": auth_verdict(F.col("auth_results"), "dkim"),
            "dmarc": auth_verdict(F.col("auth_results"), "dmarc"),
        }
    )
