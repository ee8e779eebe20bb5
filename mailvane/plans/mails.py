"""The ``mails`` view: raw messages derived from ``documents`` and ``labels``.

The documents hold no trigger vocabulary, so every document becomes the text of a
mail whose headers, subject and lead phrase vary with ``doc_id``.  Each expression
is SQL that Spark and DuckDB read alike, so both sides of a check start from the
same rows.  Every document gives one mail and every mail carries its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.sources.tables import spread

NL, TAB, CR = "chr(10)", "chr(9)", "chr(13)"


def _pick(modulus: int, *options: str) -> str:
    """SQL that picks one of the given SQL expressions by ``doc_id``."""
    arms = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"(CASE doc_id % {modulus} {arms} ELSE {options[-1]} END)"


def _texts(modulus: int, *options: str) -> str:
    return _pick(modulus, *[f"'{o}'" for o in options])


_SUBJECT = _texts(
    10,
    "Urgent: verify your account",
    "Project update for the team",
    "You are a WINNER - free pr1ze inside!",
    "Invoice attached for March",
    "Lunch on Thursday?",
    "Final notice: passw0rd expires",
    "Amazing d3al, limited offer!!!",
    "Minutes of the meeting",
    "Act now: wire transfer needed",
    'Review "Q3" figures',
)

_LEAD = _texts(
    11,
    "Please process this transfer immediately, send money today. ",
    "",
    "Click here to log in: http://login.example.test/a?x=1, or www.example.test/b. ",
    "Open the document and enable macros. ",
    "See https://www.example.org/news and https://www.example.org/news! ",
    "C0ngratulations w1nner, claim y0ur pr1ze 4 free!!! ",
    "The agenda is unchanged. ",
    "Your acc0unt is locked; confirm your password. ",
    "Download setup.exe from <http://files.example.test:8080/setup.exe>. ",
    "",
    "Meet at 10. ",
)

# repeated in proportion to the text, so that the density passes 0.3, or falls between 0.2 and 0.3
_URGENCY = (
    "repeat('Urgent! Act now, final notice: ', "
    + _pick(3, "0", "CAST(floor(n_chars / 60) AS INT) + 1", "CAST(floor(n_chars / 200) AS INT)")
    + ")"
)

_BODY = f"{_URGENCY} || {_LEAD} || text"

_DOMAIN = _texts(
    12,
    "paypal.com", "paypa1.com", "micros0ft.com", "arnazon.com", "example.org", "mailer.example.net",
    "g00gle-docs.com", "micr0soft-365.com", "zoom.us", "Zoon.us", "linkedln.com", "post.example.com.",
)
_FROM = _pick(
    5,
    "'Service Desk <desk@' || dom || '>'",
    "'<desk@' || dom || '>'",
    "'desk@' || dom",
    "'\"desk@' || dom || '\"'",
    "'Desk <old> <desk@' || dom || '> (team)'",
)
_REPLY_TO = _pick(
    4,
    "''",
    f"'Reply-To: desk@' || dom || {NL}",
    f"'reply-to: <help@reply.example.net>' || {NL}",
    f"'REPLY-TO: Help Desk' || {NL}",
)
_RETURN_PATH = _pick(
    3,
    "''",
    f"'Return-Path: <desk@' || dom || '>' || {NL}",
    f"'Return-Path: bounce@bulk.example.net' || {NL}",
)
_AUTH = _pick(
    6,
    "''",
    f"'Authentication-Results: mx.example.net;' || {NL} || {TAB} || 'spf=pass smtp.mailfrom=x;' || {NL}"
    f" || '  dkim=pass header.d=x;' || {NL} || ' dmarc=pass' || {NL}",
    f"'Authentication-Results: mx.example.net; spf=fail smtp.mailfrom=x; dkim=fail; dmarc=fail' || {NL}",
    f"'Authentication-Results: mx.example.net;' || {NL} || '   spf=SoftFail' || {NL} || ' dkim=none' || {NL}",
    f"'Authentication-Results: mx.example.net; dkim=Fail header.d=y' || {NL}",
    f"'authentication-results: mx.example.net; spf=none; dmarc=FAIL' || {NL}",
)
_HEADERS = (
    f"{_RETURN_PATH} || 'Received: from a.example by b.example;' || {NL} || '  id ' || CAST(doc_id AS VARCHAR(20))"
    f" || {NL} || 'Received: from c.example by d.example' || {NL} || {_AUTH} || 'From: ' || {_FROM} || {NL}"
    f" || 'To: Team <team@example.org>' || {NL} || {_texts(4, 'Subject', 'SUBJECT', 'subject', 'Subject')}"
    f" || ': ' || subject || {NL} || {_REPLY_TO}"
    f" || CASE WHEN doc_id % 7 = 3 THEN 'a header line without colon' || {NL} ELSE '' END"
    f" || CASE WHEN doc_id % 5 = 2 THEN 'X-Mailer: Batch 1.0' || {NL} ELSE '' END"
    f" || 'Date: Mon, 01 Jan 2024 10:00:00 +0000' || {NL}"
    f" || 'Message-ID: <' || CAST(doc_id AS VARCHAR(20)) || '@mail.example>' || {NL} || 'Content-Type: text/plain'"
)
_RAW = _pick(
    17,
    f"subject || {NL} || body",  # no header section (unless the subject has a colon)
    f"head || {NL} || 'X-Note: ' || replace(body, {NL}, ' ')",  # headers only
    f"'Hello team' || {NL} || head || {NL} || {NL} || body",  # first line without colon
    f"head || {NL} || {NL} || body",
)
_CRLF = f"CASE WHEN doc_id % 5 = 0 THEN replace(raw, {NL}, {CR} || {NL}) ELSE raw END"

# one projection after the other, each using the columns of the one before
STEPS = [
    {"doc_id": "doc_id", "subject": _SUBJECT, "dom": _DOMAIN, "body": _BODY},
    {"doc_id": "doc_id", "subject": "subject", "body": "body", "head": _HEADERS},
    {"doc_id": "doc_id", "subject": "subject", "body": "body", "raw": _RAW},
    {"mail_id": "doc_id", "subject": "subject", "body": "body", "raw": _CRLF},
]

CATEGORY = "CASE WHEN toxic = 1 THEN 'attack' WHEN quality = 0 THEN 'spam' WHEN quality = 1 THEN 'safe' END"



def _nested_sql() -> str:
    source = "documents"
    for step in STEPS:
        source = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM {source})"
    return source


MAILS_SQL = (
    f"SELECT m.*, {CATEGORY} AS category FROM {_nested_sql()} m LEFT JOIN labels ON labels.doc_id = m.mail_id"
)


HEAVY = {"documents", "embeddings", "events", "pages"}  # read by queries that work hard per row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in HEAVY else scan


def mails_of(documents: DataFrame) -> DataFrame:
    """Mails without category; works on a stream of documents as well."""
    out = documents
    for step in STEPS:
        out = out.select(*[F.expr(e).alias(n) for n, e in step.items()])
    return out


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mail_id, subject, body, raw, category`` (null category: not labelled)."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("mail_id"), F.expr(CATEGORY).alias("category")
    )
    return mails_of(table(spark, sf_dir, "documents")).join(labels, "mail_id", "left")
