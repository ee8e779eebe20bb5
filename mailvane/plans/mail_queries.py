"""Queries over ``mails`` and ``pages``: loading, parsing, risk rules, classification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions import mail as P
from mailvane.functions import risk as R
from mailvane.functions.text import combine_mail
from mailvane.operators import ann
from mailvane.operators import classify as C
from mailvane.operators import names
from mailvane.operators import vectorize as vz
from mailvane.plans import duck
from mailvane.plans.mails import CATEGORY, mails, table
from mailvane.plans.registry import query, r6, sql_r6
from mailvane.plans.vector_queries import FILE_PART, in_files
from mailvane.session import ensure_checkpoint_dir
from mailvane.sources import mail as src
from mailvane.sources.corpus import read_corpus, write_corpus
from mailvane.sources.vectors import reject_counts

NAMED = list(P.NAMED_HEADERS)


# --- loading ---------------------------------------------------------------
def mail_lines_of(m: DataFrame, *more: str) -> DataFrame:
    """Labelled mails as JSON lines, with comments, blanks and broken lines in between."""
    kind = F.col("mail_id") % 9
    label = F.when(kind == 1, F.upper("category")).when(kind == 2, F.lit("unsure")).otherwise(F.col("category"))
    good = F.to_json(F.struct(label.alias("category"), "subject", "body"))
    line = (
        F.when(kind == 3, F.concat(F.lit("# "), good))
        .when(kind == 4, F.lit("   "))
        .when(kind == 5, F.concat(good, F.lit(" }")))
        .when(kind == 6, F.to_json(F.struct("category", "mail_id", F.lit(7).alias("subject"), "body")))
        .otherwise(good)
    )
    return m.select(line.alias("line"), *more)


def mail_lines(spark, sf_dir) -> DataFrame:
    return mail_lines_of(mails(spark, sf_dir).where("category IS NOT NULL"))


@query(
    "load_mail_jsonl",
    f"WITH {duck.MAILS} SELECT category, subject, body FROM mails WHERE category IS NOT NULL AND mail_id % 9 IN (0, 1, 7, 8)",
)
def load_mail_jsonl(spark, sf_dir):
    return src.split_rejects(src.tag_mail_lines(mail_lines(spark, sf_dir)))[0]


@query(
    "load_mail_rejects",
    f"""WITH {duck.MAILS} SELECT CASE WHEN mail_id % 9 = 2 THEN 'invalid_category'
  WHEN mail_id % 9 IN (5, 6) THEN 'invalid_json' ELSE 'loaded' END AS outcome, count(*) AS n_lines
FROM mails WHERE category IS NOT NULL AND mail_id % 9 NOT IN (3, 4) GROUP BY 1""",
)
def load_mail_rejects(spark, sf_dir):
    return reject_counts(src.tag_mail_lines(mail_lines(spark, sf_dir)))


@query(
    "load_mail_located",
    f"""WITH {duck.MAILS} SELECT mail_id % 4 AS part, line_no, CASE mail_id % 9 WHEN 2 THEN 'invalid_category' ELSE 'invalid_json' END AS reason
FROM (SELECT mail_id, row_number() OVER (PARTITION BY mail_id % 4 ORDER BY mail_id) AS line_no FROM mails WHERE category IS NOT NULL)
WHERE mail_id % 9 IN (2, 5, 6)""",
)
def load_mail_located(spark, sf_dir):
    """Where the bad lines are; blank lines and comments count."""
    folder = in_files(mail_lines_of(mails(spark, sf_dir).where("category IS NOT NULL"), "mail_id"), "mail_id")
    _, rejects = src.load_mail_jsonl(spark, folder, located=True)
    return rejects.select(FILE_PART(), "line_no", "reason")


_FLAT_BODY = "replace(replace(body, chr(10), ' '), chr(13), ' ')"


@query(
    "load_mail_tsv",
    f"""WITH {duck.MAILS} SELECT subject, CASE WHEN mail_id % 5 = 1 THEN 'a' || chr(9) || {_FLAT_BODY}
  ELSE {_FLAT_BODY} END AS body FROM mails WHERE mail_id % 5 <> 2""",
)
def load_mail_tsv(spark, sf_dir):
    kind, flat = F.col("mail_id") % 5, F.translate("body", "\n\r", "  ")
    line = (
        F.when(kind == 1, F.concat("subject", F.lit("\ta\t"), flat))
        .when(kind == 2, F.concat("subject", F.lit(" "), F.translate(flat, "\t", " ")))
        .when(kind == 3, F.concat("subject", F.lit("\t"), flat, F.lit("\r")))
        .otherwise(F.concat("subject", F.lit("\t"), flat))
    )
    lines = mails(spark, sf_dir).select(line.alias("line"))
    return src.split_rejects(src.tag_tsv_lines(lines))[0]


@query(
    "firstline_subject",
    """SELECT doc_id, split_part(text, chr(10), 1) AS subject,
  CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents""",
)
def firstline_subject(spark, sf_dir):
    subject, body = src.firstline_subject(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", subject.alias("subject"), body.alias("body"))


@query(
    "subject_metadata",
    f"""WITH {duck.MAILS} SELECT mail_id, '{{"subject":"' || replace(subject, '"', chr(92) || '"') || '"}}' AS metadata
FROM mails""",
)
def subject_metadata(spark, sf_dir):
    return mails(spark, sf_dir).select("mail_id", src.subject_metadata(F.col("subject")).alias("metadata"))


# --- parsing ---------------------------------------------------------------
_PARSE = f"WITH {duck.MAILS}, {duck.PARSED}"


def parsed(spark, sf_dir) -> DataFrame:
    return P.parse_mail(mails(spark, sf_dir))


@query("mail_crlf", f"WITH {duck.MAILS} SELECT mail_id, replace(raw, chr(13) || chr(10), chr(10)) AS raw FROM mails")
def mail_crlf(spark, sf_dir):
    return mails(spark, sf_dir).select("mail_id", P.unify_newlines(F.col("raw")).alias("raw"))


def sections(spark, sf_dir) -> DataFrame:
    m = mails(spark, sf_dir).select("mail_id", P.unify_newlines(F.col("raw")).alias("raw"))
    return m.withColumn("head", P.header_section(F.col("raw")))


@query("mail_split", f"{_PARSE} SELECT mail_id, head, body FROM m5")
def mail_split(spark, sf_dir):
    return sections(spark, sf_dir).select("mail_id", "head", P.body_section(F.col("raw"), F.col("head")).alias("body"))


@query("mail_no_header", f"{_PARSE} SELECT mail_id, subject, body FROM parsed WHERE head = ''")
def mail_no_header(spark, sf_dir):
    return parsed(spark, sf_dir).where(F.size("headers") == 0).select("mail_id", "subject", "body")


@query(
    "mail_unfold",
    f"""{_PARSE} SELECT mail_id, pos::INTEGER AS pos, line FROM (SELECT mail_id, unnest(ls) line,
  generate_subscripts(ls, 1) - 1 pos FROM (SELECT mail_id, string_split(regexp_replace(head, '\\n[ \\t]+', ' ', 'g'),
  chr(10)) ls FROM m4 WHERE head <> ''))""",
)
def mail_unfold(spark, sf_dir):
    m = sections(spark, sf_dir).where("head <> ''")
    return m.select("mail_id", F.posexplode(P.unfold(F.col("head"))).alias("pos", "line"))


@query(
    "mail_headers_long",
    f"""{_PARSE} SELECT mail_id, pos::INTEGER AS pos, h.k AS key, h.v AS value FROM (SELECT mail_id, unnest(hdrs) h,
  generate_subscripts(hdrs, 1) - 1 pos FROM m5)""",
)
def mail_headers_long(spark, sf_dir):
    m = sections(spark, sf_dir).select("mail_id", P.header_entries(P.unfold(F.col("head"))).alias("entries"))
    return m.select("mail_id", F.posexplode("entries").alias("pos", "e")).select("mail_id", "pos", "e.key", "e.value")


@query(
    "mail_fields",
    f"{_PARSE} SELECT mail_id, {', '.join(NAMED)}, array_to_string(received, ' | ') AS received FROM parsed",
)
def mail_fields(spark, sf_dir):
    return parsed(spark, sf_dir).select("mail_id", *NAMED, F.array_join("received", " | ").alias("received"))


@query(
    "mail_address",
    f"""{_PARSE} SELECT mail_id, {duck.address('from_header')} AS sender, {duck.address('reply_to')} AS reply_to,
  {duck.address('return_path')} AS return_path FROM parsed""",
)
def mail_address(spark, sf_dir):
    a = lambda c: P.mail_address(F.col(c))
    return parsed(spark, sf_dir).select(
        "mail_id", a("from_header").alias("sender"), a("reply_to").alias("reply_to"), a("return_path").alias("return_path")
    )


_DOMAINS = "sender_domain, reply_to_domain, return_path_domain"


@query("mail_domain", f"{_PARSE} SELECT mail_id, {_DOMAINS} FROM parsed")
def mail_domain(spark, sf_dir):
    return parsed(spark, sf_dir).select("mail_id", *_DOMAINS.split(", "))


@query("mail_auth", f"{_PARSE} SELECT mail_id, spf, dkim, dmarc FROM parsed")
def mail_auth(spark, sf_dir):
    return parsed(spark, sf_dir).select("mail_id", "spf", "dkim", "dmarc")


@query("parse_mail", f"{_PARSE} SELECT mail_id, {', '.join(NAMED)}, {_DOMAINS}, spf, dkim, dmarc, body FROM parsed")
def parse_mail(spark, sf_dir):
    return parsed(spark, sf_dir).select("mail_id", *NAMED, *_DOMAINS.split(", "), "spf", "dkim", "dmarc", "body")


_URL_TEXT = f"""{duck.MAILS}, texts AS (SELECT 'page-' || page_id AS source_id, html || ' ' || url AS txt FROM pages
  UNION ALL SELECT 'mail-' || mail_id, body FROM mails)"""


def _scan_sql(prefix: str) -> str:
    return rf"regexp_extract_all(txt, '(?i){prefix}[^ \t\n\r<>\"'']*')"


_URLS = f"""{_URL_TEXT}, urls AS (SELECT DISTINCT source_id, CASE WHEN lower(u) LIKE 'www.%' THEN 'http://' || u ELSE u END AS url
  FROM (SELECT source_id, rtrim(unnest({_scan_sql('https://')} || {_scan_sql('http://')} || {_scan_sql('www[.]')}),
  '.,;!?()[]') u FROM texts) WHERE strlen(u) >= 5)"""


def _url_texts(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"),
        F.concat("html", F.lit(" "), "url").alias("txt"),
    )
    m = mails(spark, sf_dir).select(
        F.concat(F.lit("mail-"), F.col("mail_id").cast("string")).alias("source_id"), F.col("body").alias("txt")
    )
    return pages.unionByName(m)


@query("extract_urls", f"WITH {_URLS} SELECT source_id, url FROM urls")
def extract_urls(spark, sf_dir):
    return _url_texts(spark, sf_dir).select("source_id", F.explode(P.extract_urls(F.col("txt"))).alias("url"))


@query(
    "url_domains",
    f"""WITH {_URLS} SELECT DISTINCT source_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM urls
WHERE regexp_matches(url, '://[^/?#:]+')""",
)
def url_domains(spark, sf_dir):
    hosts = P.url_domains(P.extract_urls(F.col("txt")))
    return _url_texts(spark, sf_dir).select("source_id", F.explode(hosts).alias("host"))


# --- risk rules ------------------------------------------------------------
_RISK = f"{_PARSE}, {duck.SQUATS}, {duck.rules('parsed')}"
_FLAGS = ["domain_mismatch", "return_path_mismatch", "spf_fail", "dkim_fail", "dmarc_fail"]


def ruled(spark, sf_dir) -> DataFrame:
    return R.rule_columns(parsed(spark, sf_dir))


def analyzed(spark, sf_dir) -> DataFrame:
    return R.analyze(parsed(spark, sf_dir))


def _rule(name: str, *columns: str) -> None:
    @query(name, f"{_RISK} SELECT mail_id, {', '.join(columns)} FROM risk")
    def run(spark, sf_dir):
        return ruled(spark, sf_dir).select("mail_id", *columns)


_rule("risk_domain_mismatch", "domain_mismatch", "return_path_mismatch")
_rule("risk_auth", "spf_fail", "dkim_fail", "dmarc_fail")
_rule("risk_credential", "credential_ask")
_rule("risk_financial", "financial_ask")
_rule("risk_links", "suspicious_links")
_rule("risk_malware", "malware")


@query("risk_urgency", f"{_RISK} SELECT mail_id, {sql_r6('urgency')} AS urgency FROM risk")
def risk_urgency(spark, sf_dir):
    return ruled(spark, sf_dir).select("mail_id", r6("urgency").alias("urgency"))


_HOSTS = "hosts AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]+)', 1)) dom FROM pages)"
_BRAND_ROWS = f"(SELECT unnest([{duck.quoted(V.BRAND_DOMAINS)}]) brand)"


@query(
    "domain_similarity",
    f"""WITH {_HOSTS} SELECT dom AS domain, brand, levenshtein(dom, brand)::INTEGER AS edits,
  {sql_r6(duck.similarity('dom', 'brand'))} AS similarity FROM hosts, {_BRAND_ROWS}""",
)
def domain_similarity(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(P.url_host(F.col("url")).alias("domain")).distinct()
    brands = F.explode(F.array(*[F.lit(b) for b in V.BRAND_DOMAINS]))  # the fixed list, per row
    pairs = hosts.select("domain", brands.alias("brand"))
    return pairs.select(
        "domain",
        "brand",
        F.levenshtein("domain", "brand").alias("edits"),
        r6(R.domain_similarity(F.col("domain"), F.col("brand"))).alias("similarity"),
    )


@query(
    "typosquat",
    f"{_PARSE}, {duck.SQUATS} SELECT mail_id, sender_domain, typosquat FROM parsed LEFT JOIN squats ON dom = sender_domain",
)
def typosquat(spark, sf_dir):
    return parsed(spark, sf_dir).select("mail_id", "sender_domain", R.typosquat_of(F.col("sender_domain")).alias("typosquat"))


@query(
    "typosquat_joined",
    f"{_PARSE}, {duck.SQUATS} SELECT mail_id, sender_domain, typosquat FROM parsed LEFT JOIN squats ON dom = sender_domain",
)
def typosquat_joined(spark, sf_dir):
    """The brands as a table, joined with the distinct sender domains."""
    rows = parsed(spark, sf_dir).select("mail_id", "sender_domain")
    brands = spark.createDataFrame(list(enumerate(V.BRAND_DOMAINS)), "place int, brand string")
    squats = names.first_resembled(rows, brands, V.TYPOSQUAT_MIN_SIMILARITY, "sender_domain")
    return rows.join(squats, rows["sender_domain"] == squats["name"], "left").drop("name")


_SENDERS = "(SELECT DISTINCT sender_domain AS domain FROM parsed WHERE sender_domain <> '')"


@query(
    "similar_hosts",
    f"""{_PARSE}, {_HOSTS} SELECT domain, dom AS host, {sql_r6(duck.similarity('domain', 'dom'))} AS similarity
  FROM {_SENDERS} JOIN hosts ON domain <> dom AND dom <> '' AND {duck.similarity('domain', 'dom')} > 0.5::FLOAT""",
)
def similar_hosts(spark, sf_dir):
    """Sender domains against all hosts of the pages."""
    hosts = table(spark, sf_dir, "pages").select(P.url_host(F.col("url")).alias("host"))
    pairs = names.similar_names(parsed(spark, sf_dir), hosts, 0.5, "sender_domain", "host")
    return pairs.select(F.col("name").alias("domain"), F.col("entry").alias("host"), r6("similarity").alias("similarity"))


@query(
    "risk_score",
    f"{_RISK} SELECT mail_id, {sql_r6('risk_score')} AS risk_score, array_to_string(signals, ' | ') AS signals FROM risk",
)
def risk_score(spark, sf_dir):
    return analyzed(spark, sf_dir).select(
        "mail_id", r6("risk_score").alias("risk_score"), F.array_join("signals", " | ").alias("signals")
    )


_TEXT_RISK = f"WITH {duck.MAILS}, {duck.rules('mails', headers=False)}"


@query(
    "risk_text_only",
    f"""{_TEXT_RISK} SELECT mail_id, {sql_r6('risk_score')} AS risk_score, array_to_string(signals, ' | ') AS signals,
  subtype, risk_level FROM risk""",
)
def risk_text_only(spark, sf_dir):
    m = R.analyze(mails(spark, sf_dir), headers=False)
    return m.select(
        "mail_id", r6("risk_score").alias("risk_score"), F.array_join("signals", " | ").alias("signals"), "subtype",
        "risk_level",
    )


@query("attack_subtype", f"{_RISK} SELECT mail_id, subtype FROM risk")
def attack_subtype(spark, sf_dir):
    return analyzed(spark, sf_dir).select("mail_id", "subtype")


@query("risk_level", f"{_RISK} SELECT mail_id, risk_level FROM risk")
def risk_level(spark, sf_dir):
    return analyzed(spark, sf_dir).select("mail_id", "risk_level")


# --- classification --------------------------------------------------------
# corpus: labelled mails; queries: the ones without label
_MAIL_SRC = f"src AS (SELECT mail_id id, category, {duck.combined()} txt FROM mails)"
_SETS = "corpus AS (SELECT id, category FROM src WHERE category IS NOT NULL), qs AS (SELECT id FROM src WHERE category IS NULL)"


def classifier(spark, sf_dir, **kwargs) -> C.Classifier:
    labelled = mails(spark, sf_dir).where("category IS NOT NULL")
    corpus = labelled.select(
        F.col("mail_id").alias("vec_id"),
        "category",
        vz.vectorize(combine_mail("subject", "body")).alias("embedding"),
    )
    return C.Classifier(corpus, **kwargs)


def unlabelled(spark, sf_dir) -> DataFrame:
    return mails(spark, sf_dir).where("category IS NULL").drop("category")


_STAGE1 = f"{duck.features('src', 'enhanced')}, {duck.vector_knn('qs', 'corpus', V.VOTE_K, 'knn')}, " + duck.votes(
    "knn", "votes", duck.CATEGORY_ORDER
)


@query(
    "classify_text",
    f"""WITH {duck.MAILS}, {_MAIL_SRC}, {_SETS}, {_STAGE1}, {duck.rules('mails', headers=False)}
SELECT qid AS mail_id, votes.category, {sql_r6('confidence')} AS confidence,
  CASE WHEN votes.category = 'attack' THEN subtype END AS subtype,
  CASE WHEN votes.category = 'attack' THEN {sql_r6('risk_score')} END AS risk_score
FROM votes JOIN risk ON risk.mail_id = votes.qid""",
)
def classify_text(spark, sf_dir):
    out = classifier(spark, sf_dir).classify_text(unlabelled(spark, sf_dir))
    return out.select(
        "mail_id", "category", r6("confidence").alias("confidence"), "subtype", r6("risk_score").alias("risk_score")
    )


@query(
    "classify_text_index",
    f"""WITH {duck.MAILS}, {_MAIL_SRC}, {_SETS}, {_STAGE1}
SELECT qid AS mail_id, votes.category, {sql_r6('confidence')} AS confidence FROM votes""",
)
def classify_text_index(spark, sf_dir):
    """With an index the index is searched; with all cells probed the result is that of the scan."""
    base = classifier(spark, sf_dir)
    index = ann.class_mean_index(base.corpus, "category")
    out = C.Classifier(base.corpus, index=index, n_probe=index.n_cells).classify_text(unlabelled(spark, sf_dir))
    return out.select("mail_id", "category", r6("confidence").alias("confidence"))


@query(
    "classify_missing_category",
    f"""WITH {duck.MAILS}, {_MAIL_SRC}, {_SETS.replace('category IS NOT NULL', "category IN ('safe', 'attack')")}, {_STAGE1}
SELECT qid AS mail_id, votes.category, {sql_r6('confidence')} AS confidence FROM votes""",
)
def classify_missing_category(spark, sf_dir):
    """A category without any training mail cannot win."""
    corpus = classifier(spark, sf_dir).corpus.where("category <> 'spam'")
    out = C.Classifier(corpus).classify_text(unlabelled(spark, sf_dir))
    return out.select("mail_id", "category", r6("confidence").alias("confidence"))


# held-out evaluation: a fifth of the labelled mails are the cases, the others the corpus
_HELD_SETS = (
    "corpus AS (SELECT id, category FROM src WHERE category IS NOT NULL AND id % 5 <> 0), "
    "qs AS (SELECT id FROM src WHERE category IS NOT NULL AND id % 5 = 0)"
)


def held_out(spark, sf_dir) -> tuple[C.Classifier, DataFrame]:
    corpus = classifier(spark, sf_dir).corpus.where("vec_id % 5 <> 0")
    return C.Classifier(corpus), mails(spark, sf_dir).where("category IS NOT NULL AND mail_id % 5 = 0")


def evaluation_report(detail: DataFrame) -> DataFrame:
    return detail.select(
        "mail_id", "expected", "category", "correct", r6("confidence").alias("confidence"), "subtype",
        r6("risk_score").alias("risk_score"),
    )


@query(
    "evaluate_text",
    f"""WITH {duck.MAILS}, {_MAIL_SRC}, {_HELD_SETS}, {_STAGE1}, {duck.rules('mails', headers=False)}
SELECT qid AS mail_id, src.category AS expected, votes.category, votes.category = src.category AS correct,
  {sql_r6('confidence')} AS confidence, CASE WHEN votes.category = 'attack' THEN subtype END AS subtype,
  CASE WHEN votes.category = 'attack' THEN {sql_r6('risk_score')} END AS risk_score
FROM votes JOIN risk ON risk.mail_id = votes.qid JOIN src ON src.id = votes.qid""",
)
def evaluate_text(spark, sf_dir):
    """Two-stage evaluation on subject and body, case by case."""
    c, cases = held_out(spark, sf_dir)
    expected = cases.select("mail_id", F.col("category").alias("expected"))
    return evaluation_report(C.evaluate(c.classify_text(cases.select("mail_id", "subject", "body")), expected))


_RAW_COLS = ["mail_id", "category", "confidence", "score_safe", "score_spam", "score_attack", "subtype", "risk_score",
             "risk_level", "signals"]
_RAW_SQL = f"""WITH {duck.MAILS}, {duck.PARSED},
src AS (SELECT p.mail_id id, p.category,
  CASE WHEN p.category IS NULL THEN {duck.combined('p.subject', 'p.body')} ELSE {duck.combined('m.subject', 'm.body')} END txt
  FROM parsed p JOIN mails m USING (mail_id)),
{_SETS}, {_STAGE1}, {duck.SQUATS}, {duck.rules('parsed')},
wide AS (SELECT qid, max(score) FILTER (category = 'safe') s1, max(score) FILTER (category = 'spam') s2,
  max(score) FILTER (category = 'attack') s3 FROM votes_scores GROUP BY qid)
SELECT qid AS mail_id, votes.category, {sql_r6('confidence')} AS confidence, {sql_r6('s1')} AS score_safe,
  {sql_r6('s2')} AS score_spam, {sql_r6('s3')} AS score_attack, subtype, {sql_r6('risk_score')} AS risk_score, risk_level,
  array_to_string(signals, ' | ') AS signals
FROM votes JOIN wide USING (qid) JOIN risk ON risk.mail_id = votes.qid"""


def raw_report(classified: DataFrame) -> DataFrame:
    score = lambda i: r6(F.get("scores", F.lit(i)))
    return classified.select(
        "mail_id", "category", r6("confidence").alias("confidence"), score(0).alias("score_safe"),
        score(1).alias("score_spam"), score(2).alias("score_attack"), "subtype", r6("risk_score").alias("risk_score"),
        "risk_level", F.array_join("signals", " | ").alias("signals"),
    )


@query("classify_raw", _RAW_SQL)
def classify_raw(spark, sf_dir):
    """Flagship: raw messages in, category, confidence and risk report out."""
    return raw_report(classifier(spark, sf_dir).classify_raw(unlabelled(spark, sf_dir).select("mail_id", "raw")))


@query("classify_raw_files", _RAW_SQL)
def classify_raw_files(spark, sf_dir):
    """The same from a folder with a file for each message."""
    folder = f"{ensure_checkpoint_dir(spark)}/inbox-{uuid.uuid4().hex}"
    index = src.write_raw_mail(unlabelled(spark, sf_dir).select("mail_id", "raw"), folder)
    files = src.named_raw_mail(src.load_raw_mail(spark, folder), index)
    return raw_report(classifier(spark, sf_dir).classify_raw(files))


@query("classify_raw_joined", _RAW_SQL)
def classify_raw_joined(spark, sf_dir):
    """The same with the plan for a corpus too large for a broadcast."""
    c = classifier(spark, sf_dir, broadcast_bytes=0)
    return raw_report(c.classify_raw(unlabelled(spark, sf_dir).select("mail_id", "raw")))


@query(
    "evaluate_raw",
    f"""WITH {duck.MAILS}, {duck.PARSED},
src AS (SELECT p.mail_id id, p.category,
  CASE WHEN p.category IS NOT NULL AND p.mail_id % 5 = 0 THEN {duck.combined('p.subject', 'p.body')}
    ELSE {duck.combined('m.subject', 'm.body')} END txt
  FROM parsed p JOIN mails m USING (mail_id)),
{_HELD_SETS}, {_STAGE1}, {duck.SQUATS}, {duck.rules('parsed')}
SELECT qid AS mail_id, src.category AS expected, votes.category, votes.category = src.category AS correct,
  {sql_r6('confidence')} AS confidence, subtype, {sql_r6('risk_score')} AS risk_score
FROM votes JOIN risk ON risk.mail_id = votes.qid JOIN src ON src.id = votes.qid""",
)
def evaluate_raw(spark, sf_dir):
    """The same on raw messages, all rules on every case."""
    c, cases = held_out(spark, sf_dir)
    expected = cases.select("mail_id", F.col("category").alias("expected"))
    return evaluation_report(C.evaluate(c.classify_raw(cases.select("mail_id", "raw")), expected))


_DOC_SRC = f"""src AS (SELECT doc_id id, {duck.combined('source', 'text')} txt,
  CASE WHEN toxic = 1 THEN 'attack' WHEN quality = 0 THEN 'spam' WHEN quality = 1 THEN 'safe' END category
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _vote_ctes(queries: str, others: bool = False) -> str:
    return (
        f"{duck.features('src', 'basic')}, {duck.vector_knn(queries, 'corpus', V.VOTE_K, 'knn', others=others)}, "
        + duck.votes("knn", "votes", duck.CATEGORY_ORDER)
    )


_BASIC = f"WITH {_DOC_SRC}, {_SETS}, {_vote_ctes('qs')}"


def documents_labelled(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr(CATEGORY).alias("category"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("mail_id"), combine_mail("source", "text").alias("txt"), "category")


def _basic(spark, sf_dir, **kwargs) -> tuple[C.Classifier, DataFrame]:
    docs = documents_labelled(spark, sf_dir)
    corpus = docs.where("category IS NOT NULL").select(
        F.col("mail_id").alias("vec_id"), "category", vz.vectorize(F.col("txt"), "basic").alias("embedding")
    )
    return C.Classifier(corpus, profile="basic", **kwargs), docs


def classify_documents(spark, sf_dir) -> DataFrame:
    c, docs = _basic(spark, sf_dir)
    return c.stage1(docs.where("category IS NULL"), "mail_id", F.col("txt"))


@query("classify_basic", f"{_BASIC} SELECT qid AS mail_id, category, {sql_r6('confidence')} AS confidence FROM votes")
def classify_basic(spark, sf_dir):
    return classify_documents(spark, sf_dir).select("mail_id", "category", r6("confidence").alias("confidence"))


@query(
    "classify_summary",
    f"""{_BASIC} SELECT category, count(*) AS n_mails, {sql_r6('100.0 * count(*) / (SELECT count(*) FROM votes)')} AS percent
FROM votes GROUP BY 1""",
)
def classify_summary(spark, sf_dir):
    return C.category_summary(classify_documents(spark, sf_dir)).withColumn("percent", r6("percent"))


# evaluation: every labelled document is a case, scored against all other labelled ones
_CASES = f"WITH {_DOC_SRC}, corpus AS (SELECT id, category FROM src WHERE category IS NOT NULL), " + _vote_ctes("corpus", others=True)


def evaluated(spark, sf_dir, **kwargs) -> DataFrame:
    c, docs = _basic(spark, sf_dir, leave_out_own=True, **kwargs)
    cases = docs.where("category IS NOT NULL")
    return C.evaluate(
        c.stage1(cases, "mail_id", F.col("txt")), cases.select("mail_id", F.col("category").alias("expected"))
    )


@query(
    "evaluate_summary",
    f"""{_CASES} SELECT count(*) AS total, count(*) FILTER (votes.category = corpus.category) AS correct, 0::BIGINT AS skipped,
  {sql_r6('100.0 * count(*) FILTER (votes.category = corpus.category) / count(*)')} AS accuracy
FROM votes JOIN corpus ON id = qid""",
)
def evaluate_summary(spark, sf_dir):
    return C.evaluation_summary(evaluated(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query(
    "evaluate_misses",
    f"""{_CASES} SELECT id AS mail_id, corpus.category AS expected, votes.category, {sql_r6('confidence')} AS confidence
FROM votes JOIN corpus ON id = qid WHERE votes.category <> corpus.category""",
)
def evaluate_misses(spark, sf_dir):
    return C.evaluation_misses(evaluated(spark, sf_dir)).select(
        "mail_id", "expected", "category", r6("confidence").alias("confidence")
    )


@query(
    "evaluate_joined",
    f"""{_CASES} SELECT id AS mail_id, corpus.category AS expected, votes.category, {sql_r6('confidence')} AS confidence
FROM votes JOIN corpus ON id = qid""",
)
def evaluate_joined(spark, sf_dir):
    """Every case, by the plan for two large sides."""
    return evaluated(spark, sf_dir, broadcast_bytes=0).select("mail_id", "expected", "category", r6("confidence").alias("confidence"))


@query(
    "train_corpus",
    f"""WITH {duck.MAILS}, src AS (SELECT mail_id id, {duck.combined()} txt FROM mails WHERE category IS NOT NULL),
{duck.features('src', 'enhanced')}
SELECT id AS vec_id, category, '{{"subject":"' || replace(subject, '"', chr(92) || '"') || '"}}' AS metadata, bucket,
  {sql_r6('value::FLOAT')} AS value FROM f_vec JOIN mails ON mail_id = id""",
)
def train_corpus(spark, sf_dir):
    rows = C.train_corpus(mails(spark, sf_dir).where("category IS NOT NULL"))
    return (
        rows.select("vec_id", "category", "metadata", F.posexplode_outer("embedding").alias("bucket", "value"))
        .where("value <> 0")
        .withColumn("value", r6("value"))
    )


def _corpus_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"


def _corpus_rows(rows: DataFrame) -> DataFrame:
    items = rows.select("vec_id", "category", "metadata", F.posexplode_outer("embedding").alias("bucket", "value"))
    return items.where("value <> 0").withColumn("value", r6("value"))


def _corpus_sql(where: str) -> str:
    return f"""WITH {duck.MAILS}, src AS (SELECT mail_id id, {duck.combined()} txt FROM mails WHERE category IS NOT NULL AND {where}),
{duck.features('src', 'enhanced')}
SELECT id AS vec_id, category, '{{"subject":"' || replace(subject, '"', chr(92) || '"') || '"}}' AS metadata, bucket,
  {sql_r6('value::FLOAT')} AS value FROM f_vec JOIN mails ON mail_id = id"""


@query(
    "corpus_diff",
    f"""WITH {duck.MAILS}, asrc AS (SELECT mail_id id, {duck.combined()} txt FROM mails WHERE category IS NOT NULL AND mail_id % 5 <> 0),
bsrc AS (SELECT mail_id id, {duck.combined("''", 'body')} txt FROM mails WHERE category IS NOT NULL AND mail_id % 7 <> 0),
{duck.features('asrc', 'enhanced', 'a')}, {duck.features('bsrc', 'enhanced', 'b')},
cells AS (SELECT coalesce(a_vec.id, b_vec.id) id, coalesce(a_vec.value::FLOAT::DOUBLE, 0) x, coalesce(b_vec.value::FLOAT::DOUBLE, 0) y
  FROM a_vec FULL JOIN b_vec ON a_vec.id = b_vec.id AND a_vec.bucket = b_vec.bucket)
SELECT i.id AS vec_id, CASE WHEN i.id % 5 = 0 THEN 'right' WHEN i.id % 7 = 0 THEN 'left' ELSE 'both' END AS side,
  {sql_r6('1 - coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0)')} AS distance,
  (count(*) FILTER (abs(x - y) > 0.001))::INTEGER AS n_diff
FROM (SELECT id FROM asrc UNION SELECT id FROM bsrc) i LEFT JOIN cells USING (id) GROUP BY i.id""",
)
def corpus_diff(spark, sf_dir):
    """Two written corpora, one without subjects; each lacks some mails of the other."""
    m = mails(spark, sf_dir).where("category IS NOT NULL")
    one, two = _corpus_folder(spark), _corpus_folder(spark)
    write_corpus(C.train_corpus(m.where("mail_id % 5 <> 0")), one)
    write_corpus(C.train_corpus(m.where("mail_id % 7 <> 0").withColumn("subject", F.lit(""))), two)
    out = vz.table_diff(read_corpus(spark, one), read_corpus(spark, two))
    return out.withColumn("distance", r6("distance"))


@query("corpus_append", _corpus_sql("true"))
def corpus_append(spark, sf_dir):
    """Two loads into one corpus, one of them repeated, and all of it read back."""
    path, rows = _corpus_folder(spark), C.train_corpus(mails(spark, sf_dir).where("category IS NOT NULL"))
    write_corpus(rows.where("category <> 'spam'"), path)
    for _ in range(2):
        write_corpus(rows.where("category = 'spam'"), path, batch="second")
    return _corpus_rows(read_corpus(spark, path))


@query("corpus_replace", _corpus_sql("(category <> 'spam' OR mail_id % 2 = 0)"))
def corpus_replace(spark, sf_dir):
    """A load that replaces the one category it holds."""
    path, rows = _corpus_folder(spark), C.train_corpus(mails(spark, sf_dir).where("category IS NOT NULL"))
    write_corpus(rows, path)
    write_corpus(rows.where("category = 'spam' AND vec_id % 2 = 0"), path, mode="replace")
    return _corpus_rows(read_corpus(spark, path))
