"""Building blocks of the check SQL (DuckDB dialect).

Written independently of the Spark expressions: relational feature tables instead
of dense vectors, regular expressions instead of line folding, nested-loop k-NN.
"""

from __future__ import annotations

from mailvane.functions import fixed_values as V
from mailvane.plans.mails import MAILS_SQL


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(V.STOP_WORDS)
UNICODE_SPLIT = r"[^\p{L}\p{Nd}]+"
ASCII_SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
MAILS = f"mails AS ({MAILS_SQL})"
WORD_TRIM = ".,!?;:\"''"


def words(text: str, pattern: str = UNICODE_SPLIT) -> str:
    lowered = f"lower({text})" if pattern == UNICODE_SPLIT else (
        f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    return f"list_filter(regexp_split_to_array({lowered}, '{pattern}'), lambda t: t <> '')"


def kept(text: str) -> str:
    return f"list_filter({words(text)}, lambda t: t NOT IN ({STOP}))"


def leet(text: str) -> str:
    fields = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda t: t <> '')"
    one = (
        rf"CASE WHEN regexp_matches(w, '\p{{L}}') THEN translate(w, '{V.LEET_FROM}', '{V.LEET_TO}') ELSE w END"
    )
    return f"coalesce(array_to_string(list_transform({fields}, lambda w: {one}), ' '), '')"


def combined(subject: str = "subject", body: str = "body") -> str:
    return f"'subject: ' || coalesce({subject}, '') || ' body: ' || coalesce({body}, '')"


def fnv(hex_text: str) -> str:
    digit = lambda off: f"(strpos('0123456789ABCDEF', substr({hex_text}, 2 * i{off}, 1)) - 1)"
    octets = (
        f"list_transform(generate_series(1, length({hex_text}) // 2), "
        f"lambda i: (16 * {digit(' - 1')} + {digit('')})::BIGINT)"
    )
    return (
        f"list_reduce(list_prepend({V.FNV_OFFSET}::BIGINT, {octets}), "
        f"lambda a, b: (xor(a, b) * {V.FNV_PRIME}) & 4294967295)"
    )


def features(source: str, profile: str, name: str = "f") -> str:
    """CTEs ending in ``{name}_vec(id, bucket, value)`` for ``source(id, txt)``."""
    boosts = " ".join(f"WHEN '{w}' THEN {b}" for w, b in {**V.SPAM_BOOST, **V.ATTACK_BOOST}.items())
    if profile == "enhanced":
        lists = (
            f"SELECT id, 1.0::DOUBLE base, {kept('txt')} ws FROM {source} UNION ALL "
            f"SELECT id, 0.5::DOUBLE, {kept('lt')} FROM (SELECT id, lower(txt) lo, {leet('lower(txt)')} lt "
            f"FROM {source}) WHERE lo <> lt"
        )
    elif profile == "basic":
        lists = f"SELECT id, 1.0::DOUBLE base, {words('txt', ASCII_SPLIT)} ws FROM {source}"
    else:
        lists = f"SELECT id, 1.0::DOUBLE base, {kept('txt')} ws FROM {source}"
    parts = [
        f"SELECT id, hex(w) ft, base * {f'(CASE w {boosts} ELSE 1.0 END)' if profile == 'enhanced' else '1.0'}::DOUBLE"
        f" wt FROM (SELECT id, base, unnest(ws) w FROM {name}_lists)"
    ]
    if profile != "counts":
        parts.append(
            f"SELECT id, hex(g), base * 0.7::DOUBLE FROM (SELECT id, base, unnest(list_transform("
            f"generate_series(1, len(ws) - 1), lambda i: ws[i] || '_' || ws[i + 1])) g FROM {name}_lists)"
        )
    if profile == "enhanced":
        parts.append(
            f"SELECT id, unnest(list_transform(generate_series(1, length(h) // 2 - 2), "
            f"lambda i: substr(h, 2 * i - 1, 6))), base * 0.3::DOUBLE FROM "
            f"(SELECT id, base, hex(unnest(ws)) h FROM {name}_lists) WHERE length(h) >= 6"
        )
    dim, signed = (V.COUNTS_DIM, False) if profile == "counts" else (V.ENHANCED_DIM, True)
    sign = "CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END" if signed else "1"
    return f"""
{name}_lists AS MATERIALIZED ({lists}),
{name}_feat AS MATERIALIZED (SELECT id, ft, sum(wt) wt FROM ({' UNION ALL '.join(parts)}) GROUP BY id, ft),
{name}_hash AS MATERIALIZED (SELECT ft, {fnv('ft')} h FROM (SELECT DISTINCT ft FROM {name}_feat)),
{name}_acc AS MATERIALIZED (SELECT id, (h % {dim})::INTEGER bucket, sum(wt * {sign}) v
  FROM {name}_feat JOIN {name}_hash USING (ft) GROUP BY 1, 2),
{name}_vec AS MATERIALIZED (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {name}_acc
  WHERE v <> 0)"""


def dkey(d: str) -> str:
    return f"floor({d} * 1e9 + 0.5)"


def vector_knn(queries: str, corpus: str, k: int, name: str, dim: int = V.ENHANCED_DIM, others: bool = False) -> str:
    """CTE ``{name}(qid, category, vec_id, distance, rank)``: every pair of unit vectors of f_vec.

    ``queries(id)`` and ``corpus(id, category)`` name relations; with ``others`` no query meets its own row.
    """
    apart = " WHERE q.id <> c.id" if others else ""
    return f"""
f_dense AS MATERIALIZED (SELECT id, list(coalesce(value, 0.0)::DOUBLE ORDER BY bucket) v FROM
  (SELECT id, unnest(generate_series(0, {dim - 1}))::INTEGER bucket FROM src) LEFT JOIN f_vec USING (id, bucket)
  GROUP BY id),
{name}_pairs AS (SELECT q.id qid, c.category, c.id vec_id, 1 - list_inner_product(a.v, b.v) distance
  FROM {queries} q JOIN f_dense a ON a.id = q.id CROSS JOIN {corpus} c JOIN f_dense b ON b.id = c.id{apart}),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, category
  ORDER BY {dkey('distance')}, vec_id)::INTEGER rank FROM {name}_pairs QUALIFY rank <= {k})"""


def votes(knn: str, name: str, order: str) -> str:
    """CTE ``{name}(qid, category, confidence)`` from a per-category k-NN CTE."""
    return f"""
{name}_scores AS (SELECT qid, category, avg(distance) score, count(*) n_matches FROM {knn} GROUP BY 1, 2),
{name} AS (
  SELECT qid, arg_min(category, {{'s': score, 'o': {order}}}) category,
    least(greatest(CASE WHEN list_sort(list(score))[2] > 0.0001
      THEN 1 - list_sort(list(score))[1] / list_sort(list(score))[2] ELSE 0 END, 0), 1)::DOUBLE confidence
  FROM {name}_scores GROUP BY qid)"""


CATEGORY_ORDER = "CASE category WHEN 'safe' THEN 1 WHEN 'spam' THEN 2 ELSE 3 END"


def header(key: str) -> str:
    return f"coalesce(list_filter(hdrs, lambda e: e.k = '{key}')[1].v, '')"


def address(column: str) -> str:
    bare = f"trim(trim({column}), '\"'' ')"
    return (
        f"CASE WHEN regexp_matches({column}, '<[^<>]*>[^<]*$') THEN "
        f"trim(regexp_extract({column}, '<([^<>]*)>[^<]*$', 1)) "
        f"WHEN contains({bare}, '@') THEN {bare} ELSE '' END"
    )


def domain(column: str) -> str:
    return f"lower(rtrim(regexp_extract(trim({column}), '@([^@]*)$', 1), '>. '))"


def verdict(method: str) -> str:
    return rf"regexp_extract(lower(auth_results), '{method}=([^ \t;\n\r]*)', 1)"


# mails -> parsed(mail_id, category, named fields, received, body, domains, verdicts)
PARSED = f"""
m1 AS (SELECT mail_id, category, replace(raw, chr(13) || chr(10), chr(10)) r FROM mails),
m2 AS (SELECT *, strpos(r, chr(10) || chr(10)) b FROM m1),
m3 AS (SELECT *, CASE WHEN b > 0 THEN substr(r, 1, b - 1) ELSE r END cand FROM m2),
m4 AS (SELECT *, CASE WHEN contains(split_part(cand, chr(10), 1), ':') THEN cand ELSE '' END head FROM m3),
m5 AS MATERIALIZED (SELECT *, CASE WHEN head = '' THEN r WHEN b > 0 THEN substr(r, b + 2) ELSE '' END body,
  list_transform(list_filter(string_split(regexp_replace(head, '\\n[ \\t]+', ' ', 'g'), chr(10)),
    lambda l: contains(l, ':')),
    lambda l: {{'k': lower(trim(split_part(l, ':', 1))), 'v': trim(substr(l, strpos(l, ':') + 1))}}) hdrs FROM m4),
m6 AS (SELECT mail_id, category, r, head, hdrs, body,
  {header('from')} from_header, {header('to')} to_header,
  CASE WHEN head = '' THEN trim(split_part(r, chr(10), 1)) ELSE {header('subject')} END subject,
  {header('date')} date_header, {header('reply-to')} reply_to, {header('return-path')} return_path,
  {header('content-type')} content_type, {header('x-mailer')} x_mailer, {header('message-id')} message_id,
  {header('authentication-results')} auth_results,
  list_transform(list_filter(hdrs, lambda e: e.k = 'received'), lambda e: e.v) received FROM m5),
parsed AS MATERIALIZED (SELECT *, {domain(address('from_header'))} sender_domain,
  {domain(address('reply_to'))} reply_to_domain, {domain(address('return_path'))} return_path_domain,
  {verdict('spf')} spf, {verdict('dkim')} dkim, {verdict('dmarc')} dmarc FROM m6)"""


def any_of(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def first_of(text: str, phrases) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{p}') THEN '{p}'" for p in phrases) + " END"


def similarity(a: str, b: str) -> str:
    """Edit similarity in single precision (ASCII domains)."""
    return (
        f"(1.0::FLOAT - levenshtein({a}, {b})::FLOAT / greatest(strlen({a}), strlen({b}))::FLOAT)"
    )


_BRANDS = f"(SELECT unnest([{quoted(V.BRAND_DOMAINS)}]) brand, generate_subscripts([{quoted(V.BRAND_DOMAINS)}], 1) o)"
SQUATS = f"""squats AS (SELECT dom, arg_min(brand, o) typosquat FROM
  (SELECT DISTINCT sender_domain dom FROM parsed WHERE sender_domain <> '') JOIN {_BRANDS}
  ON dom <> brand AND {similarity('dom', 'brand')} > 0.7::FLOAT GROUP BY dom)"""

_SINGLE = quoted(t for t in V.URGENCY_TERMS if " " not in t)
_PHRASES = " + ".join(f"contains(lt, '{t}')::INT" for t in V.URGENCY_TERMS if " " in t)
_URGENT = (
    r"list_filter(regexp_split_to_array(lt, '\s+'), lambda w: w <> '')"
)


def rules(source: str, headers: bool = True, name: str = "risk") -> str:
    """CTE ``{name}`` with a column per rule, score, signals, subtype and level."""
    w = {k: f"{v}::FLOAT" for k, v in V.RISK_WEIGHTS.items()}
    if headers:
        first = """(reply_to_domain <> '' AND sender_domain <> '' AND reply_to_domain <> sender_domain) domain_mismatch,
  (return_path_domain <> '' AND sender_domain <> '' AND return_path_domain <> sender_domain) return_path_mismatch,
  spf IN ('fail', 'softfail') spf_fail, dkim = 'fail' dkim_fail, dmarc = 'fail' dmarc_fail, typosquat"""
        origin = f"{source} LEFT JOIN squats ON squats.dom = {source}.sender_domain"
        named = """CASE WHEN domain_mismatch THEN 'Reply-To domain ''' || reply_to_domain ||
    ''' differs from sender domain ''' || sender_domain || '''' END,
    CASE WHEN return_path_mismatch THEN 'Return-Path domain ''' || return_path_domain ||
    ''' differs from sender domain ''' || sender_domain || '''' END,
    CASE WHEN spf_fail THEN 'SPF check: FAIL' END, CASE WHEN dkim_fail THEN 'DKIM check: FAIL' END,
    CASE WHEN dmarc_fail THEN 'DMARC check: FAIL' END,
    'Sender domain ''' || sender_domain || ''' looks like typosquat of ''' || typosquat || '''',"""
    else:
        first = """false domain_mismatch, false return_path_mismatch, false spf_fail, false dkim_fail,
  false dmarc_fail, NULL::VARCHAR typosquat"""
        origin, named = source, ""
    add = lambda cond, key: f"CASE WHEN {cond} THEN {w[key]} ELSE 0::FLOAT END"
    total = " + ".join(
        [
            add("domain_mismatch", "reply_to_mismatch"),
            add("return_path_mismatch", "return_path_mismatch"),
            add("spf_fail", "spf"),
            add("dkim_fail", "dkim"),
            add("dmarc_fail", "dmarc"),
            add("typosquat IS NOT NULL", "typosquat"),
            f"CASE WHEN urgency > 0.3::FLOAT THEN urgency * {w['urgency']} ELSE 0::FLOAT END",
            add("credential_ask", "credential"),
            add("financial_ask", "financial"),
            add("suspicious_links", "links"),
            add("malware IS NOT NULL", "malware"),
        ]
    )
    return f"""
{name}1 AS (SELECT *, lower(subject || ' ' || body) lt, lower(body) lb FROM {source}),
{name}2 AS (SELECT {name}1.*, {first},
  len({_URGENT}) nw, len(list_filter({_URGENT}, lambda w: trim(w, '{WORD_TRIM}') IN ({_SINGLE}))) + {_PHRASES} hits,
  {any_of('lt', V.CREDENTIAL_PHRASES)} credential_ask, {any_of('lt', V.FINANCIAL_PHRASES)} financial_ask,
  {first_of('lt', V.MALWARE_PHRASES)} malware, {any_of('lb', V.LINK_PHRASES)} link_phrase
  FROM {origin.replace(source, name + '1')}),
{name}3 AS (SELECT *, (link_phrase OR typosquat IS NOT NULL) suspicious_links,
  CASE WHEN nw = 0 THEN 0::FLOAT ELSE least(hits::FLOAT / nw::FLOAT * 10::FLOAT, 1::FLOAT) END urgency FROM {name}2),
{name}4 AS (SELECT *, least(0::FLOAT + {total}, 1::FLOAT) risk_score,
  list_filter([{named} CASE WHEN urgency > 0.3::FLOAT THEN 'High urgency language (score: ' ||
      printf('%.2f', urgency::DOUBLE) || ')' END,
    CASE WHEN credential_ask THEN 'Requests credential/personal information' END,
    CASE WHEN financial_ask THEN 'Contains financial/payment request' END,
    CASE WHEN suspicious_links THEN 'Contains suspicious link patterns' END,
    'Malware indicator: contains ''' || malware || ''''], lambda s: s IS NOT NULL) signals,
  CASE WHEN financial_ask AND urgency > 0.2::FLOAT THEN 'CEO_FRAUD' WHEN credential_ask THEN 'CREDENTIAL_HARVEST'
    WHEN domain_mismatch OR spf_fail OR suspicious_links THEN 'PHISHING'
    WHEN malware IS NOT NULL THEN 'MALWARE' ELSE 'GENERIC_ATTACK' END subtype FROM {name}3),
{name} AS MATERIALIZED (SELECT *, CASE WHEN risk_score > 0.6::FLOAT THEN 'HIGH'
  WHEN risk_score > 0.3::FLOAT THEN 'MEDIUM' ELSE 'LOW' END risk_level FROM {name}4)"""
