"""Queries over ``documents``, ``events`` and ``mails`` that featurize text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.functions import fixed_values as V
from mailvane.functions import text as X
from mailvane.functions.hashing import bucket, fnv1a, sign
from mailvane.functions.jsontext import json_text
from mailvane.operators import vectorize as vz
from mailvane.plans import duck
from mailvane.plans.mails import mails, table
from mailvane.plans.registry import query, r6, sql_r6


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _positions(df: DataFrame, id_col: str, tokens) -> DataFrame:
    return df.select(id_col, F.posexplode(tokens).alias("pos", "token"))


def _token_sql(expr: str, source: str = "documents", id_col: str = "doc_id", head: str = "") -> str:
    return f"""{head}SELECT {id_col}, (generate_subscripts(ws, 1) - 1)::INTEGER AS pos, unnest(ws) AS token
FROM (SELECT {id_col}, {expr} ws FROM {source})"""


@query("tokenize_ascii", _token_sql(duck.words("text", duck.ASCII_SPLIT)))
def tokenize_ascii(spark, sf_dir):
    return _positions(docs(spark, sf_dir), "doc_id", X.ascii_tokens("text"))


@query("tokenize_unicode", _token_sql(duck.words("text")))
def tokenize_unicode(spark, sf_dir):
    return _positions(docs(spark, sf_dir), "doc_id", X.unicode_tokens("text"))


@query("stopwords", _token_sql(duck.kept("text")))
def stopwords(spark, sf_dir):
    return _positions(docs(spark, sf_dir), "doc_id", X.remove_stop_words(X.unicode_tokens("text")))


_VOCAB = f"vocab AS MATERIALIZED (SELECT DISTINCT unnest({duck.words('text')}) word FROM documents)"
_HASHED = f"{_VOCAB}, hashed AS MATERIALIZED (SELECT word, {duck.fnv('hx')} AS hash FROM (SELECT word, hex(word) hx FROM vocab))"


@query("fnv_hash", f"WITH {_HASHED} SELECT word, hash, (hash % 256)::INTEGER AS bucket FROM hashed")
def fnv_hash(spark, sf_dir):
    return vz.vocabulary(docs(spark, sf_dir), X.unicode_tokens("text"), V.ENHANCED_DIM)


@query(
    "sign_hash",
    # the check folds from the other offset basis
    f"WITH {_VOCAB} SELECT word, CASE WHEN s & 1 = 1 THEN 1 ELSE -1 END AS sign FROM "
    f"(SELECT word, {duck.fnv('hx').replace(str(V.FNV_OFFSET), '2147483647')} s FROM "
    "(SELECT word, hex(word) hx FROM vocab))",
)
def sign_hash(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(X.unicode_tokens("text")).alias("word")).distinct()
    return words.select("word", sign(fnv1a(F.col("word"))).alias("sign"))


@query(
    "unigram_counts",
    f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({duck.kept('text')}) word FROM documents) GROUP BY 1, 2",
)
def unigram_counts(spark, sf_dir):
    return vz.unigram_counts(docs(spark, sf_dir), "doc_id", X.remove_stop_words(X.unicode_tokens("text")))


_BOOSTS = " ".join(f"WHEN '{w}' THEN {b}" for w, b in {**V.SPAM_BOOST, **V.ATTACK_BOOST}.items())


@query(
    "boosted_unigrams",
    f"""WITH {duck.MAILS} SELECT mail_id, word, count(*) AS n,
  {sql_r6(f'count(*) * (CASE word {_BOOSTS} ELSE 1.0 END)::DOUBLE')} AS weight
FROM (SELECT mail_id, unnest({duck.kept('body')}) word FROM mails) GROUP BY 1, 2""",
)
def boosted_unigrams(spark, sf_dir):
    out = vz.boosted_unigrams(mails(spark, sf_dir), "mail_id", X.remove_stop_words(X.unicode_tokens("body")))
    return out.withColumn("weight", r6("weight"))


@query(
    "bigrams",
    f"""SELECT doc_id, bigram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 1),
  lambda i: ws[i] || '_' || ws[i + 1])) bigram FROM (SELECT doc_id, {duck.kept('text')} ws FROM documents)) GROUP BY 1, 2""",
)
def bigrams(spark, sf_dir):
    pairs = X.bigrams(X.remove_stop_words(X.unicode_tokens("text")))
    return vz.feature_counts(docs(spark, sf_dir), "doc_id", pairs, "bigram")


@query(
    "char_trigrams",
    f"""SELECT doc_id, trigram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(
  generate_series(1, length(h) // 2 - 2), lambda i: substr(h, 2 * i - 1, 6))) trigram
  FROM (SELECT doc_id, hex(unnest({duck.kept('text')})) h FROM documents)) GROUP BY 1, 2""",
)
def char_trigrams(spark, sf_dir):
    return vz.trigram_counts(docs(spark, sf_dir), "doc_id", X.remove_stop_words(X.unicode_tokens("text")))


@query("leet_normalize", f"WITH {duck.MAILS} SELECT mail_id, {duck.leet('lower(body)')} AS text FROM mails")
def leet_normalize(spark, sf_dir):
    return mails(spark, sf_dir).select("mail_id", X.normalize_leet(F.lower("body")).alias("text"))


@query("combine_mail", f"WITH {duck.MAILS} SELECT mail_id, {duck.combined()} AS text FROM mails")
def combine(spark, sf_dir):
    return mails(spark, sf_dir).select("mail_id", X.combine_mail("subject", "body").alias("text"))


_MAIL_TEXT = f"src AS (SELECT mail_id id, {duck.combined()} txt FROM mails)"
_DOC_TEXT = "src AS (SELECT doc_id id, text txt FROM documents)"


@query(
    "two_pass_features",
    f"WITH {duck.MAILS}, {_MAIL_TEXT}, {duck.features('src', 'enhanced')} "
    f"SELECT id AS mail_id, ft AS feature, {sql_r6('wt')} AS weight FROM f_feat",
)
def two_pass_features(spark, sf_dir):
    out = vz.enhanced_features(mails(spark, sf_dir), "mail_id", X.combine_mail("subject", "body"))
    return out.withColumn("weight", r6("weight"))


def _vector_query(name: str, profile: str, of_mails: bool) -> None:
    head = f"{duck.MAILS}, {_MAIL_TEXT}" if of_mails else _DOC_TEXT
    id_col = "mail_id" if of_mails else "doc_id"

    @query(
        name,
        f"WITH {head}, {duck.features('src', profile)} "
        f"SELECT id AS {id_col}, bucket, {sql_r6('value')} AS value FROM f_vec",
    )
    def run(spark, sf_dir):
        df = mails(spark, sf_dir) if of_mails else docs(spark, sf_dir)
        text = X.combine_mail("subject", "body") if of_mails else F.col("text")
        vectors = df.select(id_col, vz.vectorize(text, profile).alias("vector"))
        return vz.sparse(vectors, id_col).withColumn("value", r6("value"))


_vector_query("vectorize_basic", "basic", False)
_vector_query("vectorize_enhanced", "enhanced", False)
_vector_query("vectorize_counts", "counts", False)
_vector_query("vectorize_mails", "enhanced", True)


@query(
    "json_flatten",
    "SELECT event_id, 'key:k ' || printf('%.6g', json_extract_string(props, '$.k')::DOUBLE) AS text FROM events",
)
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", json_text(F.col("props")).alias("text"))


@query(
    "vectorize_json",
    f"""WITH src AS (SELECT event_id id, 'key:k ' || printf('%.6g', json_extract_string(props, '$.k')::DOUBLE) txt
  FROM events), {duck.features('src', 'basic')} SELECT id AS event_id, bucket, {sql_r6('value')} AS value FROM f_vec""",
)
def vectorize_json(spark, sf_dir):
    vectors = table(spark, sf_dir, "events").select("event_id", vz.vectorize_json(F.col("props")).alias("vector"))
    return vz.sparse(vectors, "event_id").withColumn("value", r6("value"))


@query(
    "hash_collisions",
    f"""WITH {_HASHED} SELECT (hash % 256)::INTEGER AS bucket, count(*) AS n_words, min(word) AS first_word,
  max(word) AS last_word FROM hashed GROUP BY 1 HAVING count(*) > 1""",
)
def hash_collisions(spark, sf_dir):
    return vz.hash_collisions(vz.vocabulary(docs(spark, sf_dir), X.unicode_tokens("text"), V.ENHANCED_DIM))


@query(
    "collision_words",
    f"""WITH {_HASHED} SELECT (hash % 256)::INTEGER AS bucket, word, hash FROM hashed
QUALIFY count(*) OVER (PARTITION BY hash % 256) > 1""",
)
def collision_words(spark, sf_dir):
    return vz.collision_words(vz.vocabulary(docs(spark, sf_dir), X.unicode_tokens("text"), V.ENHANCED_DIM))


@query(
    "profile_diff",
    f"""WITH {_DOC_TEXT}, {duck.features('src', 'basic', 'a')}, {duck.features('src', 'enhanced', 'b')}
SELECT d.doc_id, {sql_r6('1 - coalesce(sum(x * y), 0)')} AS distance,
  (count(*) FILTER (abs(x - y) > 0.001))::INTEGER AS n_diff
FROM documents d LEFT JOIN (SELECT coalesce(a_vec.id, b_vec.id) id, coalesce(a_vec.value, 0) x, coalesce(b_vec.value, 0) y
  FROM a_vec FULL JOIN b_vec ON a_vec.id = b_vec.id AND a_vec.bucket = b_vec.bucket) ON id = d.doc_id GROUP BY 1""",
)
def profile_diff(spark, sf_dir):
    out = vz.profile_diff(docs(spark, sf_dir), "doc_id", F.col("text"))
    return out.withColumn("distance", r6("distance"))
