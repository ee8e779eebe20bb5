"""Queries over the ``embeddings`` table: loading, table operators, math, search, votes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailvane.functions import vectors as M
from mailvane.operators import ann, classdist, knn, lsh, table as tb, tree, vote
from mailvane.plans import duck
from mailvane.plans.mails import table
from mailvane.plans.registry import query, r6, sql_r6
from mailvane.session import ensure_checkpoint_dir
from mailvane.sources import vectors as src
from mailvane.sources.tables import written

DIM = 64
K = 5
# the literal query vector of the one-vector searches
PROBE = [((i * 37) % 19 - 9) / 10 for i in range(DIM)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
PROBE_COL = lambda: F.array(*[F.lit(x) for x in PROBE])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("qid"), "embedding")


# --- sources and sinks -----------------------------------------------------
def vector_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The embeddings as JSON lines, with broken ones of every kind in between."""
    good = F.to_json(
        F.struct(F.col("embedding").alias("vector"), F.struct("vec_id", "label").alias("metadata"))
    )
    kind = F.col("vec_id") % 9
    line = (
        F.when(kind == 1, F.concat(good, F.lit(" trailing")))
        .when(kind == 2, F.concat(F.lit("["), good, F.lit("]")))
        .when(kind == 3, F.replace(good, F.lit('"vector"'), F.lit('"vec"')))
        .when(kind == 4, F.replace(good, F.lit('"vector":['), F.lit('"vector":[0.5,')))
        .when(kind == 5, F.regexp_replace(good, r'"vector":\[[^,]*,', '"vector":["0.5",'))
        .when(kind == 6, F.lit(""))
        .when(kind == 7, F.substr(good, F.lit(1), F.length(good) - 1))
        .otherwise(good)
    )
    return embeddings(spark, sf_dir).select(line.alias("line"), *more)


@query(
    "load_vectors_jsonl",
    """SELECT vec_id, pos::INTEGER AS pos, CASE WHEN vec_id % 9 = 5 AND pos = 0 THEN 0.0 ELSE round(x, 6) + 0.0 END AS value
FROM (SELECT vec_id, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) - 1 pos
  FROM embeddings WHERE vec_id % 9 IN (0, 5, 8))""",
)
def load_vectors(spark, sf_dir):
    good, _ = src.split_rejects(src.tag_vector_lines(vector_lines(spark, sf_dir), DIM))
    vec_id = F.get_json_object("metadata", "$.vec_id").cast("long").alias("vec_id")
    return good.select(vec_id, F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", "pos", r6("value").alias("value")
    )


@query(
    "load_vectors_rejects",
    """SELECT CASE vec_id % 9 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_json' WHEN 7 THEN 'invalid_json'
  WHEN 3 THEN 'missing_vector' WHEN 4 THEN 'wrong_dimension' ELSE 'loaded' END AS outcome, count(*) AS n_lines
FROM embeddings WHERE vec_id % 9 <> 6 GROUP BY 1""",
)
def load_vectors_rejects(spark, sf_dir):
    return src.reject_counts(src.tag_vector_lines(vector_lines(spark, sf_dir), DIM))


def in_files(lines: DataFrame, order: str, n_files: int = 4) -> str:
    """Folder of text files, one per remainder of ``order``, their lines in its order."""
    folder = f"{ensure_checkpoint_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    dealt = lines.withColumn("part", F.col(order) % n_files).repartition(n_files, "part").sortWithinPartitions("part", order)
    dealt.select("part", "line").write.partitionBy("part").text(folder)
    return folder


FILE_PART = lambda: F.regexp_extract("path", r"/part=(\d+)/", 1).cast("long").alias("part")


@query(
    "load_vectors_located",
    """SELECT vec_id % 4 AS part, line_no, CASE vec_id % 9 WHEN 3 THEN 'missing_vector' WHEN 4 THEN 'wrong_dimension' ELSE 'invalid_json' END AS reason
FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS line_no FROM embeddings)
WHERE vec_id % 9 IN (1, 2, 3, 4, 7)""",
)
def load_vectors_located(spark, sf_dir):
    """Where the bad lines are, in files read by splits."""
    folder = in_files(vector_lines(spark, sf_dir, "vec_id"), "vec_id")
    _, rejects = src.load_vectors_jsonl(spark, folder, DIM, located=True)
    return rejects.select(FILE_PART(), "line_no", "reason")


@query(
    "format_vector",
    """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') AS text
FROM embeddings""",
)
def format_vector(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", M.format_vector(F.col("embedding")).alias("text"))


@query(
    "parse_vector_csv",
    """SELECT vec_id, pos::INTEGER AS pos, round(x::DOUBLE, 6) + 0.0 AS value FROM (
  SELECT vec_id, unnest(v) x, generate_subscripts(v, 1) - 1 pos FROM (
    SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN embedding[1:40] ELSE embedding END v FROM embeddings))""",
)
def parse_vector_csv(spark, sf_dir):
    csv = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", ")
    broken = F.concat(F.substring_index(csv, ",", 40), F.lit(", x1, "), csv)
    parsed = M.parse_vector(F.when(F.col("vec_id") % 4 == 0, broken).otherwise(csv))
    return (
        embeddings(spark, sf_dir)
        .select("vec_id", F.posexplode(parsed).alias("pos", "value"))
        .select("vec_id", "pos", r6("value").alias("value"))
    )


@query(
    "export_jsonl",
    """SELECT vec_id, '{"id": ' || vec_id || ', "vector": [' ||
  array_to_string(list_transform(embedding, lambda x: printf('%.6g', x::DOUBLE)), ', ') ||
  '], "metadata": {"label":' || label || '}}' AS line FROM embeddings""",
)
def export_jsonl(spark, sf_dir):
    rows = embeddings(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return src.export_lines(rows, metadata="metadata")


@query(
    "export_active",
    """SELECT vec_id, '{"id": ' || vec_id || ', "vector": [' ||
  array_to_string(list_transform(embedding, lambda x: printf('%.6g', x::DOUBLE)), ', ') || ']}' AS line
FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
)
def export_active(spark, sf_dir):
    """Deleted rows are not exported."""
    return src.export_lines(with_active(spark, sf_dir), active="active")


@query(
    "metadata_round_trip",
    """SELECT vec_id, len(m) AS length, md5(m) AS digest FROM (SELECT vec_id,
  '{"label":' || label || ',"note":"' || repeat('x' || vec_id || ' ', 400) || '"}' m FROM embeddings)""",
)
def metadata_round_trip(spark, sf_dir):
    """Metadata beyond a kilobyte survives load, export and load."""
    note = F.repeat(F.concat(F.lit("x"), F.col("vec_id").cast("string"), F.lit(" ")), F.lit(400))
    given = embeddings(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label", note.alias("note"))))
    load = lambda lines: src.split_rejects(src.tag_vector_lines(lines.select("line"), DIM))[0]
    once = written(load(src.export_lines(given, metadata="metadata")))
    own = F.regexp_extract("metadata", r"x(\d+) ", 1).cast("long")
    twice = written(load(src.export_lines(once.withColumn("vec_id", own), metadata="metadata")))
    return twice.select(own.alias("vec_id"), F.length("metadata").cast("long").alias("length"), F.md5("metadata").alias("digest"))


# --- table operators -------------------------------------------------------
@query(
    "validate_dim",
    "SELECT vec_id, len(embedding)::INTEGER AS dim, (vec_id % 3 <> 0) AS valid FROM "
    "(SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN embedding[1:10] ELSE embedding END embedding FROM embeddings)",
)
def validate_dim(spark, sf_dir):
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    good, bad = tb.validate_dim(embeddings(spark, sf_dir).withColumn("embedding", cut), DIM)
    shown = lambda df, ok: df.select("vec_id", F.size("embedding").alias("dim"), F.lit(ok).alias("valid"))
    return shown(good, True).unionByName(shown(bad, False))


@query(
    "append_ids",
    """SELECT vec_id, label FROM embeddings UNION ALL
SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY event_id), user_id::INTEGER FROM events""",
)
def append_ids(spark, sf_dir):
    incoming = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("label"))
    return tb.append_ids(embeddings(spark, sf_dir).select("vec_id", "label"), incoming, "event_id")


@query(
    "upsert_latest",
    """WITH w AS (SELECT 'vec-' || vec_id AS key, vec_id AS value, -1::BIGINT AS seq FROM embeddings UNION ALL
  SELECT 'vec-' || user_id, event_id, event_id FROM events)
SELECT key, arg_max(value, seq) AS value FROM w GROUP BY key""",
)
def upsert_latest(spark, sf_dir):
    key = lambda c: F.concat(F.lit("vec-"), F.col(c).cast("string")).alias("key")
    stored = embeddings(spark, sf_dir).select(key("vec_id"), F.col("vec_id").alias("value"))
    writes = table(spark, sf_dir, "events").select(key("user_id"), F.col("event_id").alias("value"), "event_id")
    return tb.upsert_latest(stored, writes, "key", "event_id")


@query("get_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf_dir):
    return tb.get_by_id(embeddings(spark, sf_dir), 42).select("vec_id", "label")


_DELETED = "SELECT p_partkey AS vec_id FROM part WHERE p_size > 25"


@query(
    "delete_by_id",
    f"""SELECT vec_id, 'kept' AS outcome FROM embeddings WHERE vec_id NOT IN ({_DELETED}) UNION ALL
SELECT vec_id, 'not_found' FROM ({_DELETED}) WHERE vec_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def delete_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("vec_id"))
    kept, missing = tb.delete_by_id(embeddings(spark, sf_dir), ids)
    tag = lambda df, text: df.select("vec_id", F.lit(text).alias("outcome"))
    return tag(kept, "kept").unionByName(tag(missing, "not_found"))


@query("list_ids", "SELECT vec_id FROM embeddings")
def list_ids(spark, sf_dir):
    return tb.list_ids(embeddings(spark, sf_dir))


@query(
    "category_stats",
    f"""SELECT label, count(*) AS total_rows, count(*) FILTER (vec_id NOT IN ({_DELETED})) AS active_rows,
  min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim FROM embeddings GROUP BY label""",
)
def category_stats(spark, sf_dir):
    return tb.category_stats(with_active(spark, sf_dir), "label", active=F.col("active"))


@query(
    "table_info",
    f"""SELECT max(len(embedding))::INTEGER AS dimensions, 'cosine' AS metric, count(*) AS total_rows,
  count(*) FILTER (vec_id NOT IN ({_DELETED})) AS active_rows FROM embeddings""",
)
def table_info(spark, sf_dir):
    return tb.table_info(with_active(spark, sf_dir), "cosine", active=F.col("active"))


def with_active(spark, sf_dir) -> DataFrame:
    gone = (
        table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("vec_id")).distinct()
    ).withColumn("gone", F.lit(True))
    return embeddings(spark, sf_dir).join(gone, "vec_id", "left").withColumn("active", F.col("gone").isNull())


# --- vector math against one literal vector --------------------------------
def _math(name: str, column, sql: str) -> None:
    @query(name, f"SELECT vec_id, {sql_r6(sql)} AS value FROM (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings)")
    def run(spark, sf_dir):
        return embeddings(spark, sf_dir).select("vec_id", r6(column(F.col("embedding"), PROBE_COL())).alias("value"))


_math("vec_dot", M.dot, f"list_inner_product(v, {PROBE_SQL})")
_math("vec_norm", lambda v, _: M.norm(v), "sqrt(list_inner_product(v, v))")
_math("vec_cosine_distance", M.cosine_distance, f"1 - list_cosine_similarity(v, {PROBE_SQL})")
_math("vec_cosine_similarity", M.cosine_similarity, f"list_cosine_similarity(v, {PROBE_SQL})")
_math("vec_euclidean", M.euclidean_distance, f"list_distance(v, {PROBE_SQL})")
_math("vec_neg_dot", M.negative_dot, f"-list_inner_product(v, {PROBE_SQL})")


@query(
    "vec_normalize",
    f"""SELECT vec_id, pos::INTEGER AS pos, {sql_r6('x / n')} AS value FROM (
  SELECT vec_id, unnest(v) x, generate_subscripts(v, 1) - 1 pos, sqrt(list_inner_product(v, v)) n
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) v FROM embeddings))""",
)
def vec_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    return (
        embeddings(spark, sf_dir)
        .select("vec_id", F.posexplode(M.normalize(scaled)).alias("pos", "value"))
        .select("vec_id", "pos", r6("value").alias("value"))
    )


# --- search ----------------------------------------------------------------
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings)"
_DIST = {
    "cosine": "1 - list_cosine_similarity(q.v, c.v)",
    "euclidean": "list_distance(q.v, c.v)",
    "dot": "-list_inner_product(q.v, c.v)",
}


def knn_sql(metric: str, k: int, category: bool = False) -> str:
    cat = "c.label::VARCHAR" if category else "NULL::VARCHAR"
    part = "qid, category" if category else "qid"
    return f"""{_E},
pairs AS (SELECT q.vec_id qid, {cat} category, c.vec_id, {_DIST[metric]} distance FROM e q, e c),
knn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {duck.dkey('distance')}, vec_id)::INTEGER rank
  FROM pairs QUALIFY rank <= {k})"""


_KNN_COLS = f"qid, vec_id, {sql_r6('distance')} AS distance, rank"


@query(
    "knn_single",
    f"""SELECT vec_id, {sql_r6('d')} AS distance FROM (SELECT vec_id,
  1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}) d FROM embeddings)
ORDER BY {duck.dkey('d')}, vec_id LIMIT 10""",
)
def knn_single(spark, sf_dir):
    found = knn.knn_single(embeddings(spark, sf_dir), PROBE)
    return found.select("vec_id", r6("distance").alias("distance"))


def _knn_metric(metric: str) -> None:
    @query(f"knn_join_{metric}", f"WITH {knn_sql(metric, 10)} SELECT {_KNN_COLS} FROM knn")
    def run(spark, sf_dir):
        e = embeddings(spark, sf_dir)
        found = knn.knn_join(as_queries(e), e, metric=metric)
        return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


for _m in ("cosine", "euclidean", "dot"):
    _knn_metric(_m)


@query(
    "knn_join_blocks",
    f"WITH {knn_sql('cosine', 10)} SELECT {_KNN_COLS} FROM knn",
)
def knn_join_blocks(spark, sf_dir):
    """The plan for two large sides, at any size."""
    e = embeddings(spark, sf_dir)
    found = knn.knn_join(as_queries(e), e, broadcast_bytes=0, block_rows=1024)
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("knn_join_query_broadcast", f"WITH {knn_sql('cosine', 10)} SELECT {_KNN_COLS} FROM knn")
def knn_join_query_broadcast(spark, sf_dir):
    """The plan for a large corpus and few queries."""
    e = embeddings(spark, sf_dir)
    found = knn.knn_join(as_queries(e), e, plan="queries")
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("knn_per_category_query_broadcast", f"WITH {knn_sql('cosine', K, category=True)} SELECT category, {_KNN_COLS} FROM knn")
def knn_per_category_query_broadcast(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    found = knn.knn_join(as_queries(e), e, K, category="label", plan="queries")
    return found.select("category", "qid", "vec_id", r6("distance").alias("distance"), "rank")


def _others(name: str, plan: str, category: str | None = None) -> None:
    sql = knn_sql("cosine", K, category=bool(category)).replace("FROM e q, e c)", "FROM e q, e c WHERE q.vec_id <> c.vec_id)")

    @query(name, f"WITH {sql} SELECT category, {_KNN_COLS} FROM knn")
    def run(spark, sf_dir):
        """Every row against all others."""
        e = embeddings(spark, sf_dir)
        found = knn.knn_join(as_queries(e), e, K, category=category, plan=plan, leave_out_own=True)
        return found.select("category", "qid", "vec_id", r6("distance").alias("distance"), "rank")


_others("knn_others", "corpus")
_others("knn_others_per_category", "corpus", "label")
_others("knn_others_query_broadcast", "queries", "label")
_others("knn_others_blocks", "blocks", "label")


@query(
    "knn_active",
    f"""WITH {knn_sql('cosine', 10).replace('e q, e c)', 'e q, e c WHERE c.vec_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25))')}
SELECT {_KNN_COLS} FROM knn""",
)
def knn_active(spark, sf_dir):
    """Deleted rows are nobody's neighbours."""
    rows = with_active(spark, sf_dir)
    found = knn.knn_join(as_queries(rows), tb.active_rows(rows))
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query(
    "knn_similarity",
    f"WITH {knn_sql('cosine', 5)} SELECT qid, vec_id, {sql_r6('1 - distance')} AS score, rank FROM knn",
)
def knn_similarity(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return knn.knn_similarity(as_queries(e), e, 5).select("qid", "vec_id", r6("score").alias("score"), "rank")


def _per_category(spark, sf_dir) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.knn_join(as_queries(e), e, K, category="label")


_PER_CAT = knn_sql("cosine", K, category=True)


@query("knn_per_category", f"WITH {_PER_CAT} SELECT category, {_KNN_COLS} FROM knn")
def knn_per_category(spark, sf_dir):
    return _per_category(spark, sf_dir).select("category", "qid", "vec_id", r6("distance").alias("distance"), "rank")


# --- approximate search ----------------------------------------------------
_CENTRES = """centres AS MATERIALIZED (SELECT label, list(m ORDER BY pos) cv, row_number() OVER (ORDER BY label) - 1 cell FROM (
  SELECT label, pos, avg(x) m FROM (SELECT label, unnest(v) x, generate_subscripts(v, 1) pos FROM e) GROUP BY 1, 2)
  GROUP BY label),
probes AS MATERIALIZED (SELECT vec_id, cell::INTEGER cell, row_number() OVER (PARTITION BY vec_id
  ORDER BY floor((1 - list_cosine_similarity(v, cv)) * 1e9 + 0.5), cell) pr FROM e CROSS JOIN centres)"""


@query("ann_assign_cells", f"WITH {_E}, {_CENTRES} SELECT vec_id, cell FROM probes WHERE pr = 1")
def ann_assign_cells(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return ann.assign(ann.class_mean_index(e, "label"), e).select("vec_id", "cell")


@query(
    "knn_ann_probe",
    f"""WITH {_E}, {_CENTRES},
pairs AS (SELECT q.vec_id qid, c.vec_id, {_DIST['cosine']} distance FROM e q
  JOIN probes p ON p.vec_id = q.vec_id AND p.pr <= 3 JOIN probes f ON f.cell = p.cell AND f.pr = 1
  JOIN e c ON c.vec_id = f.vec_id)
SELECT {_KNN_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY {duck.dkey('distance')}, vec_id)::INTEGER rank FROM pairs) WHERE rank <= {K}""",
)
def knn_ann_probe(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = ann.class_mean_index(e, "label")
    found = ann.search(index, as_queries(e), e, K, n_probe=3)
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


def _kmeans_index(spark, sf_dir) -> ann.CellIndex:
    return ann.build_index(embeddings(spark, sf_dir))


def ann_probes(index: ann.CellIndex) -> int:
    """Five eighths of the cells: the vectors have no clusters, so fewer would find under nine in ten."""
    return -(-5 * index.n_cells // 8)


@query("ann_index_build")
def ann_index_build(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return ann.assign(_kmeans_index(spark, sf_dir), e).select("vec_id", "cell")


@query("knn_ann")
def knn_ann(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = _kmeans_index(spark, sf_dir)
    found = ann.search(index, as_queries(e), e, n_probe=ann_probes(index))
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("knn_ann_exhaustive", f"WITH {knn_sql('cosine', 10)} SELECT {_KNN_COLS} FROM knn")
def knn_ann_exhaustive(spark, sf_dir):
    """All cells probed: must equal the exact search."""
    e = embeddings(spark, sf_dir)
    index = _kmeans_index(spark, sf_dir)
    found = ann.search(index, as_queries(e), e, n_probe=index.n_cells)
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("ann_recall")
def ann_recall(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    q = as_queries(e)
    index = _kmeans_index(spark, sf_dir)
    return ann.recall(ann.search(index, q, e, n_probe=ann_probes(index)), knn.knn_join(q, e))


# --- search among clustered vectors -----------------------------------------
CLUSTERS, SPREAD = 50, 0.3
_CLUSTERED = f"""e AS MATERIALIZED (SELECT a.vec_id, a.label,
  list_transform(list_zip(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda p: p[1] * {SPREAD} + p[2]) v
  FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id % {CLUSTERS})"""


def clustered(spark, sf_dir) -> DataFrame:
    """Every embedding, drawn towards one of 50 of them."""
    e = embeddings(spark, sf_dir)
    centres = e.where(f"vec_id < {CLUSTERS}").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centre"))
    near = F.zip_with("embedding", "centre", lambda x, c: x.cast("double") * SPREAD + c.cast("double"))
    return e.join(F.broadcast(centres), F.col("vec_id") % CLUSTERS == F.col("cluster")).select("vec_id", "label", near.alias("embedding"))


def _clustered_knn(metric: str, k: int, category: bool = False) -> str:
    return knn_sql(metric, k, category).replace(_E, _CLUSTERED)


def _pruned_metric(metric: str) -> None:
    @query(f"knn_pruned_{metric}", f"WITH {_clustered_knn(metric, K)} SELECT {_KNN_COLS} FROM knn")
    def run(spark, sf_dir):
        """Two large sides: only cells that bounds leave open are searched."""
        e = clustered(spark, sf_dir)
        found, _ = tree.knn_join_pruned(as_queries(e), e, K, metric=metric)
        return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


for _m in ("cosine", "euclidean", "dot"):
    _pruned_metric(_m)


@query("knn_pruned_per_category", f"WITH {_clustered_knn('cosine', K, category=True)} SELECT category, {_KNN_COLS} FROM knn")
def knn_pruned_per_category(spark, sf_dir):
    e = clustered(spark, sf_dir)
    found, _ = tree.knn_join_pruned(as_queries(e), e, K, category="label")
    return found.select("category", "qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("knn_pruned_rounds", f"WITH {_clustered_knn('cosine', K)} SELECT {_KNN_COLS} FROM knn")
def knn_pruned_rounds(spark, sf_dir):
    """Probing in rounds of the queries that are still open, until all have closed: exact."""
    e = clustered(spark, sf_dir)
    found, _ = tree.tree_search(tree.build_tree(e), as_queries(e), K, schedule=(2, 8, None))
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("knn_pruned_visits")
def knn_pruned_visits(spark, sf_dir):
    """Cells and rows that each query met when it may visit eight cells, and whether its bound had closed by then."""
    e = clustered(spark, sf_dir)
    return tree.tree_search(tree.build_tree(e), as_queries(e), K, schedule=(8,))[1]


def _few_cells(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clustered vectors, and the ten neighbours found in a tenth of the cells."""
    e = written(clustered(spark, sf_dir))
    index = ann.build_index(e)
    return e, ann.search(index, as_queries(e), e, n_probe=-(-index.n_cells // 10))


@query("knn_ann_clustered")
def knn_ann_clustered(spark, sf_dir):
    """Where there are clusters, a tenth of the cells holds nearly all neighbours."""
    return _few_cells(spark, sf_dir)[1].select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("ann_recall_clustered")
def ann_recall_clustered(spark, sf_dir):
    e, found = _few_cells(spark, sf_dir)
    return ann.recall(found, knn.knn_join(as_queries(e), e))


TABLES, BITS = 12, 10
_CODES = f"""planes AS MATERIALIZED (SELECT p, list(CASE WHEN substr(md5(p || ':' || d), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) w
  FROM range({TABLES * BITS}) a(p), range({DIM}) b(d) GROUP BY p),
codes AS MATERIALIZED (SELECT vec_id, (p // {BITS})::INTEGER AS tab,
  sum(CASE WHEN list_inner_product(v, w) >= 0 THEN 1::BIGINT << (p % {BITS})::INTEGER ELSE 0 END)::BIGINT AS code FROM e, planes GROUP BY 1, 2)"""


@query("lsh_codes", f"WITH {_CLUSTERED}, {_CODES} SELECT vec_id, tab, code FROM codes")
def lsh_codes(spark, sf_dir):
    return lsh.coded(lsh.SignCodes(DIM, TABLES, BITS), clustered(spark, sf_dir)).select("vec_id", "tab", "code")


@query(
    "knn_lsh",
    f"""WITH {_CLUSTERED}, {_CODES},
pairs AS (SELECT DISTINCT q.vec_id qid, c.vec_id FROM codes q JOIN codes c USING (tab, code)),
measured AS (SELECT qid, c.vec_id, {_DIST['cosine']} distance FROM pairs p JOIN e q ON q.vec_id = p.qid JOIN e c ON c.vec_id = p.vec_id)
SELECT {_KNN_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY {duck.dkey('distance')}, vec_id)::INTEGER rank FROM measured) WHERE rank <= {K}""",
)
def knn_lsh(spark, sf_dir):
    e = clustered(spark, sf_dir)
    found, _ = lsh.lsh_search(lsh.SignCodes(DIM, TABLES, BITS), as_queries(e), e, K)
    return found.select("qid", "vec_id", r6("distance").alias("distance"), "rank")


@query("lsh_recall")
def lsh_recall(spark, sf_dir):
    """Recall of the queries whose id is divisible by 100 against all rows, and the share of rows compared."""
    e = clustered(spark, sf_dir)
    q = as_queries(e.where("vec_id % 100 = 0"))
    found, compared = lsh.lsh_search(lsh.SignCodes(DIM, TABLES, BITS), q, e, K)
    share = compared.agg(F.avg("rows_compared")).first()[0] / max(e.count(), 1)
    return ann.recall(found, knn.knn_join(q, e, K)).withColumn("share_compared", F.lit(share))


# --- classes and votes -----------------------------------------------------
_CLASS = f"""{_E},
pairs AS (SELECT least(a.label, b.label) label_a, greatest(a.label, b.label) label_b,
  1 - list_cosine_similarity(a.v, b.v) d FROM e a JOIN e b ON a.vec_id < b.vec_id),
cd AS (SELECT label_a, label_b, avg(d) mean_distance, count(*) n_pairs FROM pairs GROUP BY 1, 2)"""


@query(
    "class_distance_matrix",
    f"WITH {_CLASS} SELECT label_a, label_b, {sql_r6('mean_distance')} AS mean_distance, n_pairs FROM cd",
)
def class_distance_matrix(spark, sf_dir):
    d = classdist.class_distances(embeddings(spark, sf_dir))
    return d.select("label_a", "label_b", r6("mean_distance").alias("mean_distance"), "n_pairs")


def _class_pairs(metric: str) -> None:
    sql = _CLASS.replace("1 - list_cosine_similarity(a.v, b.v)", _DIST[metric].replace("q.v", "a.v").replace("c.v", "b.v"))

    @query(f"class_distance_matrix_{metric}", f"WITH {sql} SELECT label_a, label_b, {sql_r6('mean_distance')} AS mean_distance, n_pairs FROM cd")
    def run(spark, sf_dir):
        d = classdist.class_distances_by_pairs(embeddings(spark, sf_dir), metric=metric)
        return d.select("label_a", "label_b", r6("mean_distance").alias("mean_distance"), "n_pairs")


_class_pairs("euclidean")
_class_pairs("dot")


@query(
    "class_discrimination",
    f"""WITH {_CLASS} SELECT {sql_r6('w')} AS within_mean, {sql_r6('b')} AS between_mean, {sql_r6('b / w')} AS ratio
FROM (SELECT avg(mean_distance) FILTER (label_a = label_b) w, avg(mean_distance) FILTER (label_a <> label_b) b FROM cd)""",
)
def class_discrimination(spark, sf_dir):
    d = classdist.discrimination(classdist.class_distances(embeddings(spark, sf_dir)))
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(
    "category_scores",
    f"WITH {_PER_CAT} SELECT qid, category, {sql_r6('avg(distance)')} AS score, count(*) AS n_matches FROM knn GROUP BY 1, 2",
)
def category_scores(spark, sf_dir):
    s = vote.category_scores(_per_category(spark, sf_dir))
    return s.select("qid", "category", r6("score").alias("score"), "n_matches")


_VOTES = f"{_PER_CAT}, {duck.votes('knn', 'votes', 'category')}"


@query("knn_classify", f"WITH {_VOTES} SELECT qid, category FROM votes")
def knn_classify(spark, sf_dir):
    return vote.vote(vote.category_scores(_per_category(spark, sf_dir))).select("qid", "category")


@query("knn_confidence", f"WITH {_VOTES} SELECT qid, {sql_r6('confidence')} AS confidence FROM votes")
def knn_confidence(spark, sf_dir):
    voted = vote.vote(vote.category_scores(_per_category(spark, sf_dir)))
    return voted.select("qid", r6("confidence").alias("confidence"))


@query(
    "classify_unknown",
    "SELECT vec_id AS qid, 'UNKNOWN' AS category, 0.0::DOUBLE AS confidence FROM embeddings",
)
def classify_unknown(spark, sf_dir):
    """No category has any vector of the right dimension: every query is UNKNOWN."""
    e = embeddings(spark, sf_dir)
    _, empty = tb.validate_dim(e, DIM)
    found = knn.knn_join(as_queries(e), empty, K, category="label")
    return vote.with_unknown(as_queries(e), vote.vote(vote.category_scores(found)))
