"""Registered queries of the vector store's operators over the driver's tables, and their SQL.

Points are ``embeddings`` with payload fields of ``documents``; the mutation log is
``events`` (``event_id`` is the sequence, ``user_id`` the point, ``error`` a delete).
Scores are rounded at this boundary only; ranks come from unrounded scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import band, cosine, dot, heap_score, l2, norm, percent
from ..functions.payload import canonical_json, field, field_names, matches
from ..operators import explore, graph, search, state
from ..operators import log as wal
from ..runtime import materialize, scratch_path, table
from ..schema import GraphConfig
from ..sources import points as src
from ..sources.store import Engine, snapshot_name

_GRAPH_STORE = """WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE NOT (vec_id < 100 AND vec_id % 7 = 0)),
    e AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS s FROM p a JOIN p b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) <= 3),
    two AS (SELECT src, dst, round(s, 12) AS s FROM e UNION SELECT dst, src, round(s, 12) FROM e)
    SELECT src, dst FROM two QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 32"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _six(c: str | Column) -> Column:
    return (F.round(c, 6) + 0).alias(c) if isinstance(c, str) else F.round(c, 6) + 0


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Points with a JSON payload: the label, and language and source where the document is known."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars")
    payload = F.when(F.col("vec_id") % 11 != 0, F.to_json(F.struct("label", F.concat(F.lit("g"), (F.col("vec_id") % 3).cast("string")).alias("tag"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") * 1.0).alias("w")), {"ignoreNullFields": "true"}))
    return e.join(docs, "vec_id", "left").withColumn("payload", payload)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same points without payload, for searches that read none."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


_PTS = "WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), pts AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, CASE WHEN vec_id % 11 <> 0 THEN 1 END AS has, 'g' || (vec_id % 3) AS tag, CASE WHEN vec_id % 2 = 0 THEN vec_id * 1.0 END AS w FROM embeddings)"
_COS = "coalesce(nullif(least(greatest(list_cosine_similarity(v, qv), -1), 1), 'nan'::DOUBLE), 0)"
_L2 = "list_distance(v, qv)"


def _q0(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def _top(metric: str, k: str, where: str = "TRUE", order: str = "DESC", source: str = "pts") -> str:
    return f"{_PTS}, s AS (SELECT vec_id, {metric} AS score FROM {source}, q WHERE {where}) SELECT vec_id, round(score, 6) + 0 AS score FROM s ORDER BY s.score {order}, vec_id LIMIT {k}"


@query(_top(_COS, "10"))
def knn_cosine(spark, d):
    return search.knn(_vectors(spark, d), _q0(spark, d), 10, "COSINE", id="vec_id").select("vec_id", _six("score"))


@query(_top(_L2, "10", order="ASC"))
def knn_l2(spark, d):
    return search.knn(_vectors(spark, d), _q0(spark, d), 10, "L2", id="vec_id").select("vec_id", _six("score"))


@query(_top(_COS, "0"))
def knn_k0(spark, d):
    return search.knn(_vectors(spark, d), _q0(spark, d), 0, id="vec_id").select("vec_id", _six("score"))


@query(_top(_COS, "1000000"))
def knn_k_gt_n(spark, d):
    return search.knn(_vectors(spark, d), _q0(spark, d), 1_000_000, id="vec_id").select("vec_id", _six("score"))


@query(_top(_COS, "1"))
def knn_self(spark, d):
    return search.knn(_vectors(spark, d), _q0(spark, d), 1, id="vec_id").select("vec_id", _six("score"))


def _batch_sql(score: str, order: str) -> str:
    return f"""SELECT qid, vec_id, round(score, 6) + 0 AS score, rank FROM (
        SELECT a.vec_id AS qid, b.vec_id, {score} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} {order}, b.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0) WHERE rank <= 10"""


def _queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _batch(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("id").alias("vec_id"), _six("score"), F.col("rank").cast("bigint").alias("rank"))


_E = "a.embedding::DOUBLE[], b.embedding::DOUBLE[]"


@query(_batch_sql(f"list_cosine_similarity({_E})", "DESC"))
def knn_batch_cosine(spark, d):
    return _batch(search.knn_batch(_vectors(spark, d), _queries(spark, d), 10, "COSINE", id="vec_id"))


@query(_batch_sql(f"list_distance({_E})", "ASC"))
def knn_batch_l2(spark, d):
    return _batch(search.knn_batch(_vectors(spark, d), _queries(spark, d), 10, "L2", id="vec_id"))


@query(_batch_sql(f"list_cosine_similarity({_E})", "DESC"))
def knn_batch_columns(spark, d):
    return _batch(search.knn_batch_columns(_vectors(spark, d), _queries(spark, d), 10, "COSINE", id="vec_id"))


def _filtered(spark, d, must, k=5, mode="pre"):
    return search.knn_filtered(_points(spark, d), _q0(spark, d), k, must, "COSINE", mode, id="vec_id").select("vec_id", _six("score"))


@query(_top(_COS, "5", "has = 1 AND label = 3"))
def knn_filter_pre(spark, d):
    return _filtered(spark, d, {"label": 3})


@query(f"{_PTS}, s AS (SELECT vec_id, label, has, {_COS} AS score FROM pts, q ORDER BY score DESC, vec_id LIMIT 55) SELECT vec_id, round(score, 6) + 0 AS score FROM s WHERE has = 1 AND label = 3 ORDER BY s.score DESC, vec_id LIMIT 5")
def knn_filter_post(spark, d):
    return _filtered(spark, d, {"label": 3}, mode="post")


@query(_top(_COS, "5", "has = 1 AND label = 3 AND tag = 'g1'"))
def knn_filter_multi(spark, d):
    return _filtered(spark, d, {"label": 3.0, "tag": "g1"})


@query(_top(_COS, "5", "FALSE"))
def knn_filter_nomatch(spark, d):
    return _filtered(spark, d, {"tag": "none"})


@query(_top(_COS, "5"))
def knn_filter_empty(spark, d):
    return _filtered(spark, d, {})


@query(f"{_PTS} SELECT vec_id, coalesce(has = 1 AND w = 4, FALSE) AS matched FROM pts")
def filter_missing_payload(spark, d):
    return _points(spark, d).select("vec_id", matches(F.col("payload"), {"w": 4}).alias("matched"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, FALSE), (4, FALSE)) t(n, matched)")
def filter_explicit_null(spark, d):
    rows = spark.createDataFrame([(1, '{"a": null}'), (2, '{"b": 1}'), (3, None), (4, '{"a": 0}')], "n int, payload string")
    return rows.select("n", matches(F.col("payload"), {"a": None}).alias("matched"))


@query(f"""{_PTS}, s AS (SELECT vec_id, vec_id % 4 AS seg, {_COS} AS score FROM pts, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT vec_id, seg, round(score, 6) + 0 AS score FROM r WHERE n <= 20 ORDER BY r.score DESC, vec_id LIMIT 10""")
def knn_segments_merge(spark, d):
    points = _vectors(spark, d).withColumn("seg", F.col("vec_id") % 4)
    return search.knn_segments(points, _q0(spark, d), 10, "seg", id="vec_id").select("vec_id", "seg", _six("score"))


@query(f"{_PTS} SELECT vec_id, round(list_dot_product(v, qv), 6) + 0 AS dot, round(sqrt(list_dot_product(v, v)), 6) + 0 AS norm FROM pts, q")
def vector_norms(spark, d):
    q = search.query_vector(_q0(spark, d))
    return _vectors(spark, d).select("vec_id", _six(dot(F.col("vector"), q)).alias("dot"), _six(norm(F.col("vector"))).alias("norm"))


@query("SELECT * FROM (VALUES (1, 1.0::DOUBLE, 0.0::DOUBLE), (2, -1.0, round(sqrt(56.0), 6)), (3, 1.0, round(sqrt(14.0), 6)), (4, 0.0, round(sqrt(14.0), 6)), (5, round(32 / sqrt(14 * 77.0), 6), round(sqrt(27.0), 6))) t(n, cosine, l2)")
def distance_cases(spark, d):
    cases = [(1, [1, 2, 3]), (2, [-1, -2, -3]), (3, [2, 4, 6]), (4, [0, 0, 0]), (5, [4, 5, 6])]
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in cases], "n int, v array<float>")
    a = search.query_vector([1.0, 2.0, 3.0])
    return rows.select("n", _six(cosine(a, F.col("v"))).alias("cosine"), _six(l2(a, F.col("v"))).alias("l2"))


@query(f"{_PTS} SELECT vec_id, round(least(greatest({_COS} * 100, 0), 100), 4) + 0 AS pct, CASE WHEN {_COS} > 0.75 THEN 'success' WHEN {_COS} > 0.5 THEN 'warning' ELSE 'error' END AS band, round(-{_L2}, 6) + 0 AS heap FROM pts, q")
def score_bands(spark, d):
    q = search.query_vector(_q0(spark, d))
    scored = _vectors(spark, d).select("vec_id", cosine(F.col("vector"), q).alias("s"), l2(F.col("vector"), q).alias("e"))
    return scored.select("vec_id", (F.round(percent(F.col("s")), 4) + 0).alias("pct"), band(F.col("s")).alias("band"), _six(heap_score("L2", F.col("e"))).alias("heap"))


@query("SELECT vec_id, len(embedding) AS dim FROM embeddings ORDER BY vec_id LIMIT 100")
def points_list(spark, d):
    return _vectors(spark, d).select("vec_id", F.size("vector").cast("bigint").alias("dim")).orderBy("vec_id").limit(100)


_LOG = "WITH log AS (SELECT event_id AS lsn, ts, user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN event_id % 7 = 0 OR event_type = 'error' THEN NULL ELSE props END AS payload FROM events)"
_ALIVE = _LOG + ", life AS (SELECT *, max(CASE WHEN op = 'delete' THEN lsn END) OVER (PARTITION BY id) AS dead FROM log), alive AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn) AS n, first_value(payload IS NULL) OVER (PARTITION BY id ORDER BY lsn) AS bare, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS back FROM life WHERE op = 'upsert' AND (dead IS NULL OR lsn > dead))"


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("lsn"), "ts", F.col("user_id").alias("id"), F.when(gone, "delete").otherwise("upsert").alias("op"), F.when((F.col("event_id") % 7 != 0) & ~gone, F.col("props")).alias("payload"))


@query(_LOG + " SELECT id, lsn, payload FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY lsn DESC) = 1 AND op <> 'delete'")
def log_fold_latest(spark, d):
    return state.fold_latest(_log(spark, d)).select("id", "lsn", "payload")


@query(_ALIVE + " SELECT id, lsn, nullif(n - bare::INT, 0) AS version, payload FROM alive WHERE back = 1")
def log_version_fold(spark, d):
    return state.version_fold(_log(spark, d)).select("id", "lsn", "version", "payload")


@query(_LOG + """, kept AS (SELECT id, arg_max(coalesce(payload, chr(0)), lsn) AS p FROM log WHERE payload IS NOT NULL OR op = 'delete' GROUP BY id)
    SELECT l.id, l.lsn, nullif(k.p, chr(0)) AS payload FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY lsn DESC) = 1) l LEFT JOIN kept k USING (id) WHERE l.op <> 'delete'""")
def log_keep_payload(spark, d):
    return state.keep_payload_fold(_log(spark, d)).select("id", "lsn", "payload")


@query(_LOG + " SELECT count(*) AS live FROM (SELECT arg_max(op, lsn) AS op FROM log GROUP BY id) WHERE op <> 'delete'")
def log_live_count(spark, d):
    return state.fold_latest(_log(spark, d)).agg(F.count("*").alias("live"))


@query(_LOG + " SELECT id, max(lsn) AS lsn FROM log GROUP BY id HAVING arg_max(op, lsn) = 'delete'")
def log_tombstones(spark, d):
    return state.tombstones(_log(spark, d))


@query(_LOG + ", asked AS (SELECT DISTINCT id FROM log UNION ALL SELECT -1) SELECT id AS point_id, CASE WHEN id = -1 THEN 'NOT_FOUND' ELSE 'OK' END AS status_code, CASE WHEN id = -1 THEN 'Point not found' END AS error_message FROM asked")
def log_delete_status(spark, d):
    log = _log(spark, d)
    return state.delete_status(log, log.select("id").distinct().unionByName(spark.createDataFrame([(-1,)], "id bigint")))


@query(_LOG + " SELECT lsn, id, op FROM log WHERE lsn > (SELECT max(lsn) // 2 FROM log)")
def log_range_after_lsn(spark, d):
    log = _log(spark, d)
    return wal.after(log, log.agg(F.max("lsn")).first()[0] // 2).select("lsn", "id", "op")


@query(_LOG + " SELECT lsn, id, op FROM log WHERE lsn = 77")
def log_read_at(spark, d):
    return wal.read_at(_log(spark, d), 77).select("lsn", "id", "op")


@query(_LOG + " SELECT min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM log")
def log_bounds(spark, d):
    return wal.bounds(_log(spark, d))


@query(_LOG + " SELECT after_lsn, next_lsn FROM (SELECT lsn AS after_lsn, lead(lsn) OVER (ORDER BY lsn) AS next_lsn FROM log WHERE op <> 'delete') WHERE next_lsn <> after_lsn + 1")
def log_gaps(spark, d):
    return wal.gaps(_log(spark, d).where("op <> 'delete'"))


@query(_LOG + ", m AS (SELECT max(lsn) // 2 AS cp, max(lsn) // 1000 AS open FROM log) SELECT lsn FROM log, m WHERE lsn // 1000 = open OR (lsn // 1000 + 1) * 1000 > cp")
def log_prefix_truncate(spark, d):
    log = _log(spark, d)
    return wal.truncate_prefix(log, log.agg(F.max("lsn")).first()[0] // 2).select("lsn")


@query(_LOG + " SELECT lsn FROM log WHERE lsn < 500")
def log_suffix_truncate(spark, d):
    return wal.truncate_suffix(_log(spark, d), 500).select("lsn")


@query(_LOG + ", bad AS (SELECT lsn // 1000 AS seg, min(lsn) AS b FROM log WHERE id = 1 GROUP BY seg) SELECT lsn FROM log LEFT JOIN bad ON lsn // 1000 = seg WHERE b IS NULL OR lsn < b")
def log_valid_prefix(spark, d):
    """Records of one id are altered after they were sealed; their checksums give them away."""
    sealed = wal.seal(_log(spark, d).drop("ts"))
    altered = sealed.withColumn("payload", F.when(F.col("id") == 1, F.concat(F.coalesce("payload", F.lit("")), F.lit(" "))).otherwise(F.col("payload")))
    return wal.valid_prefix(wal.mark_corrupt(altered)).select("lsn")


@query(_ALIVE + " SELECT id, lsn, nullif(n - bare::INT, 0) AS version, payload FROM alive WHERE back = 1")
def log_recover_from_checkpoint(spark, d):
    log = _log(spark, d)
    cp = log.agg(F.max("lsn")).first()[0] // 2
    at = state.version_fold(log.where(F.col("lsn") <= cp))
    return wal.recover(at, log, cp).select("id", "lsn", "version", "payload")


@query("SELECT pos, vec_id, label FROM (SELECT unnest([3, 1, 3, 999999999, 2]) AS vec_id, unnest([0, 1, 2, 3, 4]) AS pos) a JOIN embeddings USING (vec_id)")
def points_get_ordered(spark, d):
    asked = spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 999999999), (4, 2)], "pos int, vec_id bigint")
    return state.get_points(table(spark, d, "embeddings").select("vec_id", "label"), asked, id="vec_id").select("pos", "vec_id", "label")


@query("SELECT DISTINCT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def points_missing(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return state.missing_ids(table(spark, d, "embeddings"), asked, id="vec_id")


@query("SELECT vec_id, label, lang, source FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def payload_join(spark, d):
    return _points(spark, d).select("vec_id", "label", "lang", "source")


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def payload_fields(spark, d):
    return field_names(table(spark, d, "events"), "props")


@query("SELECT count(DISTINCT k) AS n_distinct, min(k) AS min_value, max(k) AS max_value, count(k) AS n_values FROM (SELECT CAST(props->>'k' AS BIGINT) AS k FROM events)")
def payload_field_stats(spark, d):
    rows = table(spark, d, "events").select(field(F.col("props"), "k").cast("bigint").alias("k"))
    return explore.field_stats(rows, "k")


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) = 69")
def payload_filter_eq(spark, d):
    return table(spark, d, "events").where(matches(F.col("props"), {"k": 69})).select("event_id")


@query("""SELECT * FROM (VALUES (1, '{"a":1,"b":2.5}'), (2, '{"a":1,"b":2.5}'), (3, '{"a":1,"b":2.5}'), (4, '[1,"x",null,{"k":true}]'), (5, NULL), (6, '{broken')) t(n, canonical)""")
def payload_canonical(spark, d):
    texts = ['{"b": 2.50, "a": 1.0}', '{ "a":1e0,"b":25e-1 }', '{"\\u0061":1,"b":2.5}', '[1.0, "x", null, {"k": true}]', None, "{broken"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "n int, payload string")
    return rows.select("n", canonical_json(F.col("payload")).alias("canonical"))


_BAD = [(0, "valid_p1", [1, 2, 3], None), (1, "invalid_dim_p2", [1, 2], None), (2, "", [4, 5, 6], None), (3, "valid_p3", [7, 8, 9], '{"a":1}'), (4, "missing_p4", None, None), (5, "p5", [1, 2, 3], '{"a":NaN}')]


def _bad_batch(spark) -> DataFrame:
    return spark.createDataFrame([(p, i, None if v is None else [float(x) for x in v], m) for p, i, v, m in _BAD], "pos int, id string, vector array<float>, payload string")


@query("""SELECT * FROM (VALUES (0, 'valid_p1', 'OK', NULL, FALSE), (1, 'invalid_dim_p2', 'INVALID_ARGUMENT', 'Dimension mismatch for point ID ''invalid_dim_p2'': expected 3, got 2', TRUE),
    (2, '', 'INVALID_ARGUMENT', 'Point ID cannot be empty', TRUE), (3, 'valid_p3', 'OK', NULL, FALSE), (4, 'missing_p4', 'INVALID_ARGUMENT', 'Vector is missing for point ID ''missing_p4''', TRUE),
    (5, 'p5', 'INVALID_ARGUMENT', 'Invalid payload for point ID ''p5''', FALSE)) t(pos, point_id, status_code, error_message, rejects_batch)""")
def validate_points(spark, d):
    return state.validate_points(_bad_batch(spark), 3)


@query("""SELECT id AS point_id, CASE WHEN e IS NULL AND p IS NULL THEN 'OK' ELSE 'INVALID_ARGUMENT' END AS status_code, coalesce(e, p) AS error_message, e IS NOT NULL AS rejects_batch FROM (
    SELECT id, CASE WHEN coalesce(id, '') = '' THEN 'Point ID cannot be empty' WHEN vector IS NULL THEN 'Vector is missing for point ID ''' || id || ''''
        WHEN len(vector) <> 64 THEN 'Dimension mismatch for point ID ''' || id || ''': expected 64, got ' || len(vector) END AS e,
        CASE WHEN payload IS NOT NULL AND NOT json_valid(payload) THEN 'Invalid payload for point ID ''' || id || '''' END AS p FROM points)""")
def validate_table(spark, d):
    """The whole export as one batch."""
    rows = table(spark, d, "points").withColumn("pos", F.monotonically_increasing_id())
    return state.validate_points(rows, 64).drop("pos")


@query("""SELECT collection_name, count(DISTINCT leaves) AS n_values, count(leaves) AS n_payloads FROM (SELECT collection_name, CASE WHEN payload IS NOT NULL THEN (
        SELECT list_sort(list(fullkey || ' ' || CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || CAST(CAST(atom AS DOUBLE) AS VARCHAR) ELSE type || coalesce(json_extract_string(atom, '$'), '') END))
        FROM json_tree(s.payload)) END AS leaves FROM snapshot_points s) GROUP BY collection_name""")
def payload_values(spark, d):
    """How many different payloads each collection's snapshots hold, however they are written."""
    rows = table(spark, d, "snapshot_points").select("collection_name", canonical_json(F.col("payload")).alias("c"))
    return rows.groupBy("collection_name").agg(F.count_distinct("c").alias("n_values"), F.count("c").alias("n_payloads"))


@query("SELECT TRUE AS rejected, 2::BIGINT AS succeeded, 4::BIGINT AS failed, 'Dimension mismatch for point ID ''invalid_dim_p2'': expected 3, got 2' AS overall_error")
def validate_summary(spark, d):
    return state.batch_result(state.validate_points(_bad_batch(spark), 3))


@query("SELECT count(*) FILTER (vec_id % 11 <> 0) AS succeeded, count(*) FILTER (vec_id % 11 = 0) AS failed, FALSE AS rejected, 'Invalid payload for point ID ''' || min(vec_id) FILTER (vec_id % 11 = 0) || '''' AS overall_error FROM embeddings")
def batch_summary(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 11 == 0, "{").otherwise("{}").alias("payload"))
    return state.batch_result(state.validate_points(rows, 64))


@query("SELECT row_number() OVER (ORDER BY event_id DESC) - 1 + 100 AS lsn, event_id FROM events")
def log_append_sequence(spark, d):
    rows = table(spark, d, "events").select("event_id", (-F.col("event_id")).alias("pos"))
    return state.sequence_rows(rows, 100, ["pos"]).select("lsn", "event_id")


def _segmented(spark, d) -> Engine:
    """A collection of the embeddings in four segments."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    engine.create_collection("docs", 64, "COSINE")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("payload"))
    for segment in range(4):
        engine.upsert("docs", rows.where(F.col("pos") % 4 == segment))
        if segment < 3:
            engine.add_segment("docs")
    return engine


@query("SELECT 'docs' AS name, 64 AS dim, 'COSINE' AS metric, 'GREEN' AS status, count(*) AS n, count(DISTINCT vec_id % 4) AS segments, CAST(sum(len(embedding) * 4 + 1) AS BIGINT) AS ram_bytes FROM embeddings")
def collection_stats(spark, d):
    info = _segmented(spark, d).describe("docs")
    return spark.createDataFrame([(info["name"], info["dim"], info["metric"], info["status"], info["count"], info["segments"], info["ram_bytes"])], "name string, dim int, metric string, status string, n bigint, segments bigint, ram_bytes bigint")


@query("SELECT CAST(vec_id % 4 AS INT) AS segment_id, count(*) AS n, CAST(sum(len(embedding) * 4 + 1) AS BIGINT) AS ram_bytes FROM embeddings GROUP BY ALL")
def segment_stats(spark, d):
    return _segmented(spark, d).segment_stats("docs")


@query("SELECT name, 0::BIGINT AS count, 'GREEN' AS status, dim, metric FROM collections")
def catalog_list(spark, d):
    """The collections of the table, created in a store and listed by it."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    for c in table(spark, d, "collections").collect():
        engine.create_collection(c["name"], c["dim"], c["metric"], GraphConfig(c["dim"], c["m"], c["m_max0"], c["ef_construction"], c["ef_search"] or 50))
    return engine.describe_all()


@query("SELECT CAST(vec_id AS VARCHAR) AS point_id, 'OK' AS status_code FROM embeddings WHERE vec_id < 100 AND vec_id % 7 = 0 UNION ALL SELECT 'never seen', 'NOT_FOUND'")
def engine_delete_again(spark, d):
    """Deletes of points that were deleted before a checkpoint: they are remembered."""
    engine = _engine(spark, d)
    engine.checkpoint("docs")
    return engine.delete("docs", [*(str(i) for i in range(0, 100, 7)), "never seen"]).select("point_id", "status_code")


@query("SELECT count(*) - 3 AS kept, 3::BIGINT AS cut FROM (SELECT 1 FROM embeddings UNION ALL SELECT 1 FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT 1 FROM embeddings WHERE vec_id < 100 AND vec_id % 7 = 0)")
def engine_repair(spark, d):
    """The last three records of a log are damaged on disk, found by their checksums and cut."""
    engine = _engine(spark, d)
    parts = engine._meta("docs")["parts"]
    at = f"{engine._dir('docs')}/log/part={parts - 1}"
    rows = materialize(engine.spark.read.parquet(at), "damage")
    top = rows.agg(F.max("lsn")).first()[0]
    rows.withColumn("id", F.when(F.col("lsn") > top - 3, F.concat(F.col("id"), F.lit("?"))).otherwise(F.col("id"))).write.mode("overwrite").parquet(at)
    cut = engine.repair("docs")
    return engine.log("docs").agg(F.count("*").alias("kept")).withColumn("cut", F.lit(cut).cast("bigint"))


@query(_GRAPH_STORE)
def engine_graph(spark, d):
    """The stored neighbour graph of a collection."""
    engine = _engine(spark, d)
    engine.build_graph("docs", 3)
    return engine.graph("docs").select("src", "dst")


def _engine(spark, d) -> Engine:
    """A store with one collection of the embeddings whose payload can be parsed, some updated and deleted."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    engine.create_collection("docs", 64, "COSINE")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("payload"))
    engine.upsert("docs", rows)
    engine.upsert("docs", rows.where("pos % 10 = 3"))
    engine.delete("docs", [str(i) for i in range(0, 100, 7)])
    return engine


_STORE = "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 1 END AS version, label FROM embeddings WHERE NOT (vec_id < 100 AND vec_id % 7 = 0)"


def _stored(points: DataFrame) -> DataFrame:
    return points.select("id", F.col("version").cast("int").alias("version"), field(F.col("payload"), "label").cast("int").alias("label"))


@query(_STORE)
def engine_points(spark, d):
    return _stored(_engine(spark, d).points("docs"))


@query(_STORE)
def engine_after_checkpoint(spark, d):
    engine = _engine(spark, d)
    engine.checkpoint("docs")
    return _stored(engine.points("docs"))


@query(_STORE)
def snapshot_roundtrip(spark, d):
    engine = _engine(spark, d)
    engine.create_snapshot("docs", "s1")
    engine.restore_snapshot("docs", "s1", "copy")
    return _stored(engine.points("copy"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS was, CASE WHEN vec_id % 5 = 1 THEN NULL WHEN vec_id % 10 = 3 THEN 3 END::BIGINT AS now FROM embeddings WHERE NOT (vec_id < 100 AND vec_id % 7 = 0) AND vec_id >= 400 AND (vec_id % 5 = 1 OR vec_id % 10 = 3)")
def snapshot_diff(spark, d):
    """A snapshot beside the collection that has moved on: versions of points that changed or went."""
    engine = _engine(spark, d)
    engine.create_snapshot("docs", "s1")
    rows = table(spark, d, "embeddings").where("vec_id >= 400").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("payload"))
    engine.upsert("docs", rows.where("pos % 10 = 3"))
    engine.delete("docs", [r["id"] for r in rows.where("pos % 5 = 1").select("id").collect()])
    kept, now = engine.read_snapshot("docs", "s1").select("id", F.col("version").alias("was")), engine.points("docs").select("id", F.col("version").alias("now"))
    return kept.join(now, "id", "left").where(~F.col("was").eqNullSafe(F.col("now")))


@query(f"{_PTS}, s AS (SELECT vec_id, label, {_COS} AS score FROM pts, q WHERE NOT (vec_id < 100 AND vec_id % 7 = 0) AND label = 3) SELECT CAST(vec_id AS VARCHAR) AS id, round(score, 6) + 0 AS score, CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS version FROM s ORDER BY s.score DESC, id LIMIT 5")
def engine_search(spark, d):
    return _engine(spark, d).search("docs", _q0(spark, d), 5, {"label": 3}).select("id", _six("score"), "version")


_GRAPH = f"""e AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity({_E}) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity({_E}) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 15)"""
_BOTH = f"WITH {_GRAPH}, both_ways AS (SELECT src, dst, score FROM e UNION SELECT dst, src, score FROM e), cut AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM both_ways QUALIFY rank <= 32)"


@query(f"WITH {_GRAPH} SELECT src, dst, round(score, 6) + 0 AS score, rank FROM e")
def knn_graph(spark, d):
    g = graph.knn_graph(_vectors(spark, d), 15, id="vec_id")
    return g.select("src", "dst", _six("score"), F.col("rank").cast("bigint").alias("rank"))


def _linked(spark, d) -> DataFrame:
    # one score an edge whichever side it was computed from
    g = graph.knn_graph(_vectors(spark, d), 15, id="vec_id").withColumn("score", F.round("score", 12))
    return graph.link_both_ways(g, 32)


@query(f"{_BOTH} SELECT src, dst FROM cut")
def knn_graph_pruned(spark, d):
    return _linked(spark, d).select("src", "dst")


@query(f"{_BOTH} SELECT src, count(*) AS degree FROM cut GROUP BY src")
def graph_degree(spark, d):
    return graph.degrees(_linked(spark, d))


@query(f"WITH {_GRAPH} SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM e) WHERE rank <= 3")
def graph_select_best(spark, d):
    g = graph.knn_graph(_vectors(spark, d), 15, id="vec_id")
    return graph.select_best(g, 3).select("src", "dst", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT min(vec_id) AS entry FROM embeddings WHERE vec_id <> 0")
def graph_entry_point(spark, d):
    return graph.entry_point(table(spark, d, "embeddings").where("vec_id <> 0"), id="vec_id")


@query("SELECT i AS n, CAST(floor(-ln(i / 1000.0::DOUBLE) / ln(16.0::DOUBLE)) AS INT) AS level FROM range(1, 1001) t(i)")
def level_draw(spark, d):
    return spark.range(1, 1001).select(F.col("id").alias("n"), graph.level_draw(F.col("id") / 1000.0).alias("level"))


_COLOUR = "WITH s AS (SELECT vec_id, lang FROM embeddings LEFT JOIN documents ON doc_id = vec_id), f AS (SELECT lang, row_number() OVER (ORDER BY min(vec_id)) - 1 AS r FROM s WHERE lang IS NOT NULL GROUP BY lang)"


@query(f"{_COLOUR} SELECT vec_id, s.lang, CAST(r % 10 AS INT) AS colour FROM s LEFT JOIN f USING (lang)")
def color_categorical(spark, d):
    return explore.colour_categorical(_points(spark, d).select("vec_id", "lang"), "lang", "vec_id").select("vec_id", "lang", "colour")


@query("WITH s AS (SELECT vec_id, n_chars FROM embeddings LEFT JOIN documents ON doc_id = vec_id) SELECT vec_id, round((n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ())::DOUBLE, 6) + 0 AS colour FROM s")
def color_numeric(spark, d):
    return explore.colour_numeric(_points(spark, d).select("vec_id", "n_chars"), "n_chars").select("vec_id", _six("colour"))


@query("SELECT count(DISTINCT n_chars) > 10 AS numeric FROM embeddings JOIN documents ON doc_id = vec_id")
def color_mode(spark, d):
    return explore.is_numeric_scale(_points(spark, d), "n_chars")


@query(f"{_PTS}, h AS (SELECT vec_id, {_COS} AS score FROM pts, q ORDER BY score DESC, vec_id LIMIT 10) SELECT e.vec_id, h.vec_id IS NOT NULL AS is_hit, CASE WHEN e.vec_id = 5 THEN 'selected' WHEN h.vec_id IS NOT NULL THEN 'hit' ELSE 'default' END AS style FROM embeddings e LEFT JOIN h USING (vec_id)")
def search_highlight(spark, d):
    points = _vectors(spark, d)
    hits = search.knn(points, _q0(spark, d), 10, id="vec_id")
    return search.highlight(points.select("vec_id"), hits, id="vec_id", selected=5).select("vec_id", "is_hit", "style")


@query(f"{_PTS}, h AS (SELECT vec_id, {_COS} AS score FROM pts, q ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 6) + 0 AS score, label::BIGINT AS version FROM h JOIN pts USING (vec_id)")
def search_enrich(spark, d):
    points = _points(spark, d).withColumn("version", F.col("label").cast("bigint"))
    return search.enrich(search.knn(points, _q0(spark, d), 10, id="vec_id"), points, id="vec_id", with_payload=False).select("vec_id", _six("score"), "version")


@query("SELECT * FROM (VALUES (1, '1.0 2.5 -3.0'), (2, NULL), (3, NULL), (4, '7.0')) t(n, numbers)")
def parse_vector_literal(spark, d):
    rows = spark.createDataFrame([(1, "1, 2.5,, -3"), (2, "1,x"), (3, " , "), (4, "7")], "n int, text string")
    return rows.select("n", F.array_join(F.transform(src.parse_vector_literal(F.col("text")), lambda x: x.cast("string")), " ").alias("numbers"))


@query("""SELECT * FROM (VALUES (0, 'a', '{"t":1}', NULL), (1, NULL, NULL, 'id must be a string'), (2, 'c', NULL, 'vector must be an array of numbers'), (3, 'd', '[1]', 'metadata must be an object')) t(pos, id, payload, error)""")
def parse_points_json(spark, d):
    text = '[{"id":"a","vector":[1,2],"metadata":{"t":1}},{"vector":[1]},{"id":"c","vector":"x"},{"id":"d","vector":[1],"metadata":[1]}]'
    rows = spark.createDataFrame([(text,), ("no json",)], "text string")
    return rows.select(F.inline(src.parse_points_json(F.col("text")))).select("pos", "id", "payload", "error")


@query("SELECT vec_id, strftime(TIMESTAMP '2024-01-02 03:04:05', 'docs_%Y%m%d_%H%M%S') AS name, printf('ID: %d<br>(%.4f, %.4f)<br>score: %.4f', vec_id, embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE) AS hover FROM embeddings")
def labels_and_names(spark, d):
    e = table(spark, d, "embeddings")
    place = lambda i: F.col("embedding")[i].cast("double")
    name = snapshot_name(F.lit("docs"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return e.select("vec_id", name.alias("name"), explore.hover_text(F.col("vec_id"), place(0), place(1), place(2)).alias("hover"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1000")
def explore_sample(spark, d):
    return src.explore_sample(table(spark, d, "embeddings").select("vec_id", "label"), id="vec_id")


@query()
def pca_2d(spark, d):
    return explore.pca_2d(_vectors(spark, d), id="vec_id").select("vec_id", F.abs(F.round("x", 4)).alias("x"), F.abs(F.round("y", 4)).alias("y"))


@query()
def layout_2d(spark, d):
    points = _vectors(spark, d)
    return explore.neighbour_layout(graph.knn_graph(points, 15, id="vec_id"), explore.pca_2d(points, id="vec_id"), 3, id="vec_id")


@query()
def lsh_knn(spark, d):
    return graph.lsh_knn(_vectors(spark, d), _q0(spark, d), 10, id="vec_id")


@query()
def ivf_knn(spark, d):
    return _batch(graph.CellIndex.build(_vectors(spark, d), id="vec_id").search_batch(_queries(spark, d), 10, nprobe=16))


@query()
def ivf_recall(spark, d):
    points = _vectors(spark, d)
    exact = search.knn_batch(points, _queries(spark, d), 10, id="vec_id")
    return graph.recall(exact, graph.CellIndex.build(points, id="vec_id").search_batch(_queries(spark, d), 10, nprobe=16))


_SCORED = """WITH best AS (SELECT * FROM points WHERE collection_name = 'press_pages' QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, len(vector) DESC NULLS LAST) = 1),
    q AS (SELECT list_transform(range(64), lambda i: CAST(1 + i % 5 AS DOUBLE)) AS qv),
    ok AS (SELECT id, coalesce(len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64, FALSE) AS good, vector FROM best),
    f AS (SELECT id, good, list_transform(range(1, 65), lambda i: CASE WHEN good THEN coalesce(vector[i], 0)::DOUBLE ELSE 1::DOUBLE END) AS v FROM ok),
    s AS (SELECT id, CASE WHEN NOT good THEN NULL WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN {zero} ELSE {score} END AS score FROM f, q)
    SELECT id, round(score, 5) + 0 AS score FROM s"""


def _dirty(spark, d) -> tuple[DataFrame, list[float]]:
    """Points of one collection with all their unusable vectors, and a query."""
    rows = table(spark, d, "points").where("collection_name = 'press_pages'")
    newest = F.max_by("vector", F.struct(F.coalesce("version", F.lit(-(1 << 62))), F.coalesce(F.size("vector"), F.lit(-1))))
    return rows.groupBy("id").agg(newest.alias("vector")), [float(1 + i % 5) for i in range(64)]


@query(_SCORED.format(zero="0.0", score="list_cosine_similarity(v, qv)"))
def knn_dirty_cosine(spark, d):
    points, q = _dirty(spark, d)
    return search.knn(points, q, points.count()).select("id", (F.round("score", 5) + 0).alias("score"))


@query(_SCORED.format(zero="list_distance(v, qv)", score="list_distance(v, qv)"))
def knn_dirty_l2_batch(spark, d):
    points, q = _dirty(spark, d)
    asked = spark.createDataFrame([(0, q)], "qid int, query array<double>")
    return search.knn_batch(points, asked, points.count(), "L2").select("id", (F.round("score", 5) + 0).alias("score"))


@query()
def synthetic_vectors(spark, d):
    return src.synthetic_vectors(spark, 1000, 128)


@query(_ALIVE + " SELECT id, lsn, n AS version, payload FROM alive WHERE back = 1")
def stream_fold(spark, d):
    """The log applied as a stream of several batches, by the change-feed operator."""
    from ..streaming.changefeed import ChangeFeed

    feed = scratch_path(spark, "events")
    log = _log(spark, d).select(F.lit("events").alias("collection_name"), F.col("id").cast("string").alias("id"), "op", F.lit(None).cast("bigint").alias("start_lsn"), F.lit(None).cast("int").alias("entry_no"), "lsn", F.lit(None).cast("array<float>").alias("vector"), F.col("payload").alias("metadata"), F.col("ts").alias("arrived_at"))
    log.repartition(4, "lsn").write.parquet(feed)
    now = ChangeFeed(spark, feed, max_files=2).run_available().current()
    return now.select(F.col("id").cast("bigint").alias("id"), "lsn", "version", F.col("metadata").alias("payload"))


