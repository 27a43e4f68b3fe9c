"""Registered queries of the corpus and vector-collection problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .density import DensityPeaks
from .leak import leaks
from .mih import measured_recall, neighbours, similar_pairs
from .spans import SharedSpans
from .tokenize import decode, encode


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points with cosine at least 0.95 where either is among the 5 best of the other."""
    return similar_pairs(table(spark, sf_dir, "points"), k=5, least=0.95)


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked neighbours themselves, at cosine 0.95 or more."""
    return neighbours(table(spark, sf_dir, "points"), k=5, least=0.95).select("collection_name", "id", "other", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force, for one point in 50 as a query."""
    return measured_recall(table(spark, sf_dir, "points"), k=5, least=0.95)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point in a cluster of at least 5 points linked at cosine 0.80."""
    return DensityPeaks(table(spark, sf_dir, "points")).labels().select("collection_name", "id", "cluster_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cluster: its size and its most typical members."""
    found = DensityPeaks(table(spark, sf_dir, "points")).clusters()
    return found.select("collection_name", "cluster_id", "size", F.array_join("typical", " ").alias("typical"))


def p3_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density peak every point ends at."""
    return DensityPeaks(table(spark, sf_dir, "points")).basins()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text; null and empty texts give empty lists."""
    return encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: every text back from its ids."""
    return decode(encode(table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of an item's passage."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item, the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "split")
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(found, "item_id", "left").select("item_id", "split", F.coalesce("documents", F.lit(0)).alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common piece of at least 300 characters."""
    return SharedSpans(table(spark, sf_dir, "documents")).pairs().select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that shares a piece: its class, links and shared characters."""
    return SharedSpans(table(spark, sf_dir, "documents")).coverage().withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p2_recall, p3_found, p3_clusters, p3_peaks, p6_ids, p6_decoded, p7_found, p7_items, p8_found, p8_coverage)}

_VALID = """
        WITH RECURSIVE valid AS (
            SELECT collection_name, id, CAST(vector AS DOUBLE[]) AS v FROM (
                SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY collection_name, id ORDER BY version DESC NULLS LAST) = 1
            ) WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT a.collection_name, a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS cosine
            FROM valid a JOIN valid b ON a.collection_name = b.collection_name AND a.id <> b.id
        )"""

_RANKED = _VALID + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY collection_name, id ORDER BY cosine DESC, other) AS rank FROM near WHERE cosine >= 0.95)"""

_LABELS = _VALID + """, edge AS (SELECT collection_name AS c, id AS x, other AS y FROM near WHERE cosine >= 0.80),
        reach AS (SELECT c, x, y FROM edge UNION SELECT r.c, r.x, e.y FROM reach r JOIN edge e ON r.c = e.c AND r.y = e.x),
        lowest AS (SELECT c, x, least(x, min(y)) AS k FROM reach GROUP BY c, x),
        labels AS (SELECT *, count(*) OVER (PARTITION BY c, k) AS size FROM lowest),
        density AS (SELECT c, x, count(*) AS d FROM edge GROUP BY c, x)"""

SQL = {
    "p3_found": _LABELS + " SELECT c AS collection_name, x AS id, k AS cluster_id FROM labels WHERE size >= 5",
    "p3_clusters": _LABELS + """
        SELECT c AS collection_name, k AS cluster_id, any_value(size) AS size, string_agg(x, ' ' ORDER BY r) FILTER (r <= 3) AS typical
        FROM (SELECT *, row_number() OVER (PARTITION BY c, k ORDER BY d DESC, x) AS r FROM labels JOIN density USING (c, x) WHERE size >= 5) GROUP BY c, k""",
    "p2_found": _RANKED + """
        SELECT DISTINCT collection_name, least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE rank <= 5""",
    "p2_neighbours": _RANKED + " SELECT collection_name, id, other, round(cosine, 6) + 0 AS cosine, rank FROM ranked WHERE rank <= 5",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_coverage": """
        WITH RECURSIVE t AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 300),
        grams AS (SELECT rep, i, hash(substring(text, CAST(i AS BIGINT), 300)) AS h FROM (SELECT rep, text, unnest(range(1, length(text) - 298)) AS i FROM t WHERE doc_id = rep)),
        shared AS (SELECT h FROM grams GROUP BY h HAVING count(DISTINCT rep) > 1),
        g AS (SELECT * FROM grams SEMI JOIN shared USING (h)), one AS (SELECT DISTINCT rep, h FROM g),
        link AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.h = b.h AND a.rep <> b.rep),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        cluster AS (SELECT a AS rep, least(a, min(b)) AS cluster_id FROM reach GROUP BY a), degree AS (SELECT a AS rep, count(*) AS links FROM link GROUP BY a),
        cover AS (SELECT rep, CAST(sum(least(300, coalesce(nxt - i, 300))) AS BIGINT) AS part FROM (SELECT rep, i, lead(i) OVER (PARTITION BY rep ORDER BY i) AS nxt FROM g) GROUP BY rep)
        SELECT doc_id, rep AS class_id, coalesce(cluster_id, rep) AS cluster_id, copies, coalesce(links, 0) AS links, CASE WHEN copies > 1 THEN length(text) ELSE part END AS shared_chars, length(text) AS n_chars
        FROM t LEFT JOIN cluster USING (rep) LEFT JOIN degree USING (rep) LEFT JOIN cover USING (rep) WHERE copies > 1 OR links IS NOT NULL""",
    "p8_found": """
        WITH grams AS (
            SELECT DISTINCT doc_id, hash(substring(text, CAST(i AS BIGINT), 300)) AS h
            FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)
        ), shared AS (SELECT h FROM grams GROUP BY h HAVING count(*) > 1)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
        FROM (SELECT * FROM grams SEMI JOIN shared USING (h)) a
        JOIN (SELECT * FROM grams SEMI JOIN shared USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
