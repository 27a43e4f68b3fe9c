import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import graph, search

SIX = [
    ("p1", [0.1, 0.1], '{"tag":"A","count":10,"active":true,"category":"X"}'), ("p2", [0.2, 0.2], '{"tag":"B","count":20,"active":false,"category":"X"}'),
    ("p3", [0.8, 0.8], '{"tag":"A","count":10,"active":true,"category":"Y"}'), ("p4", [0.3, 0.3], '{"tag":"C","count":30,"active":true,"category":"Y","extra_field":"extra_value"}'),
    ("p5", [0.15, 0.15], '{"tag":"A","count":20}'), ("p6", [0.9, 0.9], None),
]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, "id string, vector array<float>, payload string").cache()


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).standard_normal((300, 8)).astype(np.float32)
    x[7] = x[8] = x[9]
    x[20] = 0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>").cache()


@pytest.mark.parametrize("must,k,expected", [({"tag": "A"}, 5, {"p1", "p3", "p5"}), ({"count": 10}, 5, {"p1", "p3"}), ({"active": True}, 5, {"p1", "p3", "p4"}), ({"tag": "A", "active": True, "category": "X"}, 5, {"p1"}), ({"tag": "none"}, 5, set()), ({"extra_field": "extra_value"}, 5, {"p4"})])
def test_filter_scenarios(six, must, k, expected):
    for mode in ("pre", "post"):
        assert {r.id for r in search.knn_filtered(six, [0.1, 0.1], k, must, mode=mode).collect()} == expected
    assert len(search.knn_filtered(six, [0.1, 0.1], 1, {"category": "Y", "active": True}).collect()) == 1


def test_edges(spark, six):
    assert search.knn(six, [0.1, 0.1], 0).count() == 0
    assert search.knn(six, [0.1, 0.1], 100).count() == 6
    assert search.knn(six.limit(0), [0.1, 0.1], 5).count() == 0
    assert {r.score for r in search.knn(six, [0.0, 0.0], 6).collect()} == {0.0}
    with pytest.raises(search.DimensionMismatch):
        search.query_vector([1.0], 2)
    with pytest.raises(ValueError):
        search.query_vector([])
    assert [search.overfetch(k) for k in (5, 12, 13, 200, 5000)] == [55, 62, 65, 1000, 1000]


def test_segments(spark):
    rows = spark.createDataFrame([("a", [1.0, 1.0], 0), ("b", [2.0, 2.0], 0), ("c", [10.0, 10.0], 1), ("d", [11.0, 11.0], 1)], "id string, vector array<float>, seg int")
    assert [r.id for r in search.knn_segments(rows, [0.0, 0.0], 4, "seg", "L2").collect()] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
def test_batch_equals_brute_force(spark, cloud, metric):
    x, points = cloud
    queries = points.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    y = x.astype(float)
    for found in (search.knn_batch(points.repartition(5), queries, 7, metric), search.knn_batch_columns(points, queries, 7, metric)):
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        for q in range(0, 300, 30):
            if metric == "L2":
                s = -np.sqrt(((y - y[q]) ** 2).sum(1))
            else:
                n = np.linalg.norm(y, axis=1) * np.linalg.norm(y[q])
                s = np.divide(y @ y[q], n, out=np.zeros(300), where=n > 0)
            assert got[q] == sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:7]
    assert search.knn_batch(points, queries.limit(0), 7).count() == 0


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
def test_tiles_of_queries_give_the_same(spark, cloud, metric, monkeypatch):
    _, points = cloud
    queries = points.select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    whole = {tuple(r) for r in search.knn_batch(points, queries, 4, metric, exclude_self=True).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 100)
    monkeypatch.setattr(search, "BLOCK", 64)
    tiles = {tuple(r) for r in search.knn_batch(points, queries, 4, metric, exclude_self=True).collect()}
    assert {r[:2] for r in tiles} == {r[:2] for r in whole} and len(tiles) == 1200
    halves = points.withColumn("half", F.col("id") % 2)
    grouped = search.knn_batch(halves, halves.select(F.col("id").alias("qid"), F.col("vector").alias("query"), "half"), 4, metric, exclude_self=True, group="half").collect()
    assert len(grouped) == 1200 and all((r.qid - r.id) % 2 == 0 for r in grouped)


def test_plans(spark, six, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    six.write.parquet(f"{tmp_path}/six")
    stored = spark.read.parquet(f"{tmp_path}/six")
    text = plan(search.knn(stored, [0.1, 0.1], 3))
    assert "TakeOrderedAndProject" in text and "payload" not in text.split("ReadSchema")[-1]
    queries = stored.select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    assert "WindowGroupLimit" in plan(search.knn_batch_columns(stored, queries, 3))


def test_graph(spark, cloud):
    x, points = cloud
    edges = graph.knn_graph(points, 5)
    assert edges.count() == 1500 and edges.where("src = dst").count() == 0
    assert {r.dst for r in edges.where("src = 7").orderBy("rank").limit(2).collect()} == {8, 9}
    linked = graph.link_both_ways(edges, 6)
    assert graph.degrees(linked).agg(F.max("degree")).first()[0] <= 6
    scores = spark.createDataFrame([(0, i, s) for i, s in enumerate([0.9, 0.8, 0.95, 0.7, 0.85])], "src int, dst int, score double")
    assert [r.dst for r in graph.select_best(scores, 3).orderBy("rank").collect()] == [2, 0, 4]
    assert graph.entry_point(points.where("id > 4")).first()[0] == 5


def test_cell_index_recall(spark, cloud):
    _, points = cloud
    index = graph.CellIndex.build(points.where("id <> 20"), cells=8)
    queries = points.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    exact = search.knn_batch(points.where("id <> 20"), queries, 10)
    assert graph.recall(exact, index.search_batch(queries, 10, nprobe=8)).first().recall == 1.0
    assert graph.recall(exact, index.search_batch(queries, 10, nprobe=5)).first().recall >= 0.7
    q = queries.first()["query"]
    assert [r.id for r in index.search(q, 10, 8).collect()] == [r.id for r in exact.where(f"qid = {queries.first().qid}").orderBy("rank").collect()]


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
def test_recall_without_clusters(spark, metric):
    x = np.random.default_rng(5).standard_normal((1000, 64)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>").cache()
    queries = points.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    exact = search.knn_batch(points, queries, 10, metric).cache()
    index = graph.CellIndex.build(points, metric=metric)
    found = index.search_batch(queries, 10, nprobe=16).cache()
    assert found.select("qid", "id").distinct().count() == found.count() == 200
    assert graph.recall(exact, found).first().recall >= 0.9
    one = [r.id for r in index.search([float(v) for v in x[0]], 10, 16).collect()]
    assert one == [r.id for r in found.where("qid = 0").orderBy("rank").collect()]


def test_recall_on_the_large_table(spark):
    from vecloom.plans import vector_store

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    assert vector_store.ivf_recall(spark, folder).first().recall >= 0.9
    points = vector_store._points(spark, folder).cache()
    queries = vector_store._queries(spark, folder).where("qid < 500").cache()
    found = [(q.qid, r.vec_id) for q in queries.collect() for r in graph.lsh_knn(points, list(q["query"]), 10, id="vec_id").collect()]
    exact = search.knn_batch(points, queries, 10, "L2", id="vec_id")
    assert graph.recall(exact, spark.createDataFrame(found, "qid bigint, id bigint")).first().recall >= 0.9


def test_dirty_vectors_come_last_in_every_path(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(2).standard_normal((12, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(20, [nan, 1.0, 1.0]), (21, [inf, 0.0, 1.0]), (22, None), (23, []), (24, [1.0]), (25, [1.0, None, 0.0]), (26, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id int, vector array<float>")
    for metric in ("COSINE", "L2"):
        for k in (5, 15):
            one = [(r.id, None if r.score is None else round(r.score, 6)) for r in search.knn(points, good[0], k, metric).collect()]
            assert len(one) == min(k, 19) and {r[0] for r in one if r[1] is None} <= {20, 21, 22, 23, 24, 25}
            assert all(s is None for _, s in one[13:]) and [r[0] for r in one[13:]] == sorted(r[0] for r in one[13:])
            queries = spark.createDataFrame([(i, good[0] if i % 9 else None) for i in range(18)], "qid int, query array<double>")
            for block in (4096, 4):
                monkeypatch.setattr(search, "QUERY_BLOCK", block)
                got = {}
                for r in search.knn_batch(points, queries, k, metric).orderBy("qid", "rank").collect():
                    got.setdefault(r.qid, []).append((r.id, None if r.score is None else round(r.score, 6)))
                assert got[1] == one == got[17]
                assert got[0] == [(i, None) for i in sorted(r[0] for r in rows)][:k]
            columns = search.knn_batch_columns(points, queries.where("qid = 1"), k, metric).orderBy("rank").collect()
            assert [(r.id, None if r.score is None else round(r.score, 6)) for r in columns] == one
    index = graph.CellIndex.build(points, cells=4)
    assert [r.id for r in index.search(good[0], 5, 4).collect()] == [r.id for r in search.knn(points, good[0], 5).collect()]


def test_beam_search_walks_the_graph(spark):
    at = [(0, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [1.0, 2.0]), (3, [10.0, 10.0]), (4, [0.0, 0.0])]
    points = spark.createDataFrame(at, "id int, vector array<float>")
    edges = graph.knn_graph(points, 4, "L2").cache()
    assert [n for n, _ in graph.beam_search(edges, points, [0.9, 0.9], 3, 3, "L2")] == [0, 2, 4]
    assert [n for n, _ in graph.beam_search(edges, points.where("id <> 2"), [0.9, 0.9], 3, 3, "L2")] == [0, 4, 1]
    assert graph.beam_search(edges, points, [0.9, 0.9], 99, 3, "L2") == []


def test_enrich_and_highlight(spark, six):
    hits = search.knn(six, [0.1, 0.1], 2)
    with_version = six.withColumn("version", F.lit(3).cast("bigint"))
    assert {r.version for r in search.enrich(hits, with_version).collect()} == {3}
    marks = {r.id: r.style for r in search.highlight(six.select("id"), hits, selected="p6").collect()}
    assert marks["p6"] == "selected" and sum(m == "hit" for m in marks.values()) >= 1
