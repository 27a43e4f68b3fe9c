import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import explore
from vecloom.schema import AlreadyExists, CorruptData, GraphConfig, InvalidArgument, NotFound, status_of
from vecloom.sources import points as src
from vecloom.sources.store import AsyncEngine, Engine


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def versions(df):
    return {r.id: r.version for r in df.collect()}


def test_collections(engine):
    engine.create_collection("c", 3)
    assert engine.list_collections() == ["c"]
    info = engine.describe("c")
    assert (info["count"], info["dim"], info["metric"], info["status"], info["segments"]) == (0, 3, "COSINE", "GREEN", 1)
    assert (info["config"]["m"], info["config"]["m_max0"], info["config"]["ef_construction"], info["config"]["ef_search"]) == (16, 32, 200, 50)
    for wrong in (("c", 3, AlreadyExists), ("", 3, InvalidArgument), ("x", 0, InvalidArgument)):
        with pytest.raises(wrong[2]):
            engine.create_collection(*wrong[:2])
    with pytest.raises(InvalidArgument):
        engine.create_collection("x", 3, "UNSPECIFIED")
    with pytest.raises(InvalidArgument):
        engine.create_collection("x", 3, config=GraphConfig(vector_dim=4))
    with pytest.raises(InvalidArgument):
        GraphConfig(vector_dim=3, m=0).validate()
    assert GraphConfig.derived(3, 8).m_max0 == 16
    engine.files.replace(f"{engine._dir('c')}/meta.json", "{broken")
    with pytest.raises(CorruptData):
        engine.points("c")
    engine.files.replace(f"{engine._dir('c')}/meta.json", "{}")
    engine.drop_collection("c")
    with pytest.raises(NotFound):
        engine.describe("c")


def test_points_live_through_checkpoint_and_snapshot(spark, engine):
    engine.create_collection("c", 2)
    engine.upsert_rows("c", [("p1", [0.1, 0.2], '{"data":"first"}')])
    engine.upsert_rows("c", [("p1", [0.11, 0.22], '{"data":"second"}')])
    assert versions(engine.points("c")) == {"p1": 2}
    engine.upsert_rows("c", [("p2", [0.5, 0.5], None), ("p1", [0.111, 0.222], None)])
    assert versions(engine.points("c")) == {"p1": 3, "p2": None}
    engine.checkpoint("c")
    engine.add_segment("c")
    engine.upsert_rows("c", [("p1", [0.1, 0.2], None), ("p3", [1.0, 0.0], '{"color":"green"}')])
    assert versions(engine.points("c")) == {"p1": 4, "p2": None, "p3": 1}
    assert {r.segment_id for r in engine.points("c").collect()} == {0, 1}
    status = {r.point_id: r.status_code for r in engine.delete("c", ["p2", "zz", ""]).collect()}
    assert status == {"p2": "OK", "zz": "NOT_FOUND", "": "INVALID_ARGUMENT"}
    assert [r.id for r in engine.get("c", ["p3", "p2", "p1", "p3"]).collect()] == ["p3", "p1", "p3"]
    assert [r.id for r in engine.search("c", [1.0, 0.0], 5, {"color": "green"}).collect()] == ["p3"]
    assert len(engine.search("c", [0.0, 0.0], 5).collect()) == 2
    with pytest.raises(ValueError):
        engine.search("c", [1.0], 5)
    manifest = engine.create_snapshot("c", "one")
    assert engine.create_snapshot("c")["snapshot_name"].startswith("c_")
    with pytest.raises(AlreadyExists):
        engine.create_snapshot("c", "one")
    assert len(engine.list_snapshots("c")) == 2 and engine.list_snapshots("unknown") == []
    engine.upsert_rows("c", [("p4", [1.0, 1.0], None)])
    engine.restore_snapshot("c", "one", "back")
    assert versions(engine.points("back")) == {"p1": 4, "p3": 1} and manifest["collection_name"] == "c"
    engine.upsert_rows("back", [("p1", [1.0, 1.0], "{}")])
    assert versions(engine.points("back"))["p1"] == 5
    with pytest.raises(AlreadyExists):
        engine.restore_snapshot("c", "one", "back")
    with pytest.raises(NotFound):
        engine.restore_snapshot("c", "none", "x")
    engine.delete_snapshot("c", "one")
    with pytest.raises(NotFound):
        engine.delete_snapshot("c", "one")
    assert engine.checkpoint_all() == {"back": None, "c": None} and engine.verify("back") == {"count": 2, "dim": 2}
    pool = AsyncEngine(engine)
    assert pool.list_points("back").result().count() == 2
    pool.close()


def test_bad_batch_is_refused(engine):
    engine.create_collection("c", 3)
    rows = [("ok", [1.0, 2.0, 3.0], None), ("dim", [1.0, 2.0], None), ("", [4.0, 5.0, 6.0], None), ("none", None, None)]
    status = engine.upsert_rows("c", rows).collect()
    assert len(status) == 3 and {r.status_code for r in status} == {"INVALID_ARGUMENT"}
    assert engine.points("c").count() == 0
    status = engine.upsert_rows("c", [("a", [1.0, 2.0, 3.0], '{"x":NaN}'), ("b", [1.0, 2.0, 3.0], "{}")]).collect()
    assert {r.point_id: r.status_code for r in status} == {"a": "INVALID_ARGUMENT", "b": "OK"}
    assert versions(engine.points("c")) == {"b": 1}
    for call in (lambda: engine.upsert_rows("c", []), lambda: engine.delete("c", [])):
        with pytest.raises(InvalidArgument):
            call()


def test_deletes_outlive_checkpoints_and_snapshots(spark, engine):
    engine.create_collection("c", 2)
    engine.upsert_rows("c", [("a", [1.0, 0.0], None), ("b", [0.0, 1.0], "{}"), ("d", [1.0, 1.0], "{}")])
    code = lambda name, *ids: {r.point_id: r.status_code for r in engine.delete(name, list(ids)).collect()}
    assert code("c", "a", "zz") == {"a": "OK", "zz": "NOT_FOUND"}
    engine.checkpoint("c")
    assert code("c", "a", "zz") == {"a": "OK", "zz": "NOT_FOUND"}
    assert code("c", "b") == {"b": "OK"}
    engine.checkpoint("c")
    engine.upsert_rows("c", [("a", [1.0, 0.5], "{}")])
    engine.checkpoint("c")
    assert versions(engine.points("c")) == {"a": 1, "d": 1} and {r.id for r in engine.tombstones("c").collect()} == {"b"}
    engine.create_snapshot("c", "s")
    engine.restore_snapshot("c", "s", "copy")
    assert code("copy", "b", "a") == {"b": "OK", "a": "OK"}


def test_damage_is_found_and_cut(spark, engine):
    engine.create_collection("c", 2)
    engine.upsert_rows("c", [(x, [1.0, 0.0], "{}") for x in "abcd"])
    engine.upsert_rows("c", [("e", [1.0, 0.0], "{}")])
    at = f"{engine._dir('c')}/log/part=0"
    rows = spark.createDataFrame(spark.read.parquet(at).toArrow())
    rows.withColumn("payload", F.when(F.col("id") == "c", "{ }").otherwise(F.col("payload"))).write.mode("overwrite").parquet(at)
    with pytest.raises(CorruptData):
        engine.verify("c")
    assert engine.repair("c") == 2 and versions(engine.points("c")) == {"a": 1, "b": 1, "e": 1} and engine.repair("c") == 0


def test_broken_replacement_and_lost_files(spark, engine):
    engine.create_collection("c", 2)
    engine.upsert_rows("c", [("a", [1.0, 0.0], None)])
    engine.upsert_rows("c", [("b", [1.0, 0.0], None)])
    meta = f"{engine._dir('c')}/meta.json"
    text = engine.files.read(meta)
    # the new text stands beside, the old one is gone: as after a crash between the two
    engine.files.fs.rename(engine.files.path(meta), engine.files.path(meta + ".tmp"))
    assert engine.files.read(meta) == text and engine.list_collections() == ["c"] and engine.points("c").count() == 2
    engine.add_segment("c")
    assert engine._meta("c")["segment"] == 1
    engine.files.delete(meta)
    assert engine._meta("c")["dim"] == 2 and versions(engine.points("c")) == {"a": None, "b": None}
    engine.files.replace(meta, text)
    engine.files.delete(f"{engine._dir('c')}/log/part=0")
    with pytest.warns(UserWarning):
        assert versions(engine.points("c")) == {"b": None}
    engine.files.delete(f"{engine._dir('c')}/log/part=1")
    with pytest.raises(CorruptData):
        engine.points("c")


def test_errors_and_catalog(spark, engine):
    engine.create_collection("c", 2)
    engine.create_collection("d", 3, "EUCLIDEAN_L2")
    good = spark.createDataFrame([("a", [1.0, 0.0], None)], "id string, vector array<float>, payload string")
    engine.upsert_or_raise("c", good)
    with pytest.raises(InvalidArgument, match="Dimension mismatch"):
        engine.upsert_or_raise("d", good)
    with pytest.raises(InvalidArgument):
        engine.search("c", [1.0], 1)
    try:
        engine.search("c", [1.0], 1)
    except Exception as wrong:  # noqa: BLE001
        assert status_of(wrong) == "INVALID_ARGUMENT" and status_of(None) == "OK" and status_of(NotFound()) == "NOT_FOUND" and status_of(OSError()) == "INTERNAL"
    assert [tuple(r) for r in engine.describe_all().collect()] == [("c", 1, "GREEN", 2, "COSINE"), ("d", 0, "GREEN", 3, "EUCLIDEAN_L2")]


def test_index_graph_and_own_metric(spark, engine):
    from vecloom.functions.distance import dot, register_metric
    from vecloom.operators import search

    x = np.random.default_rng(1).standard_normal((300, 4)).round(3).tolist()
    engine.create_collection("c", 4)
    engine.upsert_rows("c", [(f"p{i}", v, f'{{"n":{i % 3}}}') for i, v in enumerate(x)])
    with pytest.raises(NotFound):
        engine.search("c", x[0], 3, approximate=True)
    engine.create_cell_index("c", 8)
    engine.upsert_rows("c", [("new", x[0], "{}")])
    engine.delete("c", ["p0"])
    exact = [r.id for r in engine.search("c", x[0], 10).collect()]
    assert [r.id for r in engine.search("c", x[0], 10, approximate=True, ef_search=1000).collect()] == exact and exact[0] == "new"
    assert len(set(exact) & {r.id for r in engine.search("c", x[0], 10, approximate=True, ef_search=12).collect()}) >= 8
    assert {r.payload for r in engine.search("c", x[0], 10, {"n": 1}, approximate=True).collect()} == {'{"n":1}'}
    engine.build_graph("c", 4)
    assert len(engine.links("c", "new")) >= 4 and "p0" not in engine.links("c", "new")
    with pytest.raises(NotFound):
        engine.links("c", "p0")
    register_metric("dot", dot, higher_is_better=True)
    best = [r.id for r in search.knn(engine.points("c"), x[0], 3, "dot").collect()]
    live = {f"p{i}": v for i, v in enumerate(x) if i} | {"new": x[0]}
    assert best == sorted(live, key=lambda i: -float(np.dot(np.float32(live[i]), x[0])))[:3]


def test_payload_kinds_survive(engine):
    payload = {"s": "hello", "i": 123, "f": 45.67, "t": True, "n": None, "l": ["item1", 100, True], "o": {"k": "v"}}
    engine.create_collection("c", 2)
    engine.upsert_rows("c", [("p1", [0.1, 0.2], json.dumps(payload)), ("p2", [0.3, 0.4], None), ("p3", [0.5, 0.6], "{}")])
    got = {r.id: r.payload for r in engine.points("c").collect()}
    assert json.loads(got["p1"]) == payload and got["p2"] is None and got["p3"] == "{}"


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("1, 2.5,,3 ",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(src.parse_vector_literal(F.col("t"))).collect()] == [[1.0, 2.5, 3.0], None, None, None]
    (tmp_path / "a.json").write_text('[{"id":"a","vector":[1,2.5],"metadata":{"b":1.0}},{"id":3,"vector":[1]}]')
    got = src.read_points_json(spark, f"{tmp_path}/a.json").orderBy("pos").collect()
    assert (got[0].id, got[0].vector, got[0].payload, got[0].error) == ("a", [1.0, 2.5], '{"b":1}', None)
    assert got[1].error == "id must be a string"
    (tmp_path / "lines.json").write_text('[\n{"id":"a","vector":[1,2.5],"metadata":{"b":1.0}},\n\n{"id":3,"vector":[1]},\n{broken\n]\n')
    lines = {r.error: (r.id, r.vector, r.payload) for r in src.read_points_lines(spark, f"{tmp_path}/lines.json").collect()}
    assert lines == {None: ("a", [1.0, 2.5], '{"b":1}'), "id must be a string": ("3", [1.0], None), "line is no JSON": (None, None, None)}
    made = src.synthetic_vectors(spark, 20, 5)
    assert made.collect() == src.synthetic_vectors(spark, 20, 5).repartition(3).orderBy(F.expr("cast(substr(id, 5) as int)")).collect()
    assert all(-1 <= x <= 1 for r in made.collect() for x in r.vector)


def test_explore(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, "y", 3.0), (3, None, None), (4, "x", 5.0)], "id int, tag string, n double")
    assert [r.colour for r in explore.colour_categorical(rows, "tag", "id").orderBy("id").collect()] == [0, 1, None, 0]
    assert [r.colour for r in explore.colour_numeric(rows, "n").orderBy("id").collect()] == [0.0, 0.5, None, 1.0]
    assert not explore.is_numeric_scale(rows, "n").first()[0] and explore.is_numeric_scale(spark.range(20), "id").first()[0]
    assert rows.select(explore.hover_text(F.col("id"), F.col("n"), F.col("n"), F.col("n"))).first()[0] == "ID: 1<br>(1.0000, 1.0000)<br>score: 1.0000"
