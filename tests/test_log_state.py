from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.operators import log as wal
from vecloom.operators import state
from vecloom.operators.components import connected_components

SCHEMA = "lsn bigint, op string, id string, vector array<float>, payload string"


def replay(events):
    live = {}
    for lsn, op, id, payload in events:
        if op == "delete":
            live.pop(id, None)
        elif id in live:
            live[id] = (lsn, (live[id][1] or 0) + 1, payload)
        else:
            live[id] = (lsn, 1 if payload else None, payload)
    return live


def folded(df):
    return {r.id: (r.lsn, r.version, r.payload) for r in df.collect()}


_events = st.lists(st.tuples(st.sampled_from(["upsert", "upsert", "upsert", "delete"]), st.sampled_from("abcd"), st.sampled_from([None, "{}", '{"x":1}'])), max_size=60)


@settings(max_examples=10, deadline=None)
@given(_events, st.integers(-1, 60))
def test_version_fold_is_replay(spark, events, cp):
    events = [(i, op, id, None if op == "delete" else p) for i, (op, id, p) in enumerate(events)]
    log = spark.createDataFrame([(i, op, id, [1.0], p) for i, op, id, p in events], SCHEMA)
    assert folded(state.version_fold(log)) == replay(events)
    at = state.version_fold(log.where(F.col("lsn") <= cp))
    assert folded(wal.recover(at, log, cp)) == replay(events)


def test_version_sequence(spark):
    rows = [(0, "upsert", "p1", [0.1], '{"d":1}'), (1, "upsert", "p1", [0.1], '{"d":2}'), (2, "upsert", "p2", [0.5], None), (3, "upsert", "p1", [0.1], None), (4, "upsert", "p1", [0.1], None), (5, "upsert", "p2", [0.5], "{}")]
    log = spark.createDataFrame(rows, SCHEMA)
    assert folded(state.version_fold(log.where("lsn <= 3"))) == {"p1": (3, 3, None), "p2": (2, None, None)}
    assert folded(state.version_fold(log)) == {"p1": (4, 4, None), "p2": (5, 1, "{}")}
    assert {r.id: r.payload for r in state.keep_payload_fold(log).collect()} == {"p1": '{"d":2}', "p2": "{}"}


def test_deletes(spark):
    log = spark.createDataFrame([(0, "upsert", "a", [1.0], None), (1, "delete", "a", None, None), (2, "upsert", "b", [1.0], None)], SCHEMA)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("",)], "id string")
    got = {r.point_id: r.status_code for r in state.delete_status(log, asked).collect()}
    assert got == {"a": "OK", "b": "OK", "c": "NOT_FOUND", "": "INVALID_ARGUMENT"}
    assert [r.id for r in state.tombstones(log).collect()] == ["a"]
    assert [r.id for r in state.fold_latest(log).collect()] == ["b"]


def test_log_ranges(spark):
    log = spark.range(10).withColumnRenamed("id", "lsn")
    assert [r.lsn for r in wal.after(log, 7).collect()] == [8, 9]
    assert wal.after(log, None).count() == 10
    assert tuple(wal.bounds(log).first()) == (0, 9) and tuple(wal.bounds(log.limit(0)).first()) == (None, None)
    firsts = [wal.bounds(wal.truncate_prefix(log.where("lsn < 6"), n, records=2)).first().first_lsn for n in (0, 1, 2, 4, 6)]
    assert firsts == [0, 0, 2, 4, 4]
    assert [wal.bounds(wal.truncate_suffix(log, n)).first().last_lsn for n in (4, 3)] == [3, 2]
    holes = wal.gaps(log.where("lsn not in (3, 4, 7)"), records=3)
    assert sorted(map(tuple, holes.collect())) == [(2, 5), (6, 8)]
    for records in (1, 2, 4, 100):
        assert sorted(map(tuple, wal.gaps(log.where("lsn not in (3, 4, 5, 6, 8)"), records=records).collect())) == [(2, 7), (7, 9)]
    marked = log.withColumn("_corrupt_record", F.when(F.col("lsn") == 1, "x"))
    assert sorted(r.lsn for r in wal.valid_prefix(marked, records=5).collect()) == [0, 5, 6, 7, 8, 9]


def test_lookups_and_validation(spark):
    points = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    asked = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a"), (3, "b"), (4, "")], "pos int, id string")
    assert [r.id for r in state.get_points(points, asked).collect()] == ["b", "a", "b"]
    assert {r.id for r in state.missing_ids(points, asked).collect()} == {"x", ""}
    numbered = state.sequence_rows(spark.range(100).select((-F.col("id")).alias("pos")), 7, ["pos"]).orderBy("pos").collect()
    assert [r.lsn for r in numbered] == list(range(7, 107))
    assert state.sequence_rows(spark.range(0).select(F.col("id").alias("pos")), 7, ["pos"]).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 9), (9, 8), (8, 10), (3, 1), (None, 4)]
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.component for r in connected_components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8, 10: 8}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(df.limit(0)).count() == 0
