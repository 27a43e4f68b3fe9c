from vecloom.operators import snapshot_diff as sd

POINTS = "collection_name string, snapshot_name string, id string, vector array<float>, payload string, version bigint, place int, bits int"
MANIFESTS = "collection_name string, snapshot_name string, timestamp_utc string"


def run(spark, points, manifests, known=None):
    rows = spark.createDataFrame([(*p, 0, 0) for p in points], POINTS)
    return {tuple(r) for r in sd.diff(rows, spark.createDataFrame(manifests, MANIFESTS), known).collect()}


TIMES = [("c", "s2", "2025-01-01T10:00:00+05:30"), ("c", "s1", "2025-01-01T04:00:00Z"), ("c", "s3", "2025-01-02T00:00:00.123456-08:00"), ("c", "s1", "2025-01-01T04:00:00Z"), ("c", "none", None), ("d", "s1", "2025-01-01T00:00:00Z")]


def test_kinds_of_change(spark):
    v = [1.0, 2.0]
    points = [
        ("c", "s1", "same", v, '{"a":1,"b":"\\u00e9"}', 1), ("c", "s2", "same", v, '{ "b":"é", "a":1.0}', 9), ("c", "s3", "same", v, '{"b":"é","a":1e0}', None),
        ("c", "s1", "payload", v, None, 1), ("c", "s2", "payload", v, "{}", 1), ("c", "s3", "payload", v, None, 1),
        ("c", "s1", "vector", v, None, 1), ("c", "s2", "vector", [1.0, 2.5], None, 1), ("c", "s3", "vector", None, None, 1),
        ("c", "s1", "gone", v, None, None), ("c", "s3", "gone", v, None, None),
        ("c", "s2", "old rows", v, '{"n":1}', None), ("c", "s2", "old rows", v, '{"n":2}', 3), ("c", "s3", "old rows", v, '{"n":2}', 1), ("c", "s3", "old rows", v, '{"n":2}', 1),
        ("c", "none", "lost", v, None, 1), ("d", "s1", "first", v, None, 1), ("c", "s1", None, v, None, 1),
    ]
    assert run(spark, points, TIMES) == {
        ("c", "s2", "payload", "changed"), ("c", "s3", "payload", "changed"), ("c", "s2", "vector", "changed"), ("c", "s3", "vector", "changed"),
        ("c", "s2", "gone", "removed"), ("c", "s3", "gone", "added"), ("c", "s2", "old rows", "added"),
    }


def test_many_keys_and_empty_snapshots(spark):
    points = [("c", "s1", f"k{i}", [float(i)], None, 1) for i in range(500)] + [("c", "s3", f"k{i}", [float(i)], None, 1) for i in range(250, 700)]
    got = run(spark, points, TIMES)
    assert got == {("c", "s2", f"k{i}", "removed") for i in range(500)} | {("c", "s3", f"k{i}", "added") for i in range(250, 700)}
    assert run(spark, [], TIMES) == set()
    assert run(spark, points, []) == set()


def test_ordinals_are_kept(spark):
    keys = spark.createDataFrame([("c", f"k{i}") for i in range(100)], "collection_name string, id string")
    first = sd.key_ordinals(keys.limit(60)).cache()
    second = sd.key_ordinals(keys, first)
    old = {(r.id): (r.bucket, r.ordinal) for r in first.collect()}
    new = {(r.id): (r.bucket, r.ordinal) for r in second.collect()}
    assert len(new) == 100 and len(set(new.values())) == 100 and all(new[k] == v for k, v in old.items())
    points = [("c", "s1", f"k{i}", [1.0], None, 1) for i in range(50)] + [("c", "s2", f"k{i}", [1.0], None, 1) for i in range(10, 60)]
    assert run(spark, points, TIMES[:2], second) == {("c", "s2", f"k{i}", "removed") for i in range(10)} | {("c", "s2", f"k{i}", "added") for i in range(50, 60)}


def test_ordinals_are_stored(spark, tmp_path):
    keep = f"file://{tmp_path}/ordinals"
    points = [("c", "s1", f"k{i}", [1.0], None, 1) for i in range(50)]
    more = points + [("c", "s2", f"k{i}", [1.0], None, 1) for i in range(10, 60)]
    frame = lambda rows: spark.createDataFrame(rows, "collection_name string, snapshot_name string, id string, vector array<float>, payload string, version bigint")
    manifests = spark.createDataFrame([("c", "s1", "2024-01-01T00:00:00Z"), ("c", "s2", "2024-01-02T00:00:00Z")], "collection_name string, snapshot_name string, timestamp_utc string")
    assert sd.diff(frame(points), manifests, keep=keep).where("change <> 'removed'").count() == 0
    first, path = sd.kept_ordinals(spark, keep)
    assert path.endswith("/v2") and first.count() == 50
    assert sd.diff(frame(more), manifests, keep=keep).count() == 20
    old, new = ({r.id: (r.bucket, r.ordinal) for r in df.collect()} for df in (first, sd.kept_ordinals(spark, keep)[0]))
    assert len(new) == 60 and all(new[k] == v for k, v in old.items())
