import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions.distance import Metric, best_first, cosine, dot, l2, norm
from vecloom.functions.payload import build_filter, canonical_json, field, field_names, literal_json, matches, parse_filter


def test_distances(spark):
    cases = [([1, 2, 3], 1.0, 0.0), ([-1, -2, -3], -1.0, math.sqrt(56)), ([2, 4, 6], 1.0, math.sqrt(14)), ([0, 0, 0], 0.0, math.sqrt(14)), ([4, 6, 8], None, math.sqrt(50))]
    rows = spark.createDataFrame([([float(x) for x in v],) for v, _, _ in cases], "v array<float>")
    q = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    out = rows.select(cosine(q, F.col("v")), l2(q, F.col("v")), dot(q, F.col("v")), norm(F.col("v"))).collect()
    for row, (v, c, e) in zip(out, cases):
        if c is not None:
            assert row[0] == pytest.approx(c, abs=1e-6)
        assert row[1] == pytest.approx(e, abs=1e-6)
        assert row[2] == pytest.approx(sum(x * y for x, y in zip((1, 2, 3), v)))
        assert row[3] == pytest.approx(math.sqrt(sum(x * x for x in v)))
        assert -1 <= row[0] <= 1


def test_lengths_that_differ_and_nulls_give_null(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert rows.select(dot(F.col("a"), F.col("b")), l2(F.col("a"), F.col("b"))).collect() == [(None, None), (None, None)]


def test_nan_scores_come_last(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None), (4, 0.9)], "id int, score double")
    assert [r.id for r in rows.orderBy(*best_first("COSINE"), "id").collect()] == [4, 2, 1, 3]
    with pytest.raises(ValueError):
        Metric.of("DOT")


def test_canonical_json(spark):
    same = ['{"b": 2.50, "a": [1.0, {"y": null, "x": "\\u00e9"}]}', '{ "a":[1e0,{"x":"é","y":null}],"b":25e-1}', '{"a":[1,{"x":"é","y":null}],"b":2.5}']
    rows = spark.createDataFrame([(t,) for t in same] + [(None,), ("",), ("{",), ('{"t":"1e5 1.0"}',), ('{"n":1e2}',), ('{"n":100}',)], "p string")
    out = [r[0] for r in rows.select(canonical_json(F.col("p"))).collect()]
    assert out[0] == out[1] == out[2]
    assert out[3] is None and out[4] == "" and out[5] == "{"
    assert out[6] == '{"t":"1e5 1.0"}' and out[7] == out[8]


_json = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.text(min_size=1, max_size=3), _json, max_size=4), min_size=30, max_size=30))
def test_canonical_json_ignores_spelling(spark, values):
    rows = spark.createDataFrame([(json.dumps(v), json.dumps(dict(reversed(v.items())), ensure_ascii=False, indent=1)) for v in values], "a string, b string")
    assert all(r[0] == r[1] for r in rows.select(canonical_json(F.col("a")), canonical_json(F.col("b"))).collect())


def test_filters(spark):
    rows = spark.createDataFrame([(1, '{"tag":"A","count":10,"active":true}'), (2, '{"tag":"A","count":10.0,"active":false,"x":null}'), (3, None), (4, '{"a.b":1}'), (5, "[1]")], "id int, payload string")
    ids = lambda f: [r.id for r in rows.where(matches(F.col("payload"), f)).collect()]
    assert ids({"tag": "A", "count": 10}) == [1, 2]
    assert ids({"active": True}) == [1]
    assert ids({"x": None}) == [2]
    assert ids({"count": "10"}) == []
    assert ids({"a.b": 1}) == [4]
    assert matches(F.col("payload"), {}) is None and matches(F.col("payload"), None) is None
    with pytest.raises(ValueError):
        matches(F.col("payload"), [1])
    assert [r[0] for r in field_names(rows.where("id <> 5")).collect()] == ["a.b", "active", "count", "tag", "x"]
    assert rows.select(field(F.col("payload"), "x")).collect()[1][0] == "null"
    assert literal_json({"b": 1.0, "a": [None, True, "é"]}) == '{"a":[null,true,"é"],"b":1}'


def test_filter_forms():
    assert build_filter([(" a ", 1), ("", 2), ("b", "x")]) == {"a": 1, "b": "x"} and build_filter([]) is None
    assert parse_filter(' {"a": 1}') == {"a": 1} and parse_filter(" ") is None and parse_filter("{}") is None
    for wrong in ("[1]", "{", "1"):
        with pytest.raises(ValueError):
            parse_filter(wrong)
