import json

from vecloom.operators import shred as sh

SCHEMA = "request_id bigint, received_at timestamp, collection_name string, client string, body string, node int, kind string, path string"


def wrap(v):
    if v is None:
        return {"nullValue": None}
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, (int, float)):
        return {"numberValue": v}
    if isinstance(v, str):
        return {"stringValue": v}
    if isinstance(v, list):
        return {"listValue": {"values": [wrap(x) for x in v]} if v else {}}
    return {"structValue": {"fields": {k: wrap(x) for k, x in v.items()}} if v else {}}


PAYLOAD = {
    "title": "t", "tags": ["a", None], "owners": {"ref": "o1", "share": 0.5}, "shelf": {"room": 1, "bay": {"code": "B"}},
    "scans": [{"seq": 1, "regions": [None, {"kind": "k", "box": [1, 2], "readings": {"engine": "e", "fixes": [{"at": 3}, None, {"at": 4}]}}]}, None, {"seq": 2, "lamp": {"model": {"code": "x"}}, "regions": None}],
    "history": {"moves": [{"year": 1, "to": {"room": 2}}]},
}
EXPECTED = {(0, "owners", "0"), (0, "scans", "0"), (0, "scans", "2"), (0, "scans.regions", "0.1"), (0, "scans.regions.readings", "0.1.0"), (0, "scans.regions.readings.fixes", "0.1.0.0"), (0, "scans.regions.readings.fixes", "0.1.0.2"), (0, "history.moves", "0")}


def bodies():
    yield json.dumps({"points": [{"id": "p", "vector": {"elements": [1]}, "payload": {"fields": {k: wrap(v) for k, v in PAYLOAD.items()}}}]})
    yield json.dumps({"points": [{"id": "p", "payload": {"fields": PAYLOAD}}], "waitFlush": True}, indent=1)
    yield json.dumps({"vectors": [{"id": "p", "metadata": PAYLOAD}]})
    yield json.dumps({"id": "p", "metadata": PAYLOAD})


def frame(spark, texts):
    return spark.createDataFrame([(i, None, "c", None, t, 0, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_every_wrapping_gives_the_same_objects(spark):
    nodes = sh.shred(frame(spark, list(bodies())))
    got = {}
    for r in sh.list_objects(nodes).collect():
        got.setdefault(r.request_id, set()).add((r.point_pos, r.child_path, r.positions))
    assert got == {i: EXPECTED for i in range(4)}


def test_payload_as_json_text(spark):
    wrapped = {k: wrap(v) for k, v in PAYLOAD.items()}
    forms = [json.dumps(p) for p in ({"fields": PAYLOAD}, {"fields": wrapped}, PAYLOAD)]
    points = [*({"id": "p", "payload": f} for f in forms), {"payload": {"stringValue": forms[0]}}, {"metadata": forms[2]}]
    broken = [{"payload": t} for t in ("", "s", "null", "[1]", "7", forms[0] + "x", '{"owners":[{"x":NaN}]}', "[" * 5000, json.dumps(forms[0]))]
    nodes = sh.shred(frame(spark, [json.dumps({"points": points + broken})])).cache()
    assert sorted((r.point_pos, r.child_path, r.positions) for r in sh.list_objects(nodes).collect()) == sorted((i, *e[1:]) for i in range(5) for e in EXPECTED)
    table = {r.point_pos: r for r in sh.entity_table(nodes, "", ("#id", "title", "shelf.bay.code")).collect()}
    assert (table[0].id, table[0].title, table[0].shelf_bay_code) == ("p", "t", "B") and table[5].title is None


def test_entity_tables_link_to_parents(spark):
    nodes = sh.shred(frame(spark, list(bodies())[:1])).cache()
    scans = {r.positions: r for r in sh.entity_table(nodes, "scans").collect()}
    regions = sh.entity_table(nodes, "scans.regions").collect()
    assert scans["2"].lamp_model_code == "x" and scans["0"].seq == "1"
    assert [(r.kind, json.loads(r.box), r.parent_entity) for r in regions] == [("k", [1, 2], scans["0"].node)]
    points = sh.entity_table(nodes, "", ("#id", "title", "shelf.bay.code", "tags")).first()
    assert (points.id, points.title, points.shelf_bay_code, json.loads(points.tags)) == ("p", "t", "B", ["a", None])
    assert scans["0"].parent_entity == points.node


def test_dirty_bodies(spark):
    good = '{"points":[null,{"id":"a","payload":{"owners":[]}},{"id":"b","payload":{"owners":[{"ref":"x"},null,{}]}}]}'
    texts = [None, "", "null", "{", '{"points":[]}', '{"points":null}', "[1]", good + "x", '{"points":[{"payload":{"owners":[{"x":NaN}]}}]}', good, '{"points":[{"payload":null},{"payload":"s"},{"payload":{"owners":"s","scans":null}}]}', "[" * 5000]
    nodes = sh.shred(frame(spark, texts))
    assert {tuple(r) for r in sh.list_objects(nodes).collect()} == {(9, 2, "owners", "0"), (9, 2, "owners", "2")}
    assert sh.shred(frame(spark, texts).limit(0)).count() == 0


def test_retries_count_once(spark):
    body = '{"points":[{"payload":{"owners":[{"ref":"x"}]}}]}'
    rows = spark.createDataFrame([(1, "2025-01-02 00:00:00", "c", "b", body), (1, "2025-01-01 00:00:00", "c", "a", body), (1, None, "c", None, None)], "request_id bigint, received_at string, collection_name string, client string, body string")
    rows = rows.withColumn("received_at", rows.received_at.cast("timestamp"))
    assert sh.list_objects(sh.shred(rows)).count() == 1
    one = sh.first_deliveries(rows).first()
    assert one.client == "a" and one.deliveries == 3


def test_very_long_list(spark):
    body = json.dumps({"points": [{"payload": {"owners": [{"ref": str(i)} for i in range(30_000)]}}]})
    assert sh.list_objects(sh.shred(frame(spark, [body]))).count() == 30_000
