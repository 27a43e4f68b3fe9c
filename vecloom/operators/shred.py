"""Deeply nested records as related flat tables.

Method: adjacency-table shredding. Every body becomes rows ``(request_id, node,
parent, label, ordinal, kind, scalar)``; beside the parent link a node carries its
entity (the nearest list element or point above it), the field name below that
entity, and its place (``point_pos``, ``child_path``, ``positions``). Entity
tables come from joining object nodes with their scalar children and pivoting
the field names into columns.

Writers wrap differently; wrapping leaves no trace: ``fields``, ``structValue``,
``listValue.values``, the typed scalar wrappers and a payload written as JSON text
are looked through.

Defined cases. Of several deliveries of one request the earliest with a body
counts. A body that is null, empty or no whole JSON gives no nodes (its request
stays in the requests table, marked). Null elements give no object but keep their
place. A single object at one of ``list_paths`` counts as a list of one. Missing
and null fields give null columns; a field that repeats in one object keeps its
last value. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

LIST_PATHS = ("owners", "scans", "scans.regions", "scans.regions.readings", "scans.regions.readings.fixes", "history.moves")
#: Columns of the entity tables: scalar fields by their dotted name below the entity.
ENTITY_FIELDS = {
    "": ("title", "shelf.room", "shelf.bay.code", "shelf.bay.side", "tags"),
    "owners": ("ref", "share"),
    "scans": ("seq", "dpi", "lamp.model.code", "lamp.model.watt", "lamp.filters"),
    "scans.regions": ("kind", "box"),
    "scans.regions.readings": ("engine", "conf", "by.desk", "by.shift"),
    "scans.regions.readings.fixes": ("at", "was", "now"),
    "history.moves": ("year", "to.room"),
}
#: The names under which writers wrap values.
_SCALARS = ("nullValue", "numberValue", "stringValue", "boolValue", "null_value", "number_value", "string_value", "bool_value")
_STRUCTS, _LISTS = ("structValue", "struct_value"), ("listValue", "list_value")
_SCHEMA = "request_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, point_pos bigint, child_path string, positions string, entity int, field string"
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def _refuse(name: str):
    raise ValueError(name)


def _whole_json(text):
    """The value of a text that is whole JSON, else None."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return None


def unwrap(value):
    """The value inside a writer's wrapper; other values are returned as they are."""
    while isinstance(value, dict) and len(value) == 1:
        ((name, inner),) = value.items()
        if name in _SCALARS:
            return None if name in ("nullValue", "null_value") else inner
        if name in _STRUCTS:
            return inner.get("fields") or {} if isinstance(inner, dict) else {}
        if name in _LISTS:
            return inner.get("values") or [] if isinstance(inner, dict) else []
        break
    return value


def plain(value):
    """``value`` without any wrapping, at every level."""
    value = unwrap(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def points_of(body) -> list:
    """The points of a request, in order, whichever way its writer put them."""
    if isinstance(body, dict):
        for name in ("points", "vectors"):
            if name in body:
                body = body[name]
                break
    body = unwrap(body)
    return body if isinstance(body, list) else [body]


def payload_of(point: dict):
    payload = point.get("payload")
    payload = point.get("metadata") if payload is None else payload
    payload = unwrap(payload)
    if isinstance(payload, str):
        payload = unwrap(_whole_json(payload))
    if isinstance(payload, dict) and len(payload) == 1 and isinstance(payload.get("fields"), dict):
        payload = payload["fields"]
    return payload


def shred_body(request_id, body: str | None, list_paths: frozenset[str]) -> Iterator[tuple]:
    """Node rows of one body, in the order of ``_NAMES``."""
    try:
        parsed = json.loads(body, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return
    count = 1
    yield (request_id, 0, None, None, None, "request", None, None, None, None, 0, None)
    for at, point in enumerate(points_of(parsed)):
        if not isinstance(point, dict):
            continue
        top = count
        count += 1
        yield (request_id, top, 0, "points", at, "object", None, at, "", "", top, None)
        for name in ("id", "version"):
            value = unwrap(point.get(name))
            if value is not None and not isinstance(value, (dict, list)):
                yield (request_id, count, top, name, None, "scalar", value if isinstance(value, str) else json.dumps(value), at, "", "", top, "#" + name)
                count += 1
        payload = payload_of(point)
        if not isinstance(payload, dict):
            continue
        # entries: value, parent, label, ordinal, path, positions, entity, field
        stack = [(v, top, k, None, k, "", top, k) for k, v in reversed(payload.items())]
        while stack:
            value, parent, label, ordinal, path, positions, entity, field = stack.pop()
            value = unwrap(value)
            node = count
            count += 1
            if isinstance(value, dict) and ordinal is None and path in list_paths:
                value = [value]
            if isinstance(value, dict):
                here = ordinal is not None
                yield (request_id, node, parent, label, ordinal, "object", None, at, path, positions, node if here else entity, None if here else field)
                stack += [(v, node, k, None, f"{path}.{k}", positions, node if here else entity, k if here else f"{field}.{k}") for k, v in reversed(value.items())]
            elif isinstance(value, list):
                items = [unwrap(v) for v in value]
                nested = any(isinstance(v, (dict, list)) for v in items)
                text = None if nested else json.dumps(items, ensure_ascii=False, separators=(",", ":"))
                yield (request_id, node, parent, label, ordinal, "list", text, at, path, positions, entity, field)
                if nested:
                    stack += [(v, node, label, i, path, f"{positions}.{i}" if positions else str(i), entity, field) for i, v in reversed(list(enumerate(items)))]
            else:
                text = None if value is None else value if isinstance(value, str) else json.dumps(value)
                yield (request_id, node, parent, label, ordinal, "null" if value is None else "scalar", text, at, path, positions, entity, field)


def first_deliveries(requests: DataFrame) -> DataFrame:
    """One row a request: its earliest delivery with a body, combined before the shuffle."""
    when = F.struct(F.col("body").isNull().alias("none"), F.col("received_at").isNull().alias("undated"), "received_at")
    return requests.groupBy("request_id").agg(F.min_by(F.struct("received_at", "collection_name", "client", "body"), when).alias("r"), F.count("*").alias("deliveries")).select("request_id", "r.*", "deliveries")


def shred(requests: DataFrame, list_paths: tuple[str, ...] = LIST_PATHS) -> DataFrame:
    """The adjacency table of all request bodies; each request once."""
    paths = frozenset(list_paths)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(_NAMES, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for request_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(shred_body(request_id, body, paths))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    bodies = first_deliveries(requests).where("body is not null").select("request_id", "body")
    return spread(bodies).mapInArrow(run, _SCHEMA)


def list_objects(nodes: DataFrame) -> DataFrame:
    """Objects that are list elements: ``(request_id, point_pos, child_path, positions)``."""
    return nodes.where("kind = 'object' and ordinal is not null and child_path <> ''").select("request_id", "point_pos", "child_path", "positions")


def entity_table(nodes: DataFrame, child_path: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One flat table: the objects at ``child_path`` with their scalar fields as columns.

    ``(request_id, node, parent_entity, point_pos, positions, <fields>)``; dots in field
    names become ``_``. ``parent_entity`` is the ``node`` of the row it belongs to.
    """
    fields = ENTITY_FIELDS[child_path] if fields is None else fields
    objects = nodes.where((F.col("kind") == "object") & F.col("ordinal").isNotNull() & (F.col("child_path") == child_path))
    objects = objects.select("request_id", "node", "parent", "point_pos", "positions")
    lists = nodes.where("kind = 'list'").select("request_id", F.col("node").alias("parent"), F.col("entity").alias("parent_entity"))
    objects = objects.join(lists, ["request_id", "parent"], "left")
    children = nodes.where(F.col("field").isin(*fields) & F.col("scalar").isNotNull()).select("request_id", F.col("entity").alias("node"), "field", "scalar")
    wide = children.groupBy("request_id", "node").agg(*(F.max(F.when(F.col("field") == f, F.col("scalar"))).alias(f.lstrip("#").replace(".", "_")) for f in fields))
    return objects.join(wide, ["request_id", "node"], "left").drop("parent")
