"""Payload JSON: canonical text, filters, fields."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A JSON string, or a number, or a word, or anything else of one character.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*|[A-Za-z]+|[^"0-9A-Za-z]'


def canonical_json(payload: Column) -> Column:
    """One text for every spelling of a JSON value, inside the JVM.

    Object keys are sorted at every level, white space and escapes are gone, and a
    number has one spelling whatever its zeros or exponent (``1``, ``1.0``, ``1e0``);
    numbers of more than 38 digits compare as doubles. Null stays null; text that
    is no JSON, or repeats a key in one object, is returned as it is.
    """
    plain = F.when(
        payload.rlike(r"[0-9][eE]"),
        F.array_join(F.transform(F.regexp_extract_all(payload, F.lit(f"({_TOKEN})"), F.lit(1)), _plain_number), ""),
    ).otherwise(payload)
    return F.coalesce(F.to_json(F.try_parse_json(plain)), payload)


def _plain_number(token: Column) -> Column:
    exact = token.try_cast("decimal(38,18)").cast("string")
    return F.when(token.rlike(r"^-?[0-9].*[eE]"), F.coalesce(exact, token.try_cast("double").cast("string"), token)).otherwise(token)


def literal_json(value: Any) -> str:
    """Canonical text of a Python value, as :func:`canonical_json` would print it."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("payload numbers must be finite")
        return str(int(value)) if float(value).is_integer() and abs(value) < 1e18 else repr(float(value))
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{literal_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(literal_json, value)) + "]"
    return json.dumps(str(value), ensure_ascii=False)


def field(payload: Column, name: str) -> Column:
    """A top-level field as canonical JSON text: null if missing, ``'null'`` if present and null."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), f"$['{quoted}']", "variant"))


def matches(payload: Column, must_match: dict[str, Any] | None) -> Column | None:
    """AND of equalities on top-level fields; ``None`` where there is nothing to test.

    A row without payload, or without one of the keys, does not match; ``{"k": None}``
    matches a key that is present and null; ``1`` equals ``1.0``.
    """
    if must_match is not None and not isinstance(must_match, dict):
        raise ValueError("a filter must be an object")
    test = None
    for name, value in (must_match or {}).items():
        one = F.coalesce(field(payload, name) == F.lit(literal_json(value)), F.lit(False))
        test = one if test is None else test & one
    return test


def field_names(points: DataFrame, payload: str = "payload") -> DataFrame:
    """Sorted distinct top-level field names of the payloads: ``(field)``."""
    return points.select(F.explode(F.json_object_keys(payload)).alias("field")).distinct().orderBy("field")


def build_filter(pairs: list[tuple[str, Any]]) -> dict[str, Any] | None:
    """A filter from ``(field, value)`` rows of a form: names trimmed, blank ones dropped, types kept."""
    kept = {name.strip(): value for name, value in pairs if name and name.strip()}
    return kept or None


def parse_filter(text: str | None) -> dict[str, Any] | None:
    """A filter from JSON text, which must be an object; blank text and ``{}`` are no filter."""
    if text is None or not text.strip():
        return None
    try:
        value = json.loads(text)
    except ValueError as wrong:
        raise ValueError("a filter must be JSON") from wrong
    if not isinstance(value, dict):
        raise ValueError("a filter must be an object")
    return value or None
