"""Registered queries of the change-feed, nested-record and snapshot problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shred as sh
from ..operators import snapshot_diff as sd
from ..runtime import materialize, table
from ..streaming.changefeed import ChangeFeed, apply_batch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that exist after all changes, by the streaming operator."""
    feed = ChangeFeed(spark, f"{sf_dir.rstrip('/')}/wal_records.parquet").run_available()
    return feed.current().select("collection_name", "id", "lsn", "version")


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt tables with the payload of the last change, by the bounded fold."""
    state = apply_batch(table(spark, sf_dir, "wal_records"))
    return state.select("collection_name", "id", "lsn", "version", F.size(F.coalesce("vector", F.array().cast("array<float>"))).cast("bigint").alias("dim"), "metadata")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(sh.shred(table(spark, sf_dir, "upsert_requests")), "nodes")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an element of a list in a payload."""
    return sh.list_objects(sh.shred(table(spark, sf_dir, "upsert_requests")))


def p4_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests table: one row a request, with its number of deliveries."""
    return sh.first_deliveries(table(spark, sf_dir, "upsert_requests")).select("request_id", "received_at", "collection_name", "client", F.col("deliveries").cast("bigint").alias("deliveries"))


def p4_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points table, linked to requests by ``request_id``."""
    return sh.entity_table(_nodes(spark, sf_dir), "", ("#id", "#version", *sh.ENTITY_FIELDS[""])).drop("node", "parent_entity", "positions")


def _entity(child_path: str, doc: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sh.entity_table(_nodes(spark, sf_dir), child_path)
        # the places in the lists name an object and its parent in every run
        return rows.withColumn("parent_positions", F.regexp_replace("positions", r"\.?\d+$", "")).drop("node", "parent_entity")

    query.__doc__ = doc
    return query


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between consecutive snapshots, by bitmaps over persistent ordinals."""
    return sd.diff(table(spark, sf_dir, "snapshot_points"), table(spark, sf_dir, "snapshot_manifests"))


def p5_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each collection in order of time."""
    return sd.snapshot_order(table(spark, sf_dir, "snapshot_manifests")).select("collection_name", "snapshot_name", "taken_at", F.col("place").cast("bigint").alias("place"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p4_found, p4_requests, p4_points, p5_found, p5_order)} | {
    "p4_" + path.rsplit(".", 1)[-1]: _entity(path, f"Flat table of the objects at {path}.") for path in sh.LIST_PATHS
}

_LOG_SQL = """
    WITH log AS (
        SELECT collection_name, id, coalesce(lsn, start_lsn + entry_no) AS seq, lower(regexp_replace(op, '[^A-Za-z]', '', 'g')) IN ('deletevector', 'delete', 'd') AS del, vector, metadata, arrived_at
        FROM wal_records WHERE id IS NOT NULL AND lower(regexp_replace(op, '[^A-Za-z]', '', 'g')) IN ('addvector', 'insert', 'i', 'update', 'u', 'upsert', 'deletevector', 'delete', 'd')
    ), once AS (
        SELECT * FROM log WHERE seq IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY collection_name, id, seq ORDER BY metadata IS NOT NULL DESC, arrived_at DESC) = 1
    ), dead AS (SELECT *, max(CASE WHEN del THEN seq END) OVER (PARTITION BY collection_name, id) AS tomb FROM once)"""

_SNAPSHOT_SQL = """
    WITH RECURSIVE snaps AS (
        SELECT collection_name, snapshot_name, min(CAST(timestamp_utc AS TIMESTAMPTZ)) AS t FROM snapshot_manifests
        WHERE timestamp_utc IS NOT NULL AND snapshot_name IS NOT NULL GROUP BY ALL
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY collection_name ORDER BY t, snapshot_name) - 1 AS place FROM snaps)"""

_PAYLOADS_SQL = """bodies AS (
            SELECT request_id, CAST(any_value(body) AS JSON) AS b FROM upsert_requests WHERE body IS NOT NULL AND json_valid(body) GROUP BY request_id
        ), lists AS (
            SELECT request_id, CASE WHEN json_type(b) = 'ARRAY' THEN b WHEN json_exists(b, '$.points') THEN b->'points'
                   WHEN json_exists(b, '$.vectors') THEN b->'vectors' ELSE json_array(b) END AS l FROM bodies
        ), points AS (
            SELECT request_id, CAST(e.key AS BIGINT) AS point_pos, e.value AS p
            FROM lists, json_each(CASE WHEN json_type(l) = 'ARRAY' THEN l ELSE json_array(l) END) e WHERE json_type(e.value) = 'OBJECT'
        ), payloads AS (
            SELECT request_id, point_pos, CASE WHEN json_type(v) <> 'VARCHAR' THEN v WHEN json_valid(v->>'$') THEN CAST(v->>'$' AS JSON) END AS v
            FROM (SELECT request_id, point_pos, CASE WHEN coalesce(json_type(p->'payload'), 'NULL') <> 'NULL' THEN p->'payload' ELSE p->'metadata' END AS v FROM points)"""


#: Entity tables by another way than the operator's: all nodes of a payload with their full names, wrapping taken out of the names.
_NODES_SQL = f"""
        WITH {_PAYLOADS_SQL}
        ), roots AS (
            SELECT request_id, point_pos, CASE WHEN json_keys(v) = ['fields'] AND json_type(v->'fields') = 'OBJECT' THEN v->'fields' ELSE v END AS v FROM payloads WHERE json_type(v) = 'OBJECT'
        ), tree AS (
            SELECT request_id, point_pos, t.type, t.value, t.atom, t.fullkey, regexp_replace(t.fullkey, '\\.(structValue(\\.fields)?|listValue(\\.values)?|stringValue|numberValue|boolValue|nullValue)', '', 'g') AS k
            FROM roots, json_tree(roots.v) t
        ), nodes AS (
            SELECT * EXCLUDE (k), regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '^(\\$\\.(owners|scans|history\\.moves))(\\.|$)', '\\1[0]\\3'),
                '^(\\$\\.scans\\[\\d+\\]\\.regions)(\\.|$)', '\\1[0]\\2'), '^(\\$\\.scans\\[\\d+\\]\\.regions\\[\\d+\\]\\.readings)(\\.|$)', '\\1[0]\\2'),
                '^(\\$\\.scans\\[\\d+\\]\\.regions\\[\\d+\\]\\.readings\\[\\d+\\]\\.fixes)(\\.|$)', '\\1[0]\\2'), '^\\$$', '$') AS k,
                CASE WHEN type = 'NULL' OR fullkey LIKE '%.nullValue' THEN 'null' WHEN type = 'VARCHAR' THEN atom->>'$' ELSE CAST(atom AS VARCHAR) END AS text,
                CASE WHEN type = 'NULL' OR fullkey LIKE '%.nullValue' THEN 'null' ELSE CAST(atom AS VARCHAR) END AS item,
                type = 'OBJECT' AND fullkey NOT LIKE '%.listValue' AND NOT coalesce(json_keys(value) IN (['listValue'], ['nullValue'], ['numberValue'], ['stringValue'], ['boolValue']), FALSE) AS is_object
            FROM tree
        ), leaves AS (
            SELECT request_id, point_pos, k, text, item, type = 'ARRAY' AND json_array_length(value) = 0 AS bare, fullkey LIKE '%.nullValue' OR type = 'NULL' AS nothing FROM nodes WHERE type NOT IN ('OBJECT', 'ARRAY') OR type = 'ARRAY' AND json_array_length(value) = 0
        )"""


def _fields_sql(pattern: str, fields: tuple[str, ...]) -> str:
    """Grouped fields below the objects whose name matches ``pattern``."""
    columns = ", ".join(
        f"""coalesce(max(text) FILTER (WHERE rest = '{f}' AND NOT nothing AND NOT bare), '[' || string_agg(item, ',' ORDER BY nth) FILTER (WHERE stem = '{f}' AND nth IS NOT NULL) || ']',
            max('[]') FILTER (WHERE rest = '{f}' AND bare)) AS "{f.replace('.', '_')}" """
        for f in fields
    )
    return f"""
        SELECT request_id, point_pos, k, {columns} FROM (
            SELECT *, regexp_replace(rest, '\\[\\d+\\]$', '') AS stem, TRY_CAST(regexp_extract(rest, '\\[(\\d+)\\]$', 1) AS INT) AS nth
            FROM (SELECT * EXCLUDE (k), regexp_extract(k, '^({pattern})\\.(.*)$', 1) AS k, regexp_extract(k, '^({pattern})\\.(.*)$', 2) AS rest FROM leaves WHERE regexp_matches(k, '^{pattern}\\.'))
        ) GROUP BY request_id, point_pos, k"""


def _entity_sql(path: str) -> str:
    *above, last = path.split(".")
    pattern = {"owners": "\\$\\.owners\\[\\d+\\]", "history.moves": "\\$\\.history\\.moves\\[\\d+\\]"}.get(path) or "\\$" + "".join(f"\\.{name}\\[\\d+\\]" for name in path.split("."))
    names = ", ".join(f'"{f.replace(".", "_")}"' for f in sh.ENTITY_FIELDS[path])
    places = "array_to_string(regexp_extract_all(k, '\\[(\\d+)\\]', 1), '.')"
    return f"""{_NODES_SQL}, objects AS (SELECT DISTINCT request_id, point_pos, k FROM nodes WHERE is_object AND regexp_full_match(k, '{pattern}')),
        fields AS ({_fields_sql(pattern, sh.ENTITY_FIELDS[path])})
        SELECT request_id, point_pos, {places} AS positions, regexp_replace({places}, '\\.?\\d+$', '') AS parent_positions, {names}
        FROM objects LEFT JOIN fields USING (request_id, point_pos, k)"""


_POINTS_SQL = f"""{_NODES_SQL}, fields AS ({_fields_sql("\\$", sh.ENTITY_FIELDS[""])})
        SELECT request_id, point_pos, CASE WHEN json_type(p->'id') IN ('OBJECT', 'ARRAY') THEN NULL ELSE p->>'id' END AS id, CASE WHEN json_type(p->'version') IN ('OBJECT', 'ARRAY') THEN NULL ELSE p->>'version' END AS version,
        {", ".join(f'"{f.replace(".", "_")}"' for f in sh.ENTITY_FIELDS[""])}
        FROM points LEFT JOIN fields USING (request_id, point_pos)"""

SQL = {
    "p1_found": _LOG_SQL
    + " SELECT collection_name, id, max(seq) AS lsn, count(*) AS version FROM dead WHERE NOT del AND (tomb IS NULL OR seq > tomb) GROUP BY ALL",
    "p1_state": _LOG_SQL
    + """ SELECT collection_name, id, max(seq) AS lsn, count(*) AS version, coalesce(arg_max(CAST(coalesce(len(vector), 0) AS BIGINT), seq), 0) AS dim,
          nullif(arg_max(coalesce(metadata, chr(0)), seq), chr(0)) AS metadata
          FROM dead WHERE NOT del AND (tomb IS NULL OR seq > tomb) GROUP BY collection_name, id""",
    "p4_requests": """
        SELECT request_id, received_at, collection_name, client, n AS deliveries
        FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n,
              row_number() OVER (PARTITION BY request_id ORDER BY body IS NULL, received_at IS NULL, received_at) AS k FROM upsert_requests) WHERE k = 1""",
    "p4_found": f"""
        WITH RECURSIVE {_PAYLOADS_SQL}
        ), walk AS (
            SELECT request_id, point_pos, CASE WHEN json_keys(v) = ['fields'] AND json_type(v->'fields') = 'OBJECT' THEN v->'fields' ELSE v END AS v,
                   '' AS path, '' AS positions, FALSE AS element, FALSE AS listed
            FROM payloads WHERE json_type(v) = 'OBJECT'
            UNION ALL
            SELECT request_id, point_pos,
                   CASE WHEN json_exists(x, '$.structValue') THEN coalesce(x->'structValue'->'fields', '{{}}'::JSON)
                        WHEN json_exists(x, '$.listValue') THEN coalesce(x->'listValue'->'values', '[]'::JSON) ELSE x END AS v,
                   path, positions, element, listed
            FROM (
                SELECT w.request_id, w.point_pos, e.value AS x,
                       CASE WHEN json_type(w.v) = 'ARRAY' THEN w.path WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END AS path,
                       CASE WHEN json_type(w.v) = 'OBJECT' THEN CASE WHEN listed AND NOT element THEN CASE WHEN positions = '' THEN '0' ELSE positions || '.0' END ELSE positions END
                            WHEN positions = '' THEN e.key ELSE positions || '.' || e.key END AS positions,
                       json_type(w.v) = 'ARRAY' AS element,
                       (CASE WHEN json_type(w.v) = 'ARRAY' THEN w.path WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END)
                           IN ('owners', 'scans', 'scans.regions', 'scans.regions.readings', 'scans.regions.readings.fixes', 'history.moves') AS listed
                FROM walk w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')
            )
            WHERE json_type(x) IN ('OBJECT', 'ARRAY')
        )
        SELECT request_id, point_pos, path AS child_path, CASE WHEN element THEN positions WHEN positions = '' THEN '0' ELSE positions || '.0' END AS positions
        FROM walk WHERE json_type(v) = 'OBJECT' AND path <> '' AND (element OR listed)
          AND NOT (json_keys(v) IN (['nullValue'], ['numberValue'], ['stringValue'], ['boolValue']))""",
    "p5_order": _SNAPSHOT_SQL + " SELECT collection_name, snapshot_name, CAST(t AT TIME ZONE 'UTC' AS TIMESTAMP) AS taken_at, place FROM placed",
    "p5_found": _SNAPSHOT_SQL
    + """, best AS (
            SELECT collection_name, snapshot_name, id, vector, payload FROM snapshot_points
            QUALIFY row_number() OVER (PARTITION BY collection_name, snapshot_name, id ORDER BY version DESC NULLS LAST) = 1
        ), rows AS (
            SELECT place, b.*, CASE WHEN payload IS NULL THEN NULL ELSE (
                SELECT list_sort(list(fullkey || ' ' || CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || CAST(CAST(atom AS DOUBLE) AS VARCHAR) ELSE type || coalesce(json_extract_string(atom, '$'), '') END))
                FROM json_tree(b.payload)) END AS leaves
            FROM best b JOIN placed USING (collection_name, snapshot_name)
        ), pairs AS (SELECT collection_name, snapshot_name, place FROM placed WHERE place > 0)
        SELECT p.collection_name, p.snapshot_name, n.id, 'added' AS change FROM pairs p JOIN rows n ON n.collection_name = p.collection_name AND n.place = p.place
            WHERE NOT EXISTS (SELECT 1 FROM rows o WHERE o.collection_name = p.collection_name AND o.place = p.place - 1 AND o.id = n.id)
        UNION ALL
        SELECT p.collection_name, p.snapshot_name, o.id, 'removed' FROM pairs p JOIN rows o ON o.collection_name = p.collection_name AND o.place = p.place - 1
            WHERE NOT EXISTS (SELECT 1 FROM rows n WHERE n.collection_name = p.collection_name AND n.place = p.place AND n.id = o.id)
        UNION ALL
        SELECT p.collection_name, p.snapshot_name, n.id, 'changed' FROM pairs p
            JOIN rows n ON n.collection_name = p.collection_name AND n.place = p.place
            JOIN rows o ON o.collection_name = p.collection_name AND o.place = p.place - 1 AND o.id = n.id
            WHERE n.vector IS DISTINCT FROM o.vector OR n.leaves IS DISTINCT FROM o.leaves""",
}

SQL |= {"p4_points": _POINTS_SQL} | {"p4_" + path.rsplit(".", 1)[-1]: _entity_sql(path) for path in sh.LIST_PATHS}
