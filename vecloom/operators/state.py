"""Current state as a fold of the mutation log, point lookups, deletes and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def fold_latest(log: DataFrame, order: str = "lsn", id: str = "id") -> DataFrame:
    """The last record of every id, without ids whose last record is a delete."""
    last = log.groupBy(id).agg(F.max_by(F.struct(*[c for c in log.columns if c != id]), order).alias("r"))
    return last.select(id, "r.*").where("op <> 'delete'")


def version_fold(log: DataFrame, order: str = "lsn", id: str = "id", payload: str = "payload") -> DataFrame:
    """Living ids with version and payload after replaying ``log`` in order.

    A life begins with the first upsert after a delete. Its first upsert gives
    version 1 if it carries a payload and no version if not; every later upsert adds
    one (none counts as 0). A later upsert without payload clears the payload.
    Grouped aggregates only: the newest delete of each id, then counts behind it.
    """
    dead = log.groupBy(id).agg(F.max(F.when(F.col("op") == "delete", F.col(order))).alias("dead"))
    alive = log.where("op <> 'delete'").join(dead, id).where(F.col("dead").isNull() | (F.col(order) > F.col("dead")))
    folded = alive.groupBy(id).agg(F.count("*").alias("n"), F.min_by(F.col(payload).isNotNull(), order).alias("first"), F.max(order).alias(order), F.max_by(F.struct(*[c for c in log.columns if c not in (id, order, "op")]), order).alias("r"))
    version = F.nullif(F.col("n") - F.when(F.col("first"), 0).otherwise(1), F.lit(0))
    return folded.select(id, order, version.alias("version"), "r.*")


def keep_payload_fold(log: DataFrame, order: str = "lsn", id: str = "id", payload: str = "payload") -> DataFrame:
    """The unversioned writer's rule: an upsert without payload keeps the payload before it, even across deletes of the vector only."""
    kept = log.groupBy(id).agg(F.max_by(payload, F.when(F.col(payload).isNotNull() | (F.col("op") == "delete"), F.col(order))).alias("kept"))
    return fold_latest(log, order, id).drop(payload).join(kept.withColumnRenamed("kept", payload), id)


def tombstones(log: DataFrame, order: str = "lsn", id: str = "id") -> DataFrame:
    """Ids that have been seen and whose last record is a delete."""
    return log.groupBy(id).agg(F.max_by("op", order).alias("op"), F.max(order).alias(order)).where("op = 'delete'").select(id, order)


def delete_status(log: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``(point_id, status_code, error_message)`` of a delete: ids seen before are OK, also if already deleted."""
    seen = log.where(F.col(id).isNotNull()).select(F.col(id).alias("point_id")).distinct().withColumn("seen", F.lit(True))
    asked = ids.select(F.col(id).alias("point_id"))
    joined = asked.join(seen, "point_id", "left")
    empty = F.coalesce(F.col("point_id").cast("string"), F.lit("")) == ""
    code = F.when(empty, "INVALID_ARGUMENT").when(F.col("seen"), "OK").otherwise("NOT_FOUND")
    message = F.when(empty, "Point ID cannot be empty").when(F.col("seen").isNull(), "Point not found")
    return joined.select("point_id", code.alias("status_code"), message.alias("error_message"))


def get_points(points: DataFrame, ids: DataFrame, id: str = "id", order: str = "pos") -> DataFrame:
    """Points in the order asked for, repeats repeated, missing and empty ids left out."""
    asked = ids.where(F.coalesce(F.col(id).cast("string"), F.lit("")) != "")
    return asked.join(points, id).orderBy(order)


def missing_ids(points: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return ids.select(id).distinct().join(points.select(id), id, "left_anti")


def validate_points(rows: DataFrame, dim: int, order: str = "pos") -> DataFrame:
    """``(pos, point_id, status_code, error_message)`` of every row; message null where it is fine.

    The id is checked first, then that a vector is there, then its length, then
    that the payload is JSON (which excludes NaN and infinities).
    """
    size = F.size("vector")
    message = (
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("Point ID cannot be empty"))
        .when(F.col("vector").isNull(), F.concat(F.lit("Vector is missing for point ID '"), "id", F.lit("'")))
        .when(size != dim, F.concat(F.lit("Dimension mismatch for point ID '"), "id", F.lit(f"': expected {dim}, got "), size.cast("string")))
    )
    payload = F.when(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull(), F.concat(F.lit("Invalid payload for point ID '"), "id", F.lit("'")))
    checked = rows.withColumn("batch_error", message).withColumn("error_message", F.coalesce("batch_error", payload))
    return checked.select(order, F.col("id").alias("point_id"), F.when(F.col("error_message").isNull(), "OK").otherwise("INVALID_ARGUMENT").alias("status_code"), "error_message", F.col("batch_error").isNotNull().alias("rejects_batch"))


def batch_result(status: DataFrame, order: str = "pos") -> DataFrame:
    """One row: whether the batch is refused as a whole, the counts and the first error."""
    return status.agg(
        (F.count_if("rejects_batch") > 0).alias("rejected"),
        F.count_if(F.col("error_message").isNull()).alias("succeeded"),
        F.count_if(F.col("error_message").isNotNull()).alias("failed"),
        F.min_by("error_message", F.when(F.col("error_message").isNotNull(), F.col(order))).alias("overall_error"),
    )


def sequence_rows(rows: DataFrame, base: int, order: list[str]) -> DataFrame:
    """``lsn = base + row``: dense numbers in the order given, ranges numbered in parallel."""
    return numbered_rows(rows, base, order)[0]


def numbered_rows(rows: DataFrame, base: int, order: list[str]) -> tuple[DataFrame, int, DataFrame]:
    """:func:`sequence_rows`, the number of rows, and the written table they are read from.

    Rows are range-partitioned and written once, so that counts and numbers see the
    same ranges; only one count a range reaches the driver, and no task sees all rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "sequenced")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    start, starts = base, []
    for part in sorted(counts):
        starts.append((part, start))
        start += counts[part]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, base)], "__part int, __base bigint"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = placed.withColumn("__row", place).join(offsets, "__part").withColumn("lsn", F.col("__base") + F.col("__row")).drop("__part", "__row", "__base")
    return numbered, start - base, placed
