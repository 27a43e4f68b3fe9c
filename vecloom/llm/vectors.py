"""Shared ground of the vector operators: valid points and classes of copies.

A point counts once, with its row of highest version (null is lowest; among equals
the greatest vector). Points whose vector is not ``dim`` finite numbers, or is all
zero, do not take part. Points of one collection with the same vector are one
*class*; a class is compared once, however many members it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import vectors
from ..runtime import materialize

DIM = 64
#: Rows of the sample that rotations and pivots are learned from (an index is fitted
#: on it; every row is indexed). The rows of smallest hash, so a fixed random subset.
SAMPLE_ROWS = 8192
#: Names of points with several rows that are sent to all tasks, in bytes; more are joined by a shuffle.
NAMES_BYTES = 32 << 20


def valid_points(points: DataFrame, dim: int = DIM) -> DataFrame:
    """``(collection_name, id, vector)``, one row a point that takes part.

    Rows are counted by name first, which moves no vectors; only those of points with
    several rows are grouped. Their names are measured and, if few, sent to all tasks.
    """
    rows = points.where("collection_name is not null and id is not null").select("collection_name", "id", "version", "vector")
    name = ["collection_name", "id"]
    several = materialize(rows.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").select(*name), "repeated-names")
    measured = several.agg(F.coalesce(F.sum(F.octet_length("collection_name") + F.octet_length("id") + 64), F.lit(0))).first()[0]
    several = F.broadcast(several) if measured <= NAMES_BYTES else several
    top = F.max(F.struct(F.coalesce("version", F.lit(-(1 << 62))).alias("v"), F.col("vector"))).alias("top")
    many = rows.join(several, name, "left_semi").groupBy(*name).agg(top).select(*name, "top.vector")
    one = rows.join(several, name, "left_anti").select(*name, "vector").unionByName(many)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return one.where((F.size("vector") == dim) & finite & F.exists("vector", lambda x: x != 0))


class Classes:
    """``reps``: ``(pid, collection_name, vector, weight)``; ``members``: ``(pid, collection_name, id)``.

    Equal vectors are found by two independent hashes of 64 bits, so that grouping moves
    and sorts no vectors; the class carries the row number of one of its members.
    """

    def __init__(self, points: DataFrame, dim: int = DIM):
        hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.col("vector")).alias("h2")]
        rows = valid_points(points, dim).select(F.monotonically_increasing_id().alias("row"), "collection_name", "id", "vector", *hashes)
        rows = materialize(rows, "vector-points")
        same = ["collection_name", "h1", "h2"]
        many = rows.groupBy(*same).agg(F.min("row").alias("pid"), F.count("*").alias("weight")).where("weight > 1")
        joined = rows.join(materialize(many, "vector-copies"), same, "left")
        pid = F.coalesce("pid", "row")
        self.reps = joined.where(F.col("row") == pid).select(pid.alias("pid"), "collection_name", "vector", F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"))
        self.members = joined.select(pid.alias("pid"), "collection_name", "id")

    def first_members(self, count: int) -> DataFrame:
        """``(pid, id)`` of the ``count`` smallest ids of each class; the limit applies before the shuffle."""
        place = F.row_number().over(Window.partitionBy("pid").orderBy("id"))
        return self.members.select("pid", "id").withColumn("place", place).where(F.col("place") <= count).drop("place")

    def sample(self, rows: int = SAMPLE_ROWS, away=None) -> np.ndarray:
        """Unit vectors of at most ``rows`` classes, the same rows for the same table.

        ``away`` is a map over ``(place, vector)`` that leaves the classes to sample from.
        """
        placed = self.reps.select(F.xxhash64("collection_name", "vector").alias("place"), "vector")
        if away is not None:
            placed = placed.mapInArrow(away, "place bigint, vector array<float>")
        picked = placed.orderBy("place").limit(rows).select("vector").toArrow()
        return unit(vectors(picked.column(0).combine_chunks())) if picked.num_rows else np.zeros((0, DIM))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 as doubles; scaled first, so tiny and huge numbers keep their direction."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
