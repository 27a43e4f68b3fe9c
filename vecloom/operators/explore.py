"""Exploration of a sample: projection to the plane, colours, marker styles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_table, materialize
from .state import sequence_rows

#: Colours of the palette, and how many distinct numbers make a scale.
PALETTE, SCALE_ABOVE = 10, 10


def pca_2d(points: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, x, y)``: the first two principal components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(data).transform(data)
    projected = PCA(k=2, inputCol="features", outputCol="pca").fit(centred).transform(centred)
    return projected.select(id, vector_to_array("pca").alias("p")).select(id, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def neighbour_layout(edges: DataFrame, start: DataFrame, rounds: int = 10, id: str = "id", apart: float = 0.1) -> DataFrame:
    """A layout ``(id, x, y)`` that keeps neighbours together: from a first projection, every point moves to the
    middle of itself and its neighbours, but not nearer to it than ``apart`` of the way, so groups do not collapse.

    A round is a join and is written, so the plan does not grow with the rounds.
    """
    now = materialize(start.select(F.col(id).alias("src"), "x", "y"), "layout")
    for _ in range(rounds):
        pulled = edges.select("src", "dst").join(now.select(F.col("src").alias("dst"), "x", "y"), "dst").groupBy("src").agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
        part = (1 - apart) / 2
        moved = now.join(pulled, "src", "left").select("src", *((F.col(c) + part * (F.coalesce(f"n{c}", c) - F.col(c))).alias(c) for c in ("x", "y")))
        after = materialize(moved, "layout")
        drop_table(now)
        now = after
    return now.select(F.col("src").alias(id), "x", "y")


def colour_categorical(sample: DataFrame, field: str, order: str) -> DataFrame:
    """``colour``: the palette index of a value by first appearance; null stays without colour.

    Values are numbered in ranges, so a field of very many values is no single task.
    """
    first = sample.where(F.col(field).isNotNull()).groupBy(field).agg(F.min(order).alias("__first"))
    index = sequence_rows(first, 0, ["__first"]).select(field, F.pmod("lsn", F.lit(PALETTE)).cast("int").alias("colour"))
    return sample.join(index, field, "left")


def colour_numeric(sample: DataFrame, field: str) -> DataFrame:
    """``colour`` in [0, 1] between the least and the greatest value; null where there is none."""
    span = F.broadcast(sample.agg(F.min(field).cast("double").alias("__lo"), F.max(field).cast("double").alias("__hi")))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(field) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).when(F.col(field).isNotNull(), 0.0)
    return sample.join(span).withColumn("colour", scaled).drop("__lo", "__hi")


def is_numeric_scale(sample: DataFrame, field: str) -> DataFrame:
    """One row ``(numeric)``: all values are numbers and more than ``SCALE_ABOVE`` are distinct."""
    text = F.col(field).cast("string")
    return sample.where(F.col(field).isNotNull()).agg((F.coalesce(F.bool_and(text.try_cast("double").isNotNull()), F.lit(False)) & (F.count_distinct(field) > SCALE_ABOVE)).alias("numeric"))


def field_stats(sample: DataFrame, field: str) -> DataFrame:
    return sample.agg(F.count_distinct(field).alias("n_distinct"), F.min(field).alias("min_value"), F.max(field).alias("max_value"), F.count(field).alias("n_values"))


def hover_text(id: Column, x: Column, y: Column, score: Column) -> Column:
    return F.concat_ws("<br>", F.concat(F.lit("ID: "), id.cast("string")), F.format_string("(%.4f, %.4f)", x, y), F.format_string("score: %.4f", score))
