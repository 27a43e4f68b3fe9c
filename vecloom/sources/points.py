"""Point sources: JSON arrays (file or text), vector literals, generators, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = "array<struct<id:variant,vector:variant,metadata:variant>>"


def parse_vector_literal(text: Column) -> Column:
    """``'1, 2.5,,3'`` as an array of doubles: parts trimmed, empty ones dropped.

    Null where a part is no number or nothing is left.
    """
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def parse_points_json(text: Column) -> Column:
    """A pasted JSON array as ``array<struct<pos, id, vector, payload, error>>``.

    Each item needs a string id, an array vector of numbers and, if it has one, an
    object as metadata. Text that is no JSON array gives null.
    """
    items = F.try_variant_get(F.try_parse_json(text), "$", _ITEM)

    def item(x: Column, i: Column) -> Column:
        kind = lambda c: F.schema_of_variant(c)
        name, vector, meta = x["id"], F.try_variant_get(x["vector"], "$", "array<double>"), x["metadata"]
        error = (
            F.when(name.isNull() | (kind(name) != "STRING"), "id must be a string")
            .when(vector.isNull() | F.exists(vector, lambda v: v.isNull()), "vector must be an array of numbers")
            .when(meta.isNotNull() & ~kind(meta).startswith("OBJECT"), "metadata must be an object")
        )
        return F.struct(i.alias("pos"), F.try_variant_get(name, "$", "string").alias("id"), vector.cast("array<float>").alias("vector"), F.to_json(meta).alias("payload"), error.alias("error"))

    return F.transform(items, item)


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(file, pos, id, vector, payload, error)`` of files that each hold one JSON array.

    Such a file is one value and is parsed by one task, whatever its size: files are
    the unit of parallel reading here. For large inputs write a point a line and use
    :func:`read_points_lines`, which splits files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), parse_points_json(F.col("value")).alias("items"))
    return whole.select("file", F.inline("items"))


def read_points_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(file, id, vector, payload, error)`` of files with a point a line, also as an array
    whose elements stand on lines of their own; files are split, blank lines and the brackets left out."""
    line = F.regexp_replace(F.trim("value"), ",$", "")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), line.alias("line")).where(~F.col("line").isin("", "[", "]"))
    item = F.coalesce(parse_points_json(F.concat(F.lit("["), F.col("line"), F.lit("]"))), F.array(_no_item("line is no JSON")))
    return rows.select("file", F.inline(item)).drop("pos")


def _no_item(error: str) -> Column:
    return F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"), F.lit(error).alias("error"))


def synthetic_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42, prefix: str = "vec_", digits: int | None = 4) -> DataFrame:
    """``n`` points of uniform numbers in [-1, 1); each number follows from seed, row and place alone."""
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("n"), i), F.lit(1 << 40)) / float(1 << 39) - 1
    value = (lambda i: F.round(unit(i), digits)) if digits is not None else unit
    rows = spark.range(n).withColumnRenamed("id", "n")
    return rows.select(F.concat(F.lit(prefix), F.col("n").cast("string")).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), value).cast(T.ArrayType(T.FloatType())).alias("vector"))


def explore_sample(points: DataFrame, limit: int = 1000, id: str = "id") -> DataFrame:
    """The first ``limit`` points by id, the working set of an exploration."""
    return points.orderBy(id).limit(limit)
