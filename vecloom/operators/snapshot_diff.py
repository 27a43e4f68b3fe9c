"""What changed between consecutive full snapshots.

Method: every key of a collection has a persistent ordinal. A snapshot is then a
compressed bitmap over ordinals (only words of 64 ordinals that hold a bit are
stored) with a vector of content digests aligned to the bits. Consecutive
snapshots are joined word by word: AND-NOT of the bits gives additions and
removals, and the aligned digests expose changes among common keys. The word join
moves one row for up to 64 keys; contents never travel, only their digests.

Ordinals are given per hash bucket (``bucket``, then the place in it), so no task
sees all keys, and an ordinal once given is kept: :func:`diff` stores the table at
``keep`` and continues behind it the next time.

Defined cases. A snapshot is a collection and a name; manifests without a time
cannot be ordered and are left out, and so are points of unknown snapshots. Equal
times are ordered by name. Of several rows of a point in one snapshot the highest
version counts (null is lowest), and of rows equal in that the largest digest.
Null vectors and payloads are values of their own. A snapshot without points is
an empty one. A first snapshot gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.payload import canonical_json
from ..runtime import materialize

_KEY = ["collection_name", "id"]
_WORD = ["collection_name", "bucket", "word"]


def snapshot_order(manifests: DataFrame) -> DataFrame:
    """``(collection_name, snapshot_name, taken_at, place)``, one row a snapshot, ``place`` from 0."""
    one = manifests.select("collection_name", "snapshot_name", F.col("timestamp_utc").try_cast("timestamp").alias("taken_at"))
    one = one.where("snapshot_name is not null and taken_at is not null").groupBy("collection_name", "snapshot_name").agg(F.min("taken_at").alias("taken_at"))
    # one row a snapshot, so a partition holds as many rows as a collection has snapshots
    place = F.row_number().over(Window.partitionBy("collection_name").orderBy("taken_at", "snapshot_name")) - 1
    return one.withColumn("place", place)


def content_digest(vector: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.to_json(vector), F.lit("-")), F.when(payload.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), canonical_json(payload)))), 256)


def _top_rows(points: DataFrame) -> DataFrame:
    digest = content_digest(F.col("vector"), F.col("payload"))
    rows = points.where("id is not null").select(*_KEY, "snapshot_name", F.struct(F.coalesce("version", F.lit(-(1 << 62))).alias("v"), F.unhex(digest).alias("digest")).alias("top"))
    return rows.groupBy(*_KEY, "snapshot_name").agg(F.max("top").alias("top")).select(*_KEY, "snapshot_name", "top.digest")


def key_ordinals(keys: DataFrame, known: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """``(collection_name, id, bucket, ordinal)`` of distinct ``keys``; ``known`` keeps its ordinals.

    ``buckets`` belongs to the table for good; by default it follows the number of
    shuffle partitions, or is taken from ``known``.
    """
    if known is not None:
        first = known.agg(F.max("buckets")).first()
        buckets = (first[0] if first else None) or buckets
    buckets = buckets or max(64, 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fresh = keys.select(*_KEY).distinct()
    if known is not None:
        fresh = fresh.join(known.select(*_KEY), _KEY, "left_anti")
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("collection_name", "bucket").orderBy("id")).cast("bigint") - 1
    fresh = fresh.withColumn("ordinal", place).withColumn("buckets", F.lit(buckets))
    if known is None:
        return fresh
    used = known.groupBy("collection_name", "bucket").agg((F.max("ordinal") + 1).alias("used"))
    shifted = fresh.join(used, ["collection_name", "bucket"], "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("used", F.lit(0)))
    return known.unionByName(shifted.select(*known.columns))


def snapshot_bitmaps(points: DataFrame, ordinals: DataFrame, order: DataFrame) -> DataFrame:
    """``(collection_name, bucket, word, place, snapshot_name, bits, digests)``; ``digests[i]`` belongs to the i-th set bit."""
    rows = _top_rows(points).join(order.select("collection_name", "snapshot_name", "place"), ["collection_name", "snapshot_name"]).join(ordinals, _KEY)
    bit = F.pmod("ordinal", F.lit(64)).cast("int")
    rows = rows.select("collection_name", "bucket", F.expr("ordinal div 64").alias("word"), "place", bit.alias("bit"), "digest")
    grouped = rows.groupBy(*_WORD, "place").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bit", "digest")))).alias("digests"),
    )
    return grouped


def kept_ordinals(spark: SparkSession, keep: str) -> tuple[DataFrame | None, str]:
    """The newest complete table of ordinals at ``keep``, and where the next one belongs."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(keep).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at(keep))] if fs.exists(at(keep)) else []
    numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    whole = [n for n in numbers if fs.exists(at(f"{keep}/v{n}/_SUCCESS"))]
    return spark.read.parquet(f"{keep}/v{max(whole)}") if whole else None, f"{keep}/v{max(numbers, default=0) + 1}"


def diff(points: DataFrame, manifests: DataFrame, known: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """``(collection_name, snapshot_name, id, change)`` between consecutive snapshots.

    ``keep`` is a folder for the ordinals: those in it are continued, and a new version
    is written beside the old ones. Without it ``known`` may give former ordinals.
    """
    order = materialize(snapshot_order(manifests), "snapshot-order")
    keys = points.where("id is not null")
    if keep is None:
        ordinals = materialize(key_ordinals(keys, known), "ordinals")
    else:
        known, path = kept_ordinals(points.sparkSession, keep)
        key_ordinals(keys, known).write.parquet(path)
        ordinals = points.sparkSession.read.parquet(path)
    words = materialize(snapshot_bitmaps(points, ordinals, order), "bitmaps")
    # every word takes part as the later side of its snapshot and the earlier side of the next
    later = words.select(*_WORD, "place", F.col("bits").alias("b1"), F.col("digests").alias("d1"))
    earlier = words.select(*_WORD, (F.col("place") + 1).alias("place"), F.col("bits").alias("b0"), F.col("digests").alias("d0"))
    both = later.join(earlier, [*_WORD, "place"], "full").join(order.where("place > 0"), ["collection_name", "place"])
    b1, b0 = F.coalesce("b1", F.lit(0).cast("bigint")), F.coalesce("b0", F.lit(0).cast("bigint"))
    both = both.select(*_WORD, "snapshot_name", "d1", "d0", b1.bitwiseAND(F.bitwise_not(b0)).alias("added"), b0.bitwiseAND(F.bitwise_not(b1)).alias("removed"), b0.bitwiseAND(b1).alias("common"))
    places = F.sequence(F.lit(0), F.lit(63))
    on = lambda bits, i: F.call_function("bit_get", F.col(bits), i) == 1
    kind = lambda name, test: F.transform(F.filter(places, test), lambda i: F.struct(i.alias("bit"), F.lit(name).alias("change")))
    events = F.concat(
        kind("added", lambda i: on("added", i)),
        kind("removed", lambda i: on("removed", i)),
        kind("changed", lambda i: on("common", i) & (F.col("d1")[i] != F.col("d0")[i])),
    )
    touched = both.select(*_WORD, "snapshot_name", F.explode(events).alias("e"))
    touched = touched.select("collection_name", "bucket", (F.col("word") * 64 + F.col("e.bit")).alias("ordinal"), "snapshot_name", "e.change")
    return touched.join(ordinals.select("collection_name", "bucket", "ordinal", "id"), ["collection_name", "bucket", "ordinal"]).select("collection_name", "snapshot_name", "id", "change")
