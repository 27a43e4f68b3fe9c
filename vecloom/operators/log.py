"""The durable mutation log: append, ranges, bounds, gaps, truncation, integrity, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import sequence_rows, version_fold

#: Records of one log segment; truncation from the front drops whole segments.
SEGMENT_RECORDS = 1000


def after(log: DataFrame, checkpoint: int | None, lsn: str = "lsn") -> DataFrame:
    """Records to replay after a checkpoint, all of them without one."""
    return log if checkpoint is None else log.where(F.col(lsn) > checkpoint)


def read_at(log: DataFrame, at: int, lsn: str = "lsn") -> DataFrame:
    return log.where(F.col(lsn) == at)


def bounds(log: DataFrame, lsn: str = "lsn") -> DataFrame:
    return log.agg(F.min(lsn).alias("first_lsn"), F.max(lsn).alias("last_lsn"))


def truncate_suffix(log: DataFrame, at: int, lsn: str = "lsn") -> DataFrame:
    """Drops the records from ``at`` on."""
    return log.where(F.col(lsn) < at)


def segment_of(lsn: str = "lsn", records: int = SEGMENT_RECORDS) -> Column:
    return F.expr(f"{lsn} div {int(records)}")


def truncate_prefix(log: DataFrame, until: int, lsn: str = "lsn", records: int = SEGMENT_RECORDS) -> DataFrame:
    """Drops closed segments whose records all lie before ``until``; the open segment stays."""
    last = log.agg(F.max(segment_of(lsn, records)).alias("open"))
    kept = log.crossJoin(F.broadcast(last)).where((segment_of(lsn, records) == F.col("open")) | ((segment_of(lsn, records) + 1) * records > until))
    return kept.drop("open")


def gaps(log: DataFrame, lsn: str = "lsn", records: int = SEGMENT_RECORDS) -> DataFrame:
    """``(after_lsn, next_lsn)`` where numbers are missing or repeat.

    Neighbours are compared inside segments, and the end of a segment with the start
    of the following one by a join. Runs of present segments are numbered in parallel,
    and each end is joined with the start of the next run.
    """
    inside = Window.partitionBy("seg").orderBy(lsn)
    rows = log.select(lsn, segment_of(lsn, records).alias("seg"))
    within = rows.withColumn("next_lsn", F.lead(lsn).over(inside)).select(F.col(lsn).alias("after_lsn"), "next_lsn")
    ends = rows.groupBy("seg").agg(F.min(lsn).alias("lo"), F.max(lsn).alias("hi"))
    following = ends.select((F.col("seg") - 1).alias("seg"), F.col("lo").alias("next_lsn"))
    joined = ends.join(following, "seg", "left")
    between = joined.select(F.col("hi").alias("after_lsn"), "next_lsn")
    # runs of present segments: the k-th ends before the k+1-th begins
    tails = sequence_rows(joined.where("next_lsn is null").select(F.col("hi").alias("after_lsn")), 1, ["after_lsn"])
    heads = ends.join(ends.select((F.col("seg") + 1).alias("seg")), "seg", "left_anti").select(F.col("lo").alias("next_lsn"))
    across = tails.join(sequence_rows(heads, 0, ["next_lsn"]), "lsn").select("after_lsn", "next_lsn")
    return within.unionByName(between).unionByName(across).where(F.col("next_lsn") != F.col("after_lsn") + 1)


def checksum(log: DataFrame, over: tuple[str, ...] = ("lsn", "op", "id", "vector", "payload")) -> Column:
    """A checksum of each record, from those of the named columns that it has."""
    return F.xxhash64(*[c for c in over if c in log.columns])


def seal(log: DataFrame) -> DataFrame:
    """Records with the checksum they are written with."""
    return log.withColumn("checksum", checksum(log))


def mark_corrupt(log: DataFrame) -> DataFrame:
    """``_corrupt_record`` says what is wrong with a sealed record, null where nothing is."""
    return log.withColumn("_corrupt_record", F.when(~F.col("checksum").eqNullSafe(checksum(log)), "checksum"))


def valid_prefix(log: DataFrame, corrupt: str = "_corrupt_record", lsn: str = "lsn", records: int = SEGMENT_RECORDS) -> DataFrame:
    """Of each segment the records before its first corrupt one."""
    seg = log.withColumn("__seg", segment_of(lsn, records))
    bad = seg.where(F.col(corrupt).isNotNull()).groupBy("__seg").agg(F.min(lsn).alias("__bad"))
    return seg.join(bad, "__seg", "left").where(F.col("__bad").isNull() | (F.col(lsn) < F.col("__bad"))).drop("__seg", "__bad")


def recover(state: DataFrame, log: DataFrame, checkpoint: int | None) -> DataFrame:
    """State at a checkpoint and the records after it, folded to the current state.

    ``state`` has the columns of :func:`version_fold`. Ids without later records pass
    through; a replayed life that did not begin with a delete continues the stored
    version.
    """
    fresh = after(log, checkpoint)
    touched = fresh.groupBy("id").agg(F.max(F.when(F.col("op") == "delete", F.col("lsn"))).alias("dead"), F.count_if(F.col("op") != "delete").alias("n"))
    replayed = version_fold(fresh).alias("f")
    old = state.alias("s")
    joined = replayed.join(touched.alias("t"), "id").join(old, "id", "left")
    goes_on = F.col("t.dead").isNull() & F.col("s.lsn").isNotNull()
    version = F.when(goes_on, F.coalesce("s.version", F.lit(0)) + F.col("t.n")).otherwise(F.col("f.version"))
    rest = [c for c in state.columns if c not in ("id", "lsn", "version")]
    now = joined.select("id", F.col("f.lsn").alias("lsn"), version.alias("version"), *[F.col(f"f.{c}").alias(c) for c in rest])
    return now.unionByName(state.join(touched.select("id"), "id", "left_anti").select(now.columns))
