"""Session-level helpers: shared scratch tables, input spreading, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []
#: Names that :func:`scratch_path` gives.
_SCRATCH = re.compile(r"-[0-9a-f]{32}$")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests, a laptop) a temporary folder is made and
    set, once per application; on a cluster that case can only be a local master.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    spark.sparkContext.setCheckpointDir(made)
    _MADE.append(urlparse(made).path)
    return made


@atexit.register
def _clean() -> None:
    for path in _MADE:
        shutil.rmtree(path, ignore_errors=True)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vecloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{_scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application has below the shared folder, once no result is read any more.

    Operators drop the tables that their results do not read; the others stay until
    this call, as only the caller knows when a result has been used.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    This cuts the lineage and survives the loss of executors; unlike cached
    blocks the rows are not recomputed when a later stage fails.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` once nothing reads it."""
    jvm = df.sparkSession._jvm
    hconf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/vecloom/" in parent and _SCRATCH.search(parent):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(hconf).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy map stage at least one partition per core.

    Large inputs already have more splits than cores and pass through untouched;
    only an input of few splits pays for a round-robin exchange. Behind a shuffle
    adaptive execution chooses the partitions, and asking would run the shuffle.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    want = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def broadcast_if_small(df: DataFrame, key_bytes: int = 64, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when a count proves that the side fits ``max_bytes``."""
    return F.broadcast(df) if df.count() * key_bytes <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{os.fspath(sf_dir).rstrip('/')}/{name}.parquet")
