"""Applying a feed of inserts, updates and deletes in log order.

The feed is read as a stream. Keyed state holds, for every point and stretch of
the log, the payload of the newest change, its sequence number, the tombstone
(the newest delete), and a bit for each sequence number of the stretch that was
applied, so that a repeated delivery counts once however late it comes; a change
is accepted into the payload only if it is newer. The state of a key has a fixed
size. Every micro-batch writes the states it touched under its batch number, so a
batch that runs twice overwrites its own output. Every ``COMPACT`` batches the
newest states are written as one version; a reader takes the newest version and
the few batches after it.

A hot point does not become a hot task: its state is cut into stretches of
``STRETCH`` sequence numbers, which are keys of their own, and partial
aggregation runs before the shuffle. What a stretch knows (newest delete,
newest upsert, upserts after the delete) folds associatively.

Defined cases. Deliveries of one sequence number are one change, in whatever
order and however often they arrive; if they differ in content, the one with a
payload that arrived last counts. The sequence is ``lsn``, else ``start_lsn +
entry_no``; rows with neither, with a null id or with an operation that touches
no point are ignored. A null payload or vector is kept as null. Deletes of absent
points do nothing. No rows give no points. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch_path

#: Sequence numbers of one state: four words of bits.
STRETCH = 256
#: Batches after which their output is folded into one version.
COMPACT = 8
#: Spellings of the writers, in lower case and letters only.
UPSERTS = ("addvector", "insert", "i", "update", "u", "upsert")
DELETES = ("deletevector", "delete", "d")
_KEY = ["collection_name", "id"]


def changes(log: DataFrame) -> DataFrame:
    """``(collection_name, id, seq, is_delete, body)`` of the rows that touch a point."""
    op = F.lower(F.regexp_replace("op", "[^A-Za-z]", ""))
    seq: Column = F.coalesce(F.col("lsn"), F.col("start_lsn") + F.col("entry_no"))
    return (
        log.where(F.col("id").isNotNull() & op.isin(*UPSERTS, *DELETES))
        .select(*_KEY, seq.alias("seq"), op.isin(*DELETES).alias("is_delete"), F.struct("vector", "metadata").alias("body"), "arrived_at")
        .where("seq is not null")
    )


def stretch_states(changed: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The keyed state: one row for each point and stretch of the log (batch or stream)."""
    upsert = F.when(~F.col("is_delete"), F.col("seq"))
    newest = F.when(~F.col("is_delete"), F.struct("seq", F.col("body.metadata").isNotNull().alias("has"), "arrived_at"))
    place = F.pmod("seq", F.lit(stretch)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)))
    words = range(-(-stretch // 64))
    state = changed.groupBy(*_KEY, F.expr(f"(seq - pmod(seq, {int(stretch)})) div {int(stretch)}").alias("stretch")).agg(
        F.max(F.when(F.col("is_delete"), F.col("seq"))).alias("tombstone"),
        F.max(upsert).alias("last_seq"),
        *(F.bit_or(F.when(~F.col("is_delete") & (F.floor(place / 64) == w), bit)).alias(f"w{w}") for w in words),
        F.max_by("body", newest).alias("body"),
    )
    dead = F.pmod("tombstone", F.lit(stretch)).cast("int")
    upserts, after = [], []
    for w in words:
        bits = F.coalesce(f"w{w}", F.lit(0).cast("bigint"))
        # bits of the numbers after the tombstone, which may lie before, in or behind this word
        past = F.when(dead.isNull() | (dead < 64 * w), bits).when(dead >= 64 * w + 63, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", bits, dead - 64 * w + 1))
        upserts.append(F.bit_count(bits))
        after.append(F.bit_count(past))
    total = lambda counts: sum(counts[1:], counts[0]).cast("bigint")
    return state.select(*_KEY, "stretch", "tombstone", "body", "last_seq", total(upserts).alias("upserts"), total(after).alias("after"))


def fold_states(states: DataFrame) -> DataFrame:
    """Living points from the states of all stretches: ``(collection_name, id, lsn, version, vector, metadata)``."""
    tomb = states.groupBy(*_KEY).agg(F.max("tombstone").alias("dead"), F.max("last_seq").alias("lsn"))
    living = tomb.where("lsn is not null and (dead is null or lsn > dead)")
    s, k = states.alias("s"), living.alias("k")
    same = F.col("s.collection_name").eqNullSafe(F.col("k.collection_name")) & (F.col("s.id") == F.col("k.id"))
    counted = F.when(F.col("k.dead").isNull() | (F.coalesce(F.col("s.tombstone"), F.lit(-1)) == F.col("k.dead")), F.col("s.after")).when(F.col("s.last_seq") > F.col("k.dead"), F.col("s.upserts")).otherwise(0)
    folded = s.join(k, same).groupBy("k.collection_name", "k.id").agg(F.max("k.lsn").alias("lsn"), F.sum(counted).alias("version"), F.max_by("s.body", F.struct(F.col("s.last_seq"))).alias("body"))
    return folded.select(*_KEY, "lsn", "version", "body.vector", "body.metadata")


def apply_batch(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The same fold over a bounded log, without a stream."""
    return fold_states(stretch_states(changes(log), stretch))


class ChangeFeed:
    """Applies the files of a log as they arrive; :meth:`current` is the table so far.

    ``home`` keeps the stream's checkpoint, the batch-versioned output and its folded
    versions; starting again with the same ``home`` continues after the last batch.
    """

    def __init__(self, spark: SparkSession, path: str, home: str | None = None, max_bytes: int = 256 << 20, max_files: int | None = None, stretch: int = STRETCH, compact: int = COMPACT):
        self.spark, self.path, self.stretch, self.compact = spark, path, stretch, compact
        self.home = home or scratch_path(spark, "feed")
        self.options = {"maxFilesPerTrigger": str(max_files)} if max_files else {"maxBytesPerTrigger": str(max_bytes)}

    def _session(self) -> SparkSession:
        own = self.spark.newSession()
        own.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        own.conf.set("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))
        own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        return own

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, kind: str) -> list[int]:
        """Numbers of the complete outputs of one kind, ascending."""
        fs, of = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        root = of(f"{self.home}/{kind}")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if fs.exists(of(f"{self.home}/{kind}/{n}/_SUCCESS")))

    def _read(self, spark: SparkSession, schema: T.StructType, number: int | None = None) -> tuple[DataFrame, list[int]]:
        """The newest state of every key, and the outputs it was read from."""
        versions = [v for v in self._written("versions") if number is None or v <= number]
        upto = versions[-1] if versions else -1
        parts = [(f"{self.home}/versions/upto={upto}", -1)] if versions else []
        batches = [b for b in self._written("states") if b > upto and (number is None or b <= number)]
        states = None
        for path, batch in parts + [(f"{self.home}/states/batch={b}", b) for b in batches]:
            one = spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(batch))
            states = one if states is None else states.unionByName(one)
        if states is None:
            return spark.createDataFrame([], schema), []
        if len(parts) + len(batches) == 1:
            return states.drop("batch"), batches
        rest = [c for c in schema.names if c not in (*_KEY, "stretch")]
        newest = states.groupBy(*_KEY, "stretch").agg(F.max_by(F.struct(*rest), "batch").alias("s"))
        return newest.select(*_KEY, "stretch", *(f"s.{c}" for c in rest)), batches

    def _fold(self, spark: SparkSession, schema: T.StructType, number: int) -> None:
        """Write the newest states up to batch ``number`` as a version; drop what the version before it covers."""
        states, batches = self._read(spark, schema, number)
        if len(batches) < self.compact:
            return
        states.write.mode("overwrite").parquet(f"{self.home}/versions/upto={number}")
        fs, of = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        # a reader may still be at the version before, so that one and its batches stay
        before = [v for v in self._written("versions") if v < number]
        for v in before[:-1]:
            fs.delete(of(f"{self.home}/versions/upto={v}"), True)
        for b in self._written("states"):
            if before and b <= before[-1]:
                fs.delete(of(f"{self.home}/states/batch={b}"), True)

    def _states_schema(self) -> T.StructType:
        return stretch_states(changes(self.spark.read.parquet(self.path).limit(0)), self.stretch).schema

    def run_available(self) -> "ChangeFeed":
        """Apply everything that has arrived, in as many batches as the limits ask for."""
        own = self._session()
        schema = self.spark.read.parquet(self.path).schema
        folder, options = self.path, dict(self.options)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
            folder, options["pathGlobFilter"] = self.path.rsplit("/", 1)
        log = own.readStream.schema(schema).options(**options).parquet(folder)
        kept = self._states_schema()

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.home}/states/batch={number}")
            self._fold(batch.sparkSession, kept, number)

        query = stretch_states(changes(log), self.stretch).writeStream.outputMode("update").option("checkpointLocation", f"{self.home}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def current(self) -> DataFrame:
        return fold_states(self._read(self.spark, self._states_schema())[0])
