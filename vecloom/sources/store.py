"""Collections on a shared file system: catalog, mutation log, checkpoints, snapshots.

Layout below ``root``: ``<collection>/meta.json``, ``<collection>/log/part=<n>``,
``<collection>/state/<version>``, ``<collection>/tombstones/<version>``,
``<collection>/index/<version>``, ``<collection>/graph/<version>`` and
``snapshots/<collection>/<name>``. A version or part is written completely before the
JSON that names it is replaced, so readers see either the old or the new one. Every
record of the log carries a checksum. Every collection has a single writer.
"""

from __future__ import annotations

import json
import warnings
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import Metric
from ..operators import log as wal
from ..operators import state as fold
from ..runtime import drop_table, materialize
from ..schema import INPUT, MUTATIONS, POINTS, AlreadyExists, Collection, CorruptData, GraphConfig, InvalidArgument, NotFound

ENGINE_VERSION = "0.2.0"
LOG = T.StructType([*MUTATIONS, T.StructField("segment_id", T.IntegerType()), T.StructField("checksum", T.LongType())])


def snapshot_name(collection: Column, at: Column) -> Column:
    """The name of a snapshot that is given none: ``<collection>_<date>_<time>``."""
    return F.concat(collection, F.date_format(at, "'_'yyyyMMdd_HHmmss"))


class Files:
    """The few file operations the store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.hconf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.hconf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def delete(self, p: str) -> bool:
        return self.fs.delete(self.path(p), True)

    def size(self, p: str) -> int:
        return int(self.fs.getContentSummary(self.path(p)).getLength()) if self.exists(p) else 0

    def _text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, p: str) -> str | None:
        """The text last put by :meth:`replace`, None if there is none."""
        for _ in range(3):
            # between the two steps of a replacement the new text stands beside the target
            for at in (p, p + ".tmp"):
                if self.exists(at):
                    try:
                        return self._text(at)
                    except Exception as gone:  # noqa: BLE001
                        if self.exists(at):
                            raise gone
        return None

    def replace(self, p: str, text: str) -> None:
        """Write beside the target in full, then rename over it; :meth:`read` always finds the old or the new text."""
        whole, part = self.path(p + ".new"), self.path(p + ".tmp")
        stream = self.fs.create(whole, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.exists(p) and self.exists(p + ".tmp"):
            self.fs.rename(part, self.path(p))  # a replacement that was broken off
        self.fs.delete(part, False)
        self.fs.rename(whole, part)
        self.fs.delete(self.path(p), False)
        self.fs.rename(part, self.path(p))


class Engine:
    """Collections, points, search and snapshots; results are DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    # collections

    def _dir(self, name: str) -> str:
        return f"{self.root}/collections/{name}"

    def _meta(self, name: str) -> dict:
        text = self.files.read(f"{self._dir(name)}/meta.json") if name else None
        if text is None:
            if name and self.files.exists(f"{self._dir(name)}/log"):
                return self._default_meta(name)
            raise NotFound(f"Collection '{name}' not found")
        try:
            return json.loads(text)
        except ValueError as wrong:
            raise CorruptData(f"metadata of '{name}' cannot be read") from wrong

    def _default_meta(self, name: str) -> dict:
        """For a log without metadata: default settings, and what the log itself says."""
        parts = sorted(int(n.split("=")[1]) for n in self.files.names(f"{self._dir(name)}/log") if n.startswith("part="))
        if not parts:
            raise CorruptData(f"'{name}' has neither metadata nor a log")
        rows = self.spark.read.schema(LOG).parquet(*[f"{self._dir(name)}/log/part={i}" for i in parts])
        seen = rows.agg(F.max("lsn").alias("lsn"), F.mode(F.size("vector")).alias("dim"), F.max("segment_id").alias("segment")).first()
        made = Collection(name, seen["dim"] or 1, "COSINE", GraphConfig(vector_dim=seen["dim"] or 1), -1 if seen["lsn"] is None else seen["lsn"])
        return {**made.to_json(), "next_lsn": made.next_lsn + 1, "parts": parts[-1] + 1, "first_part": parts[0], "state": None, "checkpoint_lsn": None, "segment": seen["segment"] or 0}

    def _keep(self, name: str, meta: dict) -> None:
        self.files.replace(f"{self._dir(name)}/meta.json", json.dumps(meta))

    def create_collection(self, name: str, dim: int, metric: str = "COSINE", config: GraphConfig | None = None) -> None:
        made = Collection(name, dim, metric, config or GraphConfig(vector_dim=dim)).validate()
        if self.files.exists(self._dir(name)):
            raise AlreadyExists(f"Collection '{name}' already exists")
        self._keep(name, {**made.to_json(), "metric": Metric.of(metric).value, "parts": 0, "first_part": 0, "state": None, "checkpoint_lsn": None, "segment": 0})

    def drop_collection(self, name: str) -> None:
        self._meta(name)
        self.files.delete(self._dir(name))

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/collections") if self.files.exists(f"{self._dir(n)}/meta.json") or self.files.exists(f"{self._dir(n)}/meta.json.tmp")]

    def describe_all(self) -> DataFrame:
        """``(name, count, status, dim, metric)`` of every collection, by name; RED where the metadata cannot be read."""
        rows = None
        for name in self.list_collections():
            try:
                meta = self._meta(name)
                one = self.points(name).agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count", F.lit("GREEN").alias("status"), F.lit(meta["dim"]).alias("dim"), F.lit(meta["metric"]).alias("metric"))
            except CorruptData:
                one = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("count"), F.lit("RED").alias("status"), F.lit(None).cast("int").alias("dim"), F.lit(None).cast("string").alias("metric"))
            rows = one if rows is None else rows.unionByName(one)
        empty = self.spark.createDataFrame([], "name string, count bigint, status string, dim int, metric string")
        return empty if rows is None else rows.orderBy("name")

    def describe(self, name: str) -> dict:
        """Counts, sizes and settings. Status is GREEN while the metadata can be read."""
        meta = self._meta(name)
        row = self.segment_stats(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("s"), F.coalesce(F.sum("ram_bytes"), F.lit(0)).alias("ram")).first()
        return {"name": name, "dim": meta["dim"], "metric": meta["metric"], "config": meta["config"], "status": "GREEN", "count": row["n"], "segments": max(row["s"], 1), "ram_bytes": row["ram"], "disk_bytes": self.files.size(self._dir(name))}

    def segment_stats(self, name: str) -> DataFrame:
        """``(segment_id, n, ram_bytes)``: living points of every segment, and the bytes of their vectors and marks."""
        return self.points(name).groupBy("segment_id").agg(F.count("*").alias("n"), F.sum(F.size("vector") * 4 + 1).cast("bigint").alias("ram_bytes"))

    def add_segment(self, name: str) -> int:
        """Later writes of new points go to a new segment."""
        meta = self._meta(name)
        self._keep(name, {**meta, "segment": meta["segment"] + 1})
        return meta["segment"] + 1

    # log and state

    def log(self, name: str) -> DataFrame:
        """The records after the last checkpoint. A part that is missing is passed over with a warning."""
        meta = self._meta(name)
        listed = [f"{self._dir(name)}/log/part={i}" for i in range(meta["first_part"], meta["parts"])]
        parts = [p for p in listed if self.files.exists(p)]
        if len(parts) < len(listed):
            if not parts and meta["state"] is None:
                raise CorruptData(f"'{name}' has lost every part of its log")
            warnings.warn(f"'{name}': {len(listed) - len(parts)} parts of the log are missing", stacklevel=2)
        return self.spark.read.schema(LOG).parquet(*parts) if parts else self.spark.createDataFrame([], LOG)

    def _append(self, name: str, records: DataFrame) -> None:
        """``records`` (op, id, vector, payload, pos) get dense numbers and become one part of the log."""
        meta = self._meta(name)
        part = f"{self._dir(name)}/log/part={meta['parts']}"
        numbered, count, placed = fold.numbered_rows(records, meta["next_lsn"], ["pos"])
        sealed = wal.seal(numbered.select("lsn", "op", "id", "vector", "payload"))
        sealed.select("lsn", "op", "id", "vector", "payload", F.current_timestamp().alias("ts"), F.lit(meta["segment"]).alias("segment_id"), "checksum").write.mode("overwrite").parquet(part)
        drop_table(placed)
        self._keep(name, {**meta, "parts": meta["parts"] + 1, "next_lsn": meta["next_lsn"] + count})

    def repair(self, name: str) -> int:
        """Cut every part of the log before its first record that does not match its checksum; how many records went."""
        meta, gone = self._meta(name), 0
        for i in range(meta["first_part"], meta["parts"]):
            at = f"{self._dir(name)}/log/part={i}"
            if not self.files.exists(at):
                continue
            rows = self.spark.read.schema(LOG).parquet(at)
            bad = wal.mark_corrupt(rows).where("_corrupt_record is not null").agg(F.min("lsn").alias("lsn")).first()["lsn"]
            if bad is not None:
                kept = materialize(wal.truncate_suffix(rows, bad), "repaired")
                gone += rows.count() - kept.count()
                kept.write.mode("overwrite").parquet(at)
                drop_table(kept)
        return gone

    def tombstones(self, name: str) -> DataFrame:
        """``(id, lsn)`` of points that were deleted: those a checkpoint keeps, and those of the log."""
        meta = self._meta(name)
        fresh = self.log(name)
        dead = fold.tombstones(fresh).select("id", "lsn")
        kept = self._kept_tombstones(name, meta)
        return dead if kept is None else dead.unionByName(kept.join(fresh.select("id").distinct(), "id", "left_anti"))

    def _kept_tombstones(self, name: str, meta: dict) -> DataFrame | None:
        at = f"{self._dir(name)}/tombstones/{meta['state']}"
        return self.spark.read.schema("id string, lsn bigint").parquet(at) if meta["state"] and self.files.exists(at) else None

    def points(self, name: str) -> DataFrame:
        """The living points: the last checkpoint and the log after it."""
        meta = self._meta(name)
        fresh = self.log(name)
        columns = ["id", "vector", "payload", "version", "segment_id", "lsn"]
        if meta["state"] is None:
            return fold.version_fold(fresh).select(*columns)
        state = self.spark.read.schema(POINTS).parquet(f"{self._dir(name)}/state/{meta['state']}").select("id", "lsn", "version", "vector", "payload", "segment_id")
        return wal.recover(state, fresh, meta["checkpoint_lsn"]).select(*columns)

    def checkpoint(self, name: str) -> None:
        """Write the state, name it, then drop the parts of the log it covers."""
        meta = self._meta(name)
        version = f"v{meta['next_lsn']}"
        if meta["state"] == version:
            return
        self.points(name).write.mode("overwrite").parquet(f"{self._dir(name)}/state/{version}")
        self.tombstones(name).write.mode("overwrite").parquet(f"{self._dir(name)}/tombstones/{version}")
        self._keep(name, {**meta, "state": version, "checkpoint_lsn": meta["next_lsn"] - 1, "first_part": meta["parts"]})
        for i in range(meta["first_part"], meta["parts"]):
            self.files.delete(f"{self._dir(name)}/log/part={i}")
        if meta["state"]:
            self.files.delete(f"{self._dir(name)}/state/{meta['state']}")
            self.files.delete(f"{self._dir(name)}/tombstones/{meta['state']}")

    def checkpoint_all(self) -> dict[str, str | None]:
        """Checkpoint every collection; one that fails does not stop the others: ``name -> error or None``."""
        out: dict[str, str | None] = {}
        for name in self.list_collections():
            try:
                self.checkpoint(name)
                out[name] = None
            except Exception as wrong:  # noqa: BLE001
                out[name] = str(wrong)
        return out

    def verify(self, name: str) -> dict:
        """What opening a collection should find: every vector of the right length, dense numbers, records that match their checksums."""
        meta = self._meta(name)
        row = self.points(name).agg(F.count("*").alias("n"), F.count_if(F.size("vector") != meta["dim"]).alias("wrong")).first()
        log = self.log(name)
        holes, broken = wal.gaps(log).count(), wal.mark_corrupt(log).where("_corrupt_record is not null").count()
        if row["wrong"] or holes or broken:
            raise CorruptData(f"'{name}': {row['wrong']} vectors of a wrong length, {holes} gaps and {broken} corrupt records in the log")
        return {"count": row["n"], "dim": meta["dim"]}

    # points

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """Validate, then append. Rows have ``id, vector, payload`` and, to fix their order, ``pos``.

        A bad id or vector refuses the whole batch: the returned statuses are those of
        the bad rows. Otherwise every row has a status; a bad payload fails alone. The
        input is evaluated once: what was checked is what is written.
        """
        meta = self._meta(name)
        batch = rows if "pos" in rows.columns else rows.withColumn("pos", F.monotonically_increasing_id())
        batch = materialize(batch.select("id", "vector", "payload", "pos"), "upsert")
        status = materialize(fold.validate_points(batch, meta["dim"]), "upsert-status")
        if fold.batch_result(status).first()["rejected"]:
            drop_table(batch)
            return status.where("rejects_batch")
        good = batch.join(status.where("status_code = 'OK'").select("pos"), "pos", "left_semi")
        self._append(name, good.select(F.lit("upsert").alias("op"), "id", "vector", "payload", "pos"))
        drop_table(batch)
        return status

    def upsert_or_raise(self, name: str, rows: DataFrame) -> DataFrame:
        """:meth:`upsert`, but the first error of any row is raised as :class:`InvalidArgument`; good rows of a batch that is not refused are kept."""
        status = self.upsert(name, rows)
        wrong = fold.batch_result(status).first()["overall_error"]
        if wrong is not None:
            raise InvalidArgument(wrong)
        return status

    def upsert_rows(self, name: str, rows: list[tuple]) -> DataFrame:
        """:meth:`upsert` of Python tuples ``(id, vector, payload JSON)`` in order."""
        if not rows:
            raise InvalidArgument("no points given")
        schema = T.StructType([*INPUT, T.StructField("pos", T.IntegerType())])
        return self.upsert(name, self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema))

    def delete(self, name: str, ids: list[str]) -> DataFrame:
        if not ids:
            raise InvalidArgument("no ids given")
        asked = self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos int")
        seen = self.log(name).select("id").unionByName(self.points(name).select("id")).unionByName(self.tombstones(name).select("id"))
        status = self.spark.createDataFrame(fold.delete_status(seen, asked).toArrow())
        known = status.where("status_code = 'OK'").select(F.col("point_id").alias("id")).distinct()
        gone = asked.join(known, "id", "left_semi").select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"), "pos")
        self._append(name, gone)
        return status

    def get(self, name: str, ids: list[str], with_payload: bool = True, with_vector: bool = False) -> DataFrame:
        asked = self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos int")
        keep = ["id", *["payload"] * with_payload, *["vector"] * with_vector, "version"]
        return fold.get_points(self.points(name).select(*keep), asked).select(*keep)

    def list_points(self, name: str, limit: int | None = None) -> DataFrame:
        rows = self.points(name).orderBy("id")
        return rows if limit is None else rows.limit(limit)

    def search(self, name: str, q: list[float], k: int, must_match: dict | None = None, mode: str = "pre", with_payload: bool = True, with_vector: bool = False, approximate: bool = False, ef_search: int | None = None) -> DataFrame:
        """The ``k`` best points. ``approximate`` looks into the cells of the index that
        ``ef_search`` asks for (by default the collection's setting, ``k`` at least), and
        compares points that changed since the index was built exactly."""
        from ..operators.search import knn_filtered, query_vector

        meta = self._meta(name)
        query_vector(q, meta["dim"])
        keep = (*["payload"] * with_payload, *["vector"] * with_vector, "version")
        points = self.points(name)
        if approximate:
            index = self._index(name, meta)
            near = index.candidates(q, index.probes(max(ef_search or meta["config"]["ef_search"] or 50, k)))
            changed = wal.after(self.log(name), meta["index"]["lsn"]).select("id").distinct()
            columns = ["id", "vector", "payload", "version"]
            points = near.select(*columns).join(changed, "id", "left_anti").unionByName(points.join(changed, "id", "left_semi").select(*columns))
        return knn_filtered(points, q, k, must_match, meta["metric"], mode, keep=keep)

    def create_cell_index(self, name: str, cells: int = 32) -> None:
        """Write a cell index of the living points; it replaces the one before."""
        from ..operators.graph import CellIndex

        self.checkpoint(name)  # so that later changes are the whole log
        meta = self._meta(name)
        version = f"v{meta['next_lsn']}-{cells}"
        CellIndex.build(self.points(name), f"{self._dir(name)}/index/{version}", cells, meta["metric"], keep=("payload", "version"))
        self._keep(name, {**meta, "index": {"version": version, "lsn": meta["next_lsn"] - 1}})
        for old in self.files.names(f"{self._dir(name)}/index"):
            if old != version:
                self.files.delete(f"{self._dir(name)}/index/{old}")

    def _index(self, name: str, meta: dict):
        from ..operators.graph import CellIndex

        if not meta.get("index"):
            raise NotFound(f"Collection '{name}' has no index")
        return CellIndex(self.spark, f"{self._dir(name)}/index/{meta['index']['version']}")

    # neighbour graph

    def build_graph(self, name: str, m: int | None = None) -> None:
        """Write the neighbour graph of the living points: ``m`` links out, cut to ``m_max0`` with those coming in."""
        from ..operators.graph import knn_graph, link_both_ways

        meta = self._meta(name)
        version = f"v{meta['next_lsn']}"
        edges = link_both_ways(knn_graph(self.points(name), m or meta["config"]["m"], meta["metric"]), meta["config"]["m_max0"], meta["metric"])
        edges.repartitionByRange("src").sortWithinPartitions("src", "rank").write.mode("overwrite").parquet(f"{self._dir(name)}/graph/{version}")
        self._keep(name, {**meta, "graph": version})

    def graph(self, name: str) -> DataFrame:
        """``(src, dst, score, rank)`` of the stored graph."""
        meta = self._meta(name)
        if not meta.get("graph"):
            raise NotFound(f"Collection '{name}' has no graph")
        return self.spark.read.parquet(f"{self._dir(name)}/graph/{meta['graph']}")

    def links(self, name: str, id: str) -> list[str]:
        """The links of one node, best first; the files are sorted by node, so few are read."""
        found = [r["dst"] for r in self.graph(name).where(F.col("src") == id).orderBy("rank").select("dst").collect()]
        if not found and not self.points(name).where(F.col("id") == id).limit(1).count():
            raise NotFound(f"Point '{id}' not found")
        return found

    # snapshots

    def _snapshot(self, name: str, snapshot: str) -> str:
        return f"{self.root}/snapshots/{name}/{snapshot}"

    def create_snapshot(self, name: str, snapshot: str | None = None) -> dict:
        meta = self._meta(name)
        now = datetime.now(timezone.utc)
        snapshot = snapshot or f"{name}_{now:%Y%m%d_%H%M%S}"
        if self.files.exists(self._snapshot(name, snapshot)):
            raise AlreadyExists(f"Snapshot '{snapshot}' already exists")
        self.points(name).write.parquet(f"{self._snapshot(name, snapshot)}/points")
        self.tombstones(name).write.parquet(f"{self._snapshot(name, snapshot)}/tombstones")
        manifest = {"snapshot_version": "1", "snapshot_name": snapshot, "collection_name": name, "timestamp_utc": now.isoformat(), "engine_version": ENGINE_VERSION, "checkpoint_lsn": meta["next_lsn"] - 1, "collection": meta}
        self.files.replace(f"{self._snapshot(name, snapshot)}/manifest.json", json.dumps(manifest))
        return manifest

    def list_snapshots(self, name: str) -> list[dict]:
        """Manifests that can be read; an unknown collection has none."""
        out = []
        for one in self.files.names(f"{self.root}/snapshots/{name}"):
            at = f"{self._snapshot(name, one)}/manifest.json"
            if self.files.exists(at):
                try:
                    out.append(json.loads(self.files.read(at)))
                except ValueError:
                    continue
        return [m for m in out if m.get("collection_name") == name]

    def read_snapshot(self, name: str, snapshot: str) -> DataFrame:
        """The points of a snapshot, read-only."""
        if not self.files.exists(f"{self._snapshot(name, snapshot)}/manifest.json"):
            raise NotFound(f"Snapshot '{snapshot}' not found")
        return self.spark.read.schema(POINTS).parquet(f"{self._snapshot(name, snapshot)}/points")

    def restore_snapshot(self, name: str, snapshot: str, target: str) -> None:
        points = self.read_snapshot(name, snapshot)
        if self.files.exists(self._dir(target)):
            raise AlreadyExists(f"Collection '{target}' already exists")
        kept = json.loads(self.files.read(f"{self._snapshot(name, snapshot)}/manifest.json"))["collection"]
        version = f"v{kept['next_lsn']}"
        points.write.parquet(f"{self._dir(target)}/state/{version}")
        dead = f"{self._snapshot(name, snapshot)}/tombstones"
        if self.files.exists(dead):
            self.spark.read.schema("id string, lsn bigint").parquet(dead).write.parquet(f"{self._dir(target)}/tombstones/{version}")
        kept = {k: v for k, v in kept.items() if k not in ("index", "graph")}
        self._keep(target, {**kept, "name": target, "state": version, "checkpoint_lsn": kept["next_lsn"] - 1, "parts": 0, "first_part": 0})

    def delete_snapshot(self, name: str, snapshot: str) -> None:
        if not self.files.exists(self._snapshot(name, snapshot)):
            raise NotFound(f"Snapshot '{snapshot}' not found")
        self.files.delete(self._snapshot(name, snapshot))


class AsyncEngine:
    """The engine's methods as futures: Spark runs the jobs of several callers at once."""

    def __init__(self, engine: Engine, workers: int = 8):
        from concurrent.futures import ThreadPoolExecutor

        self._engine, self._pool = engine, ThreadPoolExecutor(workers)

    def __getattr__(self, name: str):
        method = getattr(self._engine, name)
        return lambda *args, **kwargs: self._pool.submit(method, *args, **kwargs)

    def close(self) -> None:
        self._pool.shutdown()
