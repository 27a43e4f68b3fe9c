"""Neighbour graphs, approximate search by cells or hashing, and measured recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import Metric, best_first, higher_is_better, score
from ..runtime import scratch_path
from .search import QUERY_BLOCK, _best_rows, comparable, knn, knn_batch, query_vector


def knn_graph(points: DataFrame, k: int = 15, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector") -> DataFrame:
    """Edges ``(src, dst, score, rank)`` to the ``k`` nearest others of every point."""
    queries = points.select(F.col(id).alias("qid"), F.col(vector).alias("query"))
    return knn_batch(points, queries, k, metric, id, vector, exclude_self=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "score", "rank")


def select_best(edges: DataFrame, m: int, metric: Metric | str = "COSINE") -> DataFrame:
    """At most ``m`` edges of each source, the best by score."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*best_first(metric), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= m)


def link_both_ways(edges: DataFrame, m_max: int, metric: Metric | str = "COSINE") -> DataFrame:
    """Every edge in both directions, each once, cut to the ``m_max`` best of each node.

    An edge that was found from both ends may have scores that differ in rounding; the better counts.
    """
    best = F.max("score") if higher_is_better(metric) else F.min("score")
    both = edges.select("src", "dst", "score").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return select_best(both.groupBy("src", "dst").agg(best.alias("score")), m_max, metric)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def entry_point(points: DataFrame, id: str = "id") -> DataFrame:
    """Where a graph search starts: the smallest living id."""
    return points.agg(F.min(id).alias("entry"))


def level_draw(u: Column, ml: float = 1 / math.log(16)) -> Column:
    """Level of a new node from a uniform number in (0, 1]."""
    return F.floor(-F.log(F.greatest(u, F.lit(2.0**-53))) * ml).cast("int")


def beam_search(edges: DataFrame, points: DataFrame, q: list[float], entry, ef: int, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector", most: int = 1000) -> list[tuple]:
    """``[(id, score)]``, best first: the ``ef`` best nodes a walk over ``edges`` from ``entry`` finds.

    Every round looks at the neighbours of the best nodes that were not looked at yet,
    and the walk ends when they bring nothing better. The driver holds the beam and the
    names of visited nodes, never the graph; ids that have no point are passed over.
    """
    higher = higher_is_better(metric)

    def look(ids: list) -> list[tuple]:
        rows = points.where(F.col(id).isin(ids)).select(id, score(metric, F.col(vector), query_vector(q)).alias("s")).where("s is not null").collect()
        return [(r[0], r["s"]) for r in rows]

    order = lambda r: (-r[1] if higher else r[1], r[0])
    beam, seen, done = sorted(look([entry]), key=order), {entry}, set()
    for _ in range(most):
        todo = [n for n, _ in beam if n not in done]
        if not todo:
            break
        done.update(todo)
        ahead = {r["dst"] for r in edges.where(F.col("src").isin(todo)).select("dst").distinct().collect()} - seen
        seen |= ahead
        beam = sorted(beam + (look(list(ahead)) if ahead else []), key=order)[: max(ef, 1)]
    return beam


#: One more cell is looked into for so much of ``ef_search``.
EF_PER_CELL = 3


def learn_cells(x: np.ndarray, cells: int, spherical: bool, seed: int = 42, rounds: int = 25) -> np.ndarray:
    """Centres of k-means over the rows of a bounded sample; fewer rows than cells are their own centres."""
    if spherical:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    if len(x) <= cells:
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = _distance(x, centres, spherical).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=cells)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), cells)])
        if spherical:
            moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _distance(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    if spherical:
        return -(x @ centres.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return (x * x).sum(axis=1, keepdims=True) - 2 * x @ centres.T + (centres * centres).sum(axis=1)


class CellIndex:
    """Approximate search by cells: k-means centres fitted on a sample, every row in its cells.

    A row stands in its ``copies`` nearest cells, so a neighbour beyond a border is
    found from either side; ``homes`` names them, nearest first, and a query that looks
    into several of them takes the row once, in the first. Rows whose vector is not
    ``dim`` finite numbers stand in cell -1, which no search looks into.

    :meth:`build` writes the index below ``path``, partitioned by cell, and a search
    reads only the cells it looks into. Recall is measured, not assumed.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.metric, self.id, self.vector = Metric.of(head[0]["metric"]), head[0]["id"], head[0]["vector"]
        self.centres = np.array([r["centre"] for r in head if r["cell"] >= 0], dtype=np.float64).reshape(-1, head[0]["dim"])
        self.rows = spark.read.parquet(f"{path}/rows")

    @classmethod
    def build(cls, points: DataFrame, path: str | None = None, cells: int = 32, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector", keep: tuple[str, ...] = (), sample_rows: int = 8192, seed: int = 42, copies: int = 2) -> "CellIndex":
        """Fit on the ``sample_rows`` rows of smallest hash, then write every row."""
        spark, metric = points.sparkSession, Metric.of(metric)
        path = path or scratch_path(spark, "cells")
        spherical = metric is Metric.COSINE
        sample = points.where(F.size(vector) > 0).orderBy(F.xxhash64(id), id).limit(sample_rows).select(F.col(vector).cast("array<double>").alias("v")).toArrow().column(0).combine_chunks()
        sizes = np.asarray(pc.list_value_length(sample))
        dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
        x, bad = comparable(sample, dim) if len(sizes) else (np.zeros((0, 1)), np.zeros(0, bool))
        centres = learn_cells(x[~bad], cells, spherical, seed)
        kept = points.select(F.col(id).alias("id"), F.col(vector).alias("vector"), *keep)
        names = kept.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, dirty = comparable(batch.column(1), dim)
                n = min(copies, len(centres))
                homes = np.full((len(v), max(n, 1)), -1, np.int32)
                if n and len(v):
                    homes[~dirty] = np.argsort(_distance(v[~dirty], centres, spherical), axis=1, kind="stable")[:, :n]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, homes.size + 1, homes.shape[1], dtype=np.int32)), pa.array(homes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "homes"])

        schema = T.StructType([*kept.schema.fields, T.StructField("homes", T.ArrayType(T.IntegerType()))])
        placed = kept.mapInArrow(place, schema).withColumn("cell", F.explode(F.array_distinct("homes")))
        # a rebalanced exchange splits a cell that holds much of the table over several files
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        head = [(i, c.tolist(), metric.value, "id", "vector", dim) for i, c in enumerate(centres)] or [(-1, [], metric.value, "id", "vector", dim)]
        spark.createDataFrame(head, "cell int, centre array<double>, metric string, id string, vector string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells nearest to each row, nearest first."""
        return np.argsort(_distance(x, self.centres, self.metric is Metric.COSINE), axis=1, kind="stable")[:, :n]

    def probes(self, ef_search: int) -> int:
        """Cells to look into for a setting of ``ef_search``."""
        return min(max(-(-ef_search // EF_PER_CELL), 1), max(len(self.centres), 1))

    def candidates(self, q: list[float], nprobe: int) -> DataFrame:
        """The rows of the ``nprobe`` nearest cells, each once; other cells are not read."""
        probed = [int(i) for i in self.nearest(np.array([q], dtype=np.float64), nprobe)[0]] if len(self.centres) else []
        first = F.filter("homes", lambda c: c.isin(probed))[0]
        return self.rows.where(F.col("cell").isin(probed)).where(F.col("cell") == first)

    def search(self, q: list[float], k: int, nprobe: int = 8) -> DataFrame:
        return knn(self.candidates(q, nprobe), q, k, self.metric)

    def search_batch(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """``(qid, id, score, rank)`` for queries ``(qid, query)``.

        ``QUERY_BLOCK`` queries at a time meet the cells they look into as a matrix;
        queries that cannot be compared find nothing.
        """
        id_type, qid_type = self.rows.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
        schema = f"qid {qid_type}, id {id_type}, score double"
        asked = queries.select("qid", F.col("query").cast("array<double>").alias("query"))
        n, found = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for part in range(n):
            held = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == part).toArrow().combine_chunks()
            one = self._block(held, k, nprobe, schema, id_type, qid_type)
            found = one if found is None else found.unionByName(one)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(*best_first(self.metric), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _block(self, held: pa.Table, k: int, nprobe: int, schema: str, id_type: str, qid_type: str) -> DataFrame:
        if not held.num_rows or not len(self.centres):
            return self.spark.createDataFrame([], schema)
        q, bad = comparable(held.column("query").chunk(0), self.centres.shape[1])
        ids = held.column("qid").chunk(0).to_numpy(zero_copy_only=False)[~bad]
        q = q[~bad]
        probed = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(probed, self.nearest(q, nprobe), True, axis=1)
        metric, cells = self.metric, np.flatnonzero(probed.any(axis=0)).tolist()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        out = pa.schema([("qid", kinds[qid_type]), ("id", kinds[id_type]), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
                v, dirty = comparable(batch.column(1), q.shape[1])
                homes = batch.column(2).flatten().to_numpy().reshape(len(rows), -1)
                for c in np.unique(cell):
                    asks, at = np.flatnonzero(probed[:, c]), np.flatnonzero((cell == c) & ~dirty)
                    if not len(asks) or not len(at):
                        continue
                    looks = probed[asks][:, homes[at]]  # query, row, home
                    once = np.take_along_axis(homes[at][None], looks.argmax(axis=2)[:, :, None], axis=2)[:, :, 0] == c
                    same = np.zeros(len(at), np.int8)
                    for best in _best_rows(q[asks], v[at], ids[asks], rows[at], same[:1].repeat(len(asks)), same, np.zeros(len(asks), bool), np.zeros(len(at), bool), k, metric, False, once):
                        yield pa.RecordBatch.from_arrays([pa.array(best[f.name], f.type) for f in out], schema=out)

        return self.rows.where(F.col("cell").isin(cells)).select("id", "vector", "homes", "cell").mapInArrow(run, schema)


def lsh_knn(points: DataFrame, q: list[float], k: int, bucket_length: float = 0.5, tables: int = 8, id: str = "id", vector: str = "vector", seed: int = 42) -> DataFrame:
    """Approximate Euclidean search by bucketed random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = points.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(data)
    return model.approxNearestNeighbors(data, Vectors.dense(q), k, distCol="score").select(id, "score")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact ``(qid, id)`` rows that the approximate result has: ``(queries, recall)``."""
    hit = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return hit.agg(F.count_distinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
