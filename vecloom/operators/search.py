"""Top-k similarity search: one query, filtered, segmented, and many queries at once.

One query is a projection and a sort with a limit, which Spark runs as a
``TakeOrderedAndProject``: each partition keeps its k best, and only those meet.
Many queries go through Arrow in blocks: a partition multiplies its vectors with
the query matrix, keeps its k best of each query and shuffles only those.

Ties go to the smaller id. ``k = 0`` and an empty table give no rows, a ``k`` above
the number of rows gives all of them. A vector that cannot be compared with the query
(null, of another length, with an element that is null or not finite) has a null score
and comes after all others, in every path.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, best_first, finite, norm, score
from ..functions.payload import matches
from ..schema import InvalidArgument
from .blocks import BLOCK, by_block

#: How many rows a filtered search of the post mode looks at.
OVERFETCH_FACTOR, OVERFETCH_EXTRA, OVERFETCH_CAP = 5, 50, 1000
#: Fixed value: what each segment returns beyond k.
SEGMENT_EXTRA = 10
#: Queries of one block: their matrix travels to the workers, so its size is bounded.
QUERY_BLOCK = 4096
#: Queries that may meet every point as columns.
COLUMN_QUERIES = 64


class DimensionMismatch(InvalidArgument, ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"Dimension mismatch: expected {expected}, got {actual}")


def query_vector(q: list[float], dim: int | None = None) -> Column:
    if not q:
        raise ValueError("Query vector cannot be empty")
    if dim is not None and len(q) != dim:
        raise DimensionMismatch(dim, len(q))
    return F.array(*[F.lit(float(x)) for x in q])


def overfetch(k: int) -> int:
    return min(max(OVERFETCH_FACTOR * k, k + OVERFETCH_EXTRA), OVERFETCH_CAP)


def scored(points: DataFrame, q: list[float], metric: Metric | str = "COSINE", vector: str = "vector") -> DataFrame:
    return points.withColumn("score", score(metric, F.col(vector), query_vector(q)))


def knn(points: DataFrame, q: list[float], k: int, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, score, *keep)`` of the ``k`` best points, best first."""
    return scored(points, q, metric, vector).select(id, "score", *keep).orderBy(*best_first(metric), id).limit(max(k, 0))


def knn_filtered(points: DataFrame, q: list[float], k: int, must_match: dict[str, Any] | None, metric: Metric | str = "COSINE", mode: str = "pre", id: str = "id", vector: str = "vector", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Search among points whose payload matches every key.

    ``pre`` filters below the sort and is complete. ``post`` looks only at the best
    ``overfetch(k)`` rows and may return fewer than ``k``. No or an empty filter is
    a plain search.
    """
    test = matches(F.col(payload), must_match)
    if test is None:
        return knn(points, q, k, metric, id, vector, keep)
    if mode == "pre":
        return knn(points.where(test), q, k, metric, id, vector, keep)
    if mode != "post":
        raise ValueError("mode is 'pre' or 'post'")
    extra = tuple(dict.fromkeys((*keep, payload)))
    return knn(points, q, overfetch(k), metric, id, vector, extra).where(test).orderBy(*best_first(metric), id).limit(max(k, 0)).select(id, "score", *keep)


def knn_segments(points: DataFrame, q: list[float], k: int, segment: str, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector") -> DataFrame:
    """The best ``k + SEGMENT_EXTRA`` of every segment, gathered and cut to ``k``."""
    best = Window.partitionBy(segment).orderBy(*best_first(metric), id)
    each = scored(points, q, metric, vector).select(id, segment, "score").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + SEGMENT_EXTRA)
    return each.select(id, segment, "score").orderBy(*best_first(metric), id).limit(max(k, 0))


def knn_batch(points: DataFrame, queries: DataFrame, k: int, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector", qid: str = "qid", query: str = "query", exclude_self: bool = False, group: str | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` best points of every query.

    With ``group``, a column of both sides, only points of the query's group count.

    Up to ``QUERY_BLOCK`` queries travel to the partitions of the points as a matrix.
    More are cut into tiles like the points, and every pair of tiles is a task; neither
    side is collected. A task returns at most ``k`` rows a query (and ties of the last).
    """
    metric = Metric.of(metric)
    if not isinstance(metric, Metric):
        raise ValueError(f"{metric.value} is scored by columns: use knn or knn_batch_columns")
    id_type, qid_type = points.schema[id].dataType.simpleString(), queries.schema[qid].dataType.simpleString()
    own = F.lit(0).cast("bigint") if group is None else F.xxhash64(group)
    base = points.select(F.col(id).alias("id"), F.col(vector).alias("vector"), own.alias("grp"))
    asked = queries.select(F.col(qid).alias("qid"), F.col(query).cast("array<double>").alias("query"), own.alias("grp"))
    held = asked.limit(QUERY_BLOCK + 1).toArrow()
    if held.num_rows <= QUERY_BLOCK:
        schema = f"qid {qid_type}, id {id_type}, score double"
        found = base.mapInArrow(_block_knn(held, k, metric, exclude_self, id_type, qid_type), schema) if held.num_rows else points.sparkSession.createDataFrame([], schema)
    else:
        found = _tile_knn(base, asked, k, metric, exclude_self, id_type, qid_type)
    found = found.withColumn("score", finite(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*best_first(metric), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _tile_knn(points: DataFrame, queries: DataFrame, k: int, metric: Metric, exclude_self: bool, id_type: str, qid_type: str) -> DataFrame:
    """Tiles of queries against tiles of points; a tile pair is one group of at most two tiles of rows."""
    q_tiles, p_tiles = -(-queries.count() // BLOCK), max(1, -(-points.count() // BLOCK))
    # one job a length of queries, which is one job; null queries compare with nothing
    sizes = [r[0] for r in queries.select(F.size("query")).distinct().collect()]
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filler = lambda kind: F.lit(0).cast(kind)

    def work(cols: dict) -> Iterator[dict]:
        asks = cols["asks"] == 1
        if not asks.any() or asks.all():
            return
        at, to = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, bad = cols["vector"], cols["bad"].astype(bool)
        yield from _best_rows(x[at], x[to], cols["qid"][at], cols["id"][to], cols["grp"][at], cols["grp"][to], bad[at], bad[to], k, metric, exclude_self)

    found = None
    for size in sizes:
        dim = max(size or 0, 1)
        plain = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        row = lambda c: (F.when(F.coalesce(plain(F.col(c)), F.lit(False)), F.col(c).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector"), F.when(F.coalesce(plain(F.col(c)), F.lit(False)), 0).otherwise(1).alias("bad"))
        left = points.select(tile("id", p_tiles).alias("hi"), every(q_tiles).alias("lo"), "id", filler(qid_type).alias("qid"), *row("vector"), F.lit(0).alias("asks"), "grp")
        right = queries.where(F.size("query").eqNullSafe(size)).select(every(p_tiles).alias("hi"), tile("qid", q_tiles).alias("lo"), filler(id_type).alias("id"), "qid", *row("query"), F.lit(1).alias("asks"), "grp")
        rows = left.unionByName(right).withColumn("key", F.lit(0).cast("bigint"))
        one = by_block(rows, work, f"qid {qid_type}, id {id_type}, score double")
        found = one if found is None else found.unionByName(one)
    return found


def comparable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix of ``dim`` columns, and which rows are no ``dim`` finite numbers (zeros there)."""
    good = np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dim
    kept = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite_rows = np.isfinite(kept).all(axis=1)
    good[good] = finite_rows
    out = np.zeros((len(column), dim))
    out[good] = kept[finite_rows]
    return out, ~good


def _best_rows(q: np.ndarray, x: np.ndarray, qids: np.ndarray, ids: np.ndarray, q_group: np.ndarray, x_group: np.ndarray, q_bad: np.ndarray, x_bad: np.ndarray, k: int, metric: Metric, exclude_self: bool, allowed: np.ndarray | None = None) -> Iterator[dict]:
    """The ``k`` best rows of ``x`` for each row of ``q``, with the ties of the last.

    Rows that cannot be compared stand in, without a score, only where fewer than ``k`` others are here.
    """
    if k <= 0 or not len(x):
        return
    x_norm = np.sqrt((x * x).sum(axis=1))
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        if metric is Metric.COSINE:
            scale = np.sqrt((part * part).sum(axis=1))[:, None] * x_norm[None, :]
            score = np.clip(np.divide(part @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0), -1, 1)
            good = score
        else:
            # differences, not the expanded square: exact for equal vectors
            score = np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in part])
            good = -score
        may = q_group[s : s + 512, None] == x_group[None, :]
        if allowed is not None:
            may &= allowed[s : s + 512]
        if exclude_self:
            may &= qids[s : s + 512, None] != ids[None, :]
        bad = q_bad[s : s + 512, None] | x_bad[None, :]
        good = np.where(may & ~bad, good, -np.inf)
        take = min(k, good.shape[1])
        # a small margin keeps ties of the last place for the exact ranking above
        edge = np.partition(good, good.shape[1] - take, axis=1)[:, good.shape[1] - take]
        i, j = np.nonzero((good >= edge[:, None] - 1e-12) & np.isfinite(good))
        yield {"qid": qids[s + i], "id": ids[j], "score": score[i, j]}
        for row in np.flatnonzero((may & bad).any(axis=1) & (np.isfinite(good).sum(axis=1) < k)):
            rest = np.sort(ids[may[row] & bad[row]])[:k]
            yield {"qid": np.repeat(qids[s + row : s + row + 1], len(rest)), "id": rest, "score": np.full(len(rest), np.nan)}


def _block_knn(queries: pa.Table, k: int, metric: Metric, exclude_self: bool, id_type: str, qid_type: str):
    queries = queries.combine_chunks()
    ids, groups, lists = (queries.column(c).chunk(0) for c in ("qid", "grp", "query"))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("qid", kinds[qid_type]), ("id", kinds[id_type]), ("score", pa.float64())])
    ids, groups = ids.to_numpy(zero_copy_only=False), groups.to_numpy(zero_copy_only=False)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    parts = [(max(int(d), 1), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]
    parts = [(d, at, *comparable(lists.take(pa.array(at)), d)) for d, at in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at_id, grp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for d, at, q, q_bad in parts:
                x, x_bad = comparable(batch.column(1), d)
                for best in _best_rows(q, x, ids[at], at_id, groups[at], grp, q_bad, x_bad, k, metric, exclude_self):
                    yield pa.RecordBatch.from_arrays([pa.array(best[f.name], f.type) for f in schema], schema=schema)

    return run


def knn_batch_columns(points: DataFrame, queries: DataFrame, k: int, metric: Metric | str = "COSINE", id: str = "id", vector: str = "vector") -> DataFrame:
    """The same result by column expressions, for ``COLUMN_QUERIES`` queries ``(qid, query)`` at most; more go in blocks."""
    if queries.limit(COLUMN_QUERIES + 1).count() > COLUMN_QUERIES:
        return knn_batch(points, queries, k, metric, id, vector)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*best_first(metric), "id"))
    pairs = points.select(F.col(id).alias("id"), F.col(vector).alias("vector")).join(F.broadcast(queries))
    return pairs.select("qid", "id", score(metric, F.col("vector"), F.col("query")).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def enrich(results: DataFrame, points: DataFrame, id: str = "id", with_payload: bool = True, with_vector: bool = False) -> DataFrame:
    """Payload, vector and version of search results, by id; the version always comes."""
    wanted = ["version", *["payload"] * with_payload, *["vector"] * with_vector]
    return results.join(points.select(id, *[c for c in wanted if c in points.columns]), id, "left")


def highlight(sample: DataFrame, results: DataFrame, id: str = "id", selected: str | None = None) -> DataFrame:
    """Sampled points with ``score``, ``is_hit`` and the marker style that applies."""
    joined = sample.join(results.select(id, "score"), id, "left")
    chosen = F.lit(False) if selected is None else F.col(id) == selected
    style = F.when(chosen, "selected").when(F.col("score").isNotNull(), "hit").otherwise("default")
    return joined.withColumn("is_hit", F.col("score").isNotNull()).withColumn("style", style)


def with_norm(points: DataFrame, vector: str = "vector") -> DataFrame:
    return points.withColumn("norm", norm(F.col(vector)))
