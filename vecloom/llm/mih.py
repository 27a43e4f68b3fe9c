"""The most similar vectors of every vector, by multi-index hashing.

* Codes: iterative quantisation learns rotations from a sample; the signs of the
  rotated, centred vector are its code. Several rotations give the code as many
  bits as the recall asks for.
* Index: the code is cut into ``tables`` substrings of ``bits`` bits, and every row
  stands in the bucket of each of them. By the pigeonhole principle codes that differ
  in fewer than ``tables`` bits share a substring, so probing the substrings
  themselves retrieves every code within a Hamming radius of ``tables - 1``; codes
  up to ``radius`` bits away share one with a probability that the plan keeps above
  ``1 - MISS``. (Probing neighbouring substrings as well finds fewer pairs for the
  same number of index rows than further substrings do.)
* Filter: rows of a bucket are kept as pairs if their whole codes lie within
  ``radius`` bits, and if their vectors, rounded to a byte a dimension, can have the
  similarity asked for within the proven bound of the rounding. Of each row only
  partners that can be among its ``k`` best leave the bucket, and a pair leaves only
  the first bucket that it shares.
* Rerank: the few pairs left are joined with the float vectors, once.

``bits`` follows the logarithm of the largest collection, so buckets keep their
size as tables grow; ``tables`` and ``radius`` follow from ``bits``, the flips and
``MISS``. The flips are those of centred vectors, measured on sampled rows and
vectors at the threshold from them. Every row is indexed and every row is a query.
Copies of one vector count with all members; among equal similarities smaller ids
come first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, by_block, byte_column, hot_keys, sides, tiled, vectors
from ..operators.search import knn_batch
from ..runtime import materialize, spread
from .vectors import DIM, Classes, unit, valid_points

#: Probability that a pair just at the threshold is missed, over the sampled rows:
#: half for meeting in no bucket, half for a code beyond the radius.
MISS = 5e-4
#: Tables above which substrings are shortened.
MOST_TABLES = 256
#: Rows of an average bucket, as a power of two.
BUCKET = 8
_ROUNDS = 30


def learn_rotations(sample: np.ndarray, count: int, dim: int = DIM, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, rotations)``: orthogonal matrices that bring the sample near the corners of a cube."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    z, out = sample - mean, []
    for i in range(count):
        r = np.linalg.qr(np.random.default_rng(seed + i).standard_normal((dim, dim)))[0]
        for _ in range(_ROUNDS if len(sample) >= dim else 0):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        out.append(r)
    return mean, np.stack(out)


def centred_flips(sample: np.ndarray, least: float, seed: int = 42) -> np.ndarray:
    """Share of bits in which each sampled row differs from a vector at cosine ``least``, both centred."""
    away = np.random.default_rng(seed).standard_normal(sample.shape)
    away -= (away * sample).sum(axis=1, keepdims=True) * sample
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    mean = sample.mean(axis=0)
    a, b = sample - mean, least * sample + math.sqrt(1 - least * least) * away - mean
    scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cosine = np.divide((a * b).sum(axis=1), scale, out=np.zeros(len(a)), where=scale > 0)
    return np.arccos(np.clip(cosine, -1, 1)) / math.pi


def table_plan(rows: int, least: float, miss: float = MISS, flips: np.ndarray | None = None) -> tuple[int, int]:
    """``(bits, tables)`` for the largest collection's rows and the least similarity.

    ``flips`` are measured rates; without them those of vectors that are not centred count.
    """
    flips = _rates(least, flips)
    bits = max(4, round(math.log2(max(rows, 2))) - BUCKET)

    def lost(bits: int, tables: int) -> bool:
        return ((1 - (1 - flips) ** bits) ** tables).mean() > miss / 2

    while bits > 1 and lost(bits, MOST_TABLES):
        bits -= 1  # wide angles: larger buckets instead of ever more tables
    return bits, next((t for t in range(1, MOST_TABLES) if not lost(bits, t)), MOST_TABLES)


def code_radius(length: int, least: float, miss: float = MISS, flips: np.ndarray | None = None) -> int:
    """Bits in which codes of ``length`` bits may differ: a vector at ``least`` differs in more with at most ``miss / 2``."""
    flips = _rates(least, flips)
    within, radius = np.zeros(len(flips)), -1
    while radius < length and (1 - within).mean() > miss / 2:
        radius += 1
        ways = math.lgamma(length + 1) - math.lgamma(radius + 1) - math.lgamma(length - radius + 1)
        within += np.exp(ways + radius * np.log(np.maximum(flips, 1e-300)) + (length - radius) * np.log1p(-flips))
    return radius


def _rates(least: float, flips: np.ndarray | None) -> np.ndarray:
    return np.full(1, math.acos(least) / math.pi) if flips is None or not len(flips) else np.minimum(flips, 1 - 1e-9)


def _code_kind(bits: int):
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def _codes(mean: np.ndarray, rotations: np.ndarray, bits: int, tables: int, dim: int):
    """Substrings of the codes of unit vectors, one column a table."""
    each = dim // bits
    picks = [np.random.default_rng(7 + t // each).permutation(dim)[(t % each) * bits : (t % each + 1) * bits] for t in range(tables)]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def run(x: np.ndarray) -> np.ndarray:
        z = x - mean
        out = np.empty((len(x), tables), _code_kind(bits))
        for r, rotation in enumerate(rotations):
            on = (z @ rotation) > 0
            for t in range(r * each, min((r + 1) * each, tables)):
                out[:, t] = on[:, picks[t]].astype(np.uint64) @ weights
        return out

    return run


def round_down(x: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of bytes: a byte a dimension, then scale and length of the rounding error."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    low = np.rint(x / scale).astype(np.int8)
    error = np.linalg.norm(x - low * scale.astype(np.float32), axis=1, keepdims=True)
    return np.hstack([low.view(np.uint8), scale.astype(np.float32).view(np.uint8), np.nextafter(error.astype(np.float32), np.float32(2)).view(np.uint8)])


def _rounded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tail = np.ascontiguousarray(rows[:, -8:]).view(np.float32)
    return np.ascontiguousarray(rows[:, :-8]).view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]


def _bucket_work(k: int, least: float, bits: int, radius: int):
    """Pairs ``(pid, other)`` of a bucket that can be among the best ``k``, each from its first common bucket only."""
    kind = _code_kind(bits)

    def work(cols: dict) -> Iterator[dict]:
        a, b, same = sides(cols)
        pid, key, table, code = cols["pid"], cols["key"], cols["t"], cols["code"].view(kind)
        x, error = _rounded(cols["low"])
        # products of single precision are off by far less than this
        widest = least - 2.1 * float(error.max()) - 1e-5
        for left, right in ((a, b),) if same else ((a, b), (b, a)):
            for s in range(0, len(left), 1024):
                part = left[s : s + 1024]
                near = x[part] @ x[right].T
                i, j = np.nonzero(near >= widest)
                cos = near[i, j].astype(np.float64)
                i, j = part[i], right[j]
                slack = error[i] + error[j] * (1.0 + error[i]) + 1e-5
                keep = (cos + slack >= least) & (i != j) & (key[i] == key[j])
                i, j, cos, slack = i[keep], j[keep], cos[keep], slack[keep]
                apart = code[i] ^ code[j]
                keep = np.bitwise_count(apart).sum(axis=1, dtype=np.int32) <= radius
                i, j, cos, slack, apart = i[keep], j[keep], cos[keep], slack[keep], apart[keep]
                if not len(i):
                    continue
                order = np.lexsort((slack - cos, i))
                i, j, cos, slack, apart = i[order], j[order], cos[order], slack[order], apart[order]
                first = np.searchsorted(i, i, side="left")
                kth = np.minimum(first + k - 1, len(i) - 1)
                # whoever is surely below k others of this bucket is not among the best k
                keep = (i[kth] != i) | (cos + slack >= cos[kth] - slack[kth])
                keep &= (apart == 0).argmax(axis=1) == table[i]
                yield {"pid": pid[i[keep]], "other": pid[j[keep]]}

    return work


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        exact = np.einsum("ij,ij->i", unit(vectors(batch.column(2))), unit(vectors(batch.column(3)))) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact)], names=["pid", "other", "cosine"])


def neighbours(points: DataFrame, k: int = 5, least: float = 0.95, dim: int = DIM, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """``(collection_name, id, other, cosine, rank)``: of the ``k`` most similar points of each point, those of cosine ``least`` or more."""
    classes = Classes(points, dim)
    reps = classes.reps
    largest = reps.groupBy("collection_name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sample = classes.sample()
    # few rows say little about angles, and their mean may be one of them
    flips = centred_flips(sample, least) if len(sample) >= dim else None
    bits, tables = table_plan(largest, least, miss, flips)
    bits = min(bits, dim)
    radius = code_radius(bits * tables, least, miss, flips)
    coder = _codes(*learn_rotations(sample, math.ceil(tables / (dim // bits)), dim), bits, tables, dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(vectors(batch.column(2))) if batch.num_rows else np.zeros((0, dim))
            codes = coder(x)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * tables + 1, tables, dtype=np.int32)), pa.array(codes.astype(np.uint64).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts, byte_column(codes), byte_column(round_down(x))], names=["pid", "collection_name", "parts", "code", "low"])

    coded = spread(reps.select("pid", "collection_name", "vector")).mapInArrow(encode, "pid bigint, collection_name string, parts array<bigint>, code binary, low binary")
    coded = materialize(coded, "codes")
    key = F.xxhash64("collection_name", "t", "part").alias("key")
    slots = coded.select("pid", "collection_name", "code", "low", F.posexplode("parts").alias("t", "part")).select(key, "pid", "t", "code", "low")
    keys = coded.select("collection_name", F.posexplode("parts").alias("t", "part")).select(key)
    found = by_block(tiled(slots, hot_keys(keys, block), block), _bucket_work(k, least, bits, radius), "pid bigint, other bigint", merge=256)
    mine = reps.select("pid", "collection_name", "vector")
    theirs = reps.select(F.col("pid").alias("other"), F.col("collection_name").alias("theirs"), F.col("vector").alias("their_vector"))
    both = found.join(mine, "pid").join(theirs, "other").where("collection_name = theirs").select("pid", "other", "vector", "their_vector")
    ranked = both.mapInArrow(_cosines, "pid bigint, other bigint, cosine double").where(F.col("cosine") >= least)
    return _members(classes, ranked, k)


def _members(classes: Classes, found: DataFrame, k: int) -> DataFrame:
    """From classes to points: of each class the ``k + 1`` smallest ids can be among the best."""
    top = found.withColumn("r", F.rank().over(Window.partitionBy("pid").orderBy(F.desc("cosine")))).where(F.col("r") <= k).select("pid", "other", "cosine")
    own = classes.reps.where("weight > 1").select("pid", F.col("pid").alias("other"), F.lit(1.0).alias("cosine"))
    links = top.unionByName(own)
    me = classes.members.select("pid", "collection_name", "id")
    them = classes.first_members(k + 1).select(F.col("pid").alias("other"), F.col("id").alias("other_id"))
    full = links.join(me, "pid").join(them, "other").where("id <> other_id")
    rank = F.row_number().over(Window.partitionBy("collection_name", "id").orderBy(F.desc("cosine"), "other_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("collection_name", "id", F.col("other_id").alias("other"), "cosine", "rank")


def similar_pairs(points: DataFrame, k: int = 5, least: float = 0.95, **options) -> DataFrame:
    """``(collection_name, id_a, id_b)``: pairs where either is among the ``k`` best of the other."""
    n = neighbours(points, k, least, **options)
    return n.select("collection_name", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def measured_recall(points: DataFrame, k: int = 5, least: float = 0.95, every: int = 50, **options) -> DataFrame:
    """``(collection_name, queries, exact, found, recall)``: the index against brute force.

    Queries are the points whose id hashes to a multiple of ``every``; each is compared
    with all points of its collection, in blocks. ``recall`` is null without neighbours.
    """
    name = F.concat_ws("\x00", "collection_name", "id").alias("name")
    valid = materialize(valid_points(points, options.get("dim", DIM)).select(name, "collection_name", "vector"), "recall-points")
    asked = valid.where(F.pmod(F.xxhash64("name"), F.lit(every)) == 0)
    queries = asked.select(F.col("name").alias("qid"), F.col("vector").alias("query"), "collection_name")
    exact = knn_batch(valid, queries, k, "COSINE", id="name", exclude_self=True, group="collection_name").where(F.col("score") >= least)
    index = neighbours(points, k, least, **options).select(F.concat_ws("\x00", "collection_name", "id").alias("qid"), F.concat_ws("\x00", "collection_name", "other").alias("id"), F.lit(1).alias("hit"))
    met = exact.select("qid", "id").join(index, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    joined = queries.select("qid", "collection_name").join(met, "qid", "left")
    sums = joined.groupBy("collection_name").agg(F.count("*").alias("queries"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    return sums.withColumn("recall", F.col("found") / F.nullif(F.col("exact"), F.lit(0)))
