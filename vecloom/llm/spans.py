"""Long verbatim pieces shared between records.

Method: MinHash banding needs paragraphs, and a verbatim piece may begin anywhere, so
this is its limit for pieces: every run of ``span`` characters counts as a paragraph.

* A *paragraph* is any run of ``span`` consecutive code points, so a copy is seen
  wherever it starts, and its shingles are the ``shingle``-character strings in it.
* Its MinHash under one permutation is the smallest shingle hash in it. A common
  piece of ``span`` characters is the same paragraph on both sides, of Jaccard
  similarity 1, so one band of one row already collides with certainty: the
  bands are tuned to recall 1 for verbatim pieces. Overlapping paragraphs mostly
  share their minimum, which leaves about ``2 / (span - shingle + 2)`` signatures
  a character.
* Colliding paragraphs are joined by signature and verified on the characters
  themselves: the collision is checked and extended to both sides.
* Texts that are equal as a whole are one class from the start and take part once.

Results: null, empty and shorter texts share nothing; repeats inside one record
do not count; rows with the same key and text are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import hot_keys, tiled
from ..operators.components import connected_components
from ..runtime import drop_table, materialize, spread

SPAN = 300
#: Shingles nearly as long as the span keep collisions of shorter boilerplate out.
SHINGLE = 236
#: Pages of one piece that meet in one task.
TILE = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-character window, as differences of one running sum mod 2**64."""
    base = np.uint64(0xD6E8FEB86659FD93)
    n = len(codes)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64)) * _powers(n, base), out=running[1:])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return _mix((running[k:] - running[:-k]) * _powers(n - k + 1, inverse))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def signatures(text: str, span: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, minhash)`` of the distinct paragraph minima of one text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < span:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    hashes = shingle_hashes(codes, shingle)
    low = sliding_min(hashes, span - shingle + 1)
    picked = np.unique(low[np.concatenate(([True], low[1:] != low[:-1]))])
    at = np.flatnonzero(np.isin(hashes, picked))
    at = ends_of_repeats(at, hashes[at], shingle)
    return at.astype(np.int32), hashes[at].view(np.int64)


def ends_of_repeats(at: np.ndarray, hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Of places where one string repeats at even, overlapping distances the first two and the last two.

    Such a stretch is periodic. A common piece that leaves it on a side has its first
    (last) place on both sides there; one that lies inside it on both sides is found,
    in full length, from the first or second place of one and the first of the other,
    or from their last ones. So a stretch of any length costs four signatures.
    """
    if len(at) < 5:
        return at
    order = np.lexsort((at, hashes))
    a, h = at[order], hashes[order]
    gap = np.where((h[1:] == h[:-1]) & (a[1:] - a[:-1] <= shingle), a[1:] - a[:-1], 0)
    even = np.zeros(len(a), bool)  # the same gap on both sides
    even[1:-1] = (gap[1:] == gap[:-1]) & (gap[1:] > 0)
    # inside a stretch, and not the second from either end of it
    inner = np.zeros(len(a), bool)
    inner[2:-2] = even[1:-3] & even[2:-2] & even[3:-1]
    return np.sort(a[~inner])


def paragraph_signatures(texts: DataFrame, span: int, shingle: int) -> DataFrame:
    """``(rep, pos, sig)`` for every row ``(rep, text)``; one Arrow pass, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, counts, at, sig = batch.column(0), [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for text in batch.column(1).to_pylist():
                a, s = signatures(text, span, shingle)
                counts.append(len(a))
                at.append(a)
                sig.append(s)
            rows = pa.array(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
            yield pa.RecordBatch.from_arrays([reps.take(rows), pa.array(np.concatenate(at)), pa.array(np.concatenate(sig))], names=["rep", "pos", "sig"])

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.select("rep", "text").mapInArrow(run, f"rep {kind}, pos int, sig bigint")


def _common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two strings of at most ``most`` characters, by halving."""
    steps = [1 << i for i in range(most.bit_length() - 1, -1, -1)] if most else []

    def longer(found: Column, step: Column) -> Column:
        fits = F.least(F.length(a), F.length(b)) >= found + step
        return F.when(fits & (F.substring(a, F.lit(1), found + step) == F.substring(b, F.lit(1), found + step)), found + step).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), longer) if steps else F.lit(0)


class SharedSpans:
    """Classes of equal texts, and verified links between texts that differ."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, shingle: int = SHINGLE, tile: int = TILE):
        if not 1 < shingle <= span:
            raise ValueError("shingle must lie between 2 and span")
        self.span, self.shingle, self.tile = span, shingle, tile
        rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= span)
        digest = F.sha2(F.col("text"), 256)
        rows_of_text = rows.select("key", digest.alias("digest")).distinct()
        #: One row a record: its class is the smallest key with the same text.
        reps = rows_of_text.groupBy("digest").agg(F.min("key").alias("rep"))
        self.members = materialize(rows_of_text.join(reps, "digest").select("key", "rep"), "span-members")
        self.rows = rows

    def _texts(self) -> DataFrame:
        """One row for each different text, found without shuffling the texts."""
        reps = self.members.where("key = rep").select("rep")
        return self.rows.withColumnRenamed("key", "rep").join(reps, "rep", "left_semi")

    def links(self) -> DataFrame:
        """``(a, b, pos_a, pos_b, length)``: verified common pieces of at least ``span``
        characters between different texts, each grown to both sides up to ``span`` beyond
        the collision; ``a < b`` are class keys."""
        span, k = self.span, self.shingle
        reach = span - k
        sigs = paragraph_signatures(spread(self.rows.withColumnRenamed("key", "rep")), span, k)
        # only one record of a class speaks for it
        sigs = sigs.join(self.members.where("key = rep").select("rep"), "rep", "left_semi").distinct()
        sigs = materialize(sigs, "span-signatures")
        shared = sigs.groupBy("sig").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("sig")
        hits = sigs.join(shared, "sig", "left_semi")
        texts = self.rows.withColumnRenamed("key", "rep")
        piece = hits.join(texts, "rep").where(F.length("text") >= F.col("pos") + k).select(
            "rep", "pos", "sig",
            F.sha2(F.substring("text", F.col("pos") + 1, F.lit(k)), 256).alias("digest"),
            F.reverse(F.substring("text", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)))).alias("left"),
            F.substring("text", F.col("pos") + k + 1, F.lit(reach)).alias("right"),
        ).dropDuplicates(["rep", "pos", "sig"])
        piece = materialize(piece.withColumn("key", F.xxhash64("digest")).withColumn("pid", F.xxhash64("rep")), "span-pieces")
        drop_table(sigs)
        # a piece that stands on very many pages is many tasks: a pair of tiles each
        piece = tiled(piece, hot_keys(piece.select("key"), self.tile), self.tile)
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "lo", "hi", "digest")]
        apart = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.tile") != F.col("y.tile"))
        both = piece.alias("x").join(piece.alias("y"), [*same, apart, F.col("x.rep") < F.col("y.rep")])
        before = _common_prefix(F.col("x.left"), F.col("y.left"), reach)
        after = _common_prefix(F.col("x.right"), F.col("y.right"), reach)
        grown = both.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.pos").alias("pos_x"), F.col("y.pos").alias("pos_y"), before.alias("l"), after.alias("r"))
        return grown.where(F.col("l") + F.col("r") >= reach).select("a", "b", (F.col("pos_x") - F.col("l")).alias("pos_a"), (F.col("pos_y") - F.col("l")).alias("pos_b"), (F.col("l") + F.col("r") + k).alias("length"))

    def pairs(self) -> DataFrame:
        """``(key_a, key_b)`` of records, copies written out: what a list of pairs asks for."""
        m = self.members
        between = self.links().select("a", "b").distinct()
        copies = m.select("rep").where("key <> rep").distinct().select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        left = between.unionByName(copies).join(m.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a")
        full = left.join(m.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b")
        return full.where("a <> b or ka < kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))

    def coverage(self) -> DataFrame:
        """``(key, class_id, cluster_id, copies, links, shared_chars, n_chars)``: one row a
        record that shares anything; copies count as shared whole and are not written out."""
        links = materialize(self.links(), "span-links")
        sides = links.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("pos_a").alias("pos"), "length").unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other"), F.col("pos_b").alias("pos"), "length"))
        degree = sides.groupBy("rep").agg(F.count_distinct("other").alias("links"))
        spans = sides.select("rep", "pos", "length").distinct()
        reach = F.max(F.col("pos") + F.col("length")).over(_by("rep").orderBy("pos", "length").rowsBetween(-(1 << 31), -1))
        new = F.greatest(F.col("pos") + F.col("length") - F.greatest(F.col("pos"), F.coalesce(reach, F.lit(0))), F.lit(0))
        covered = spans.withColumn("new", new).groupBy("rep").agg(F.sum("new").alias("part_chars"))
        clusters = connected_components(links.select("a", "b").distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster_id"))
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("n"))
        lengths = self.rows.select("key", F.length("text").cast("bigint").alias("n_chars")).distinct()
        return (
            self.members.join(sizes, "rep").join(degree, "rep", "left").join(covered, "rep", "left").join(clusters, "rep", "left").join(lengths, "key")
            .where("n > 1 or links is not null")
            .select("key", F.col("rep").alias("class_id"), F.coalesce("cluster_id", "rep").alias("cluster_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
                    F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.col("part_chars")).cast("bigint").alias("shared_chars"), "n_chars")
        )


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)
