"""Evaluation passages inside corpus documents.

Method: a prefix-filtered set join. Shingles are short word sequences (two words,
three where two are short) written without the space between them, in folded
letters, so joined, split and misread words mostly leave them intact.

1. One pass over the documents finds which of the items' shingles stand in each:
   a row a document and shingle, however many items hold the shingle.
2. Shingles are ordered by rarity, counted over all documents. In every window of
   ``min_words`` passage words, a document that shares ``overlap`` shingles must
   share one of all but the ``overlap - 1`` commonest. Only those prefix shingles
   are joined with the documents' rows, and make the candidates.
3. Length bound: a recogniser loses at most a letter in four of a word, so a document
   with fewer letters than that leaves of the shortest window holds none. Positional
   bound: the shared shingles must lie in one window.
4. Candidates are verified on the words of the whole document: a run of
   ``min_words`` consecutive passage words, grown from the shared shingles through
   misreadings, joined, split and hyphenated words and foreign lines (see
   :mod:`.leak_text`). Only the texts of candidates move.

Items, windows and passages are tables. What travels to all workers is the set of
shingle strings, cut into slices of ``SLICE`` counted strings; each slice is a pass.

Defined cases: null and empty texts or passages match nothing, nor do passages
of fewer than ``min_words`` words; repeated rows give one result; an item with
several passages is leaked by any of them; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, drop_table, materialize, spread
from .leak_text import Page, longest_run, passage_words, places, shingles

MIN_WORDS = 13
OVERLAP = 2
#: Shingle strings, some 50 bytes each, that one pass looks for.
SLICE = 500_000
#: Letters of a word that survive misreading, at least.
SURVIVE = 0.75

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def passage_shingles(passages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(unit, at, size, letters, windows, least)`` of every passage ``(unit, passage)`` that is long enough.

    ``windows`` is the number of its windows, ``least`` the letters of the shortest one.
    """
    names, kinds = ("unit", "at", "size", "letters", "windows", "least"), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = passage_words(text)
                windows = len(words) - min_words + 1
                if windows > 0:
                    least = min(sum(map(len, words[i : i + min_words])) for i in range(windows))
                    rows += [(unit, at, size, letters, windows, least) for at, size, letters in shingles(words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return passages.select("unit", "passage").mapInArrow(run, "unit bigint, at int, size int, letters string, windows int, least int")


def shingle_hits(documents: DataFrame, wanted: DataFrame, key_type: str) -> DataFrame:
    """``(doc, shingle, letters)``: which of the ``wanted`` shingles ``(shingle, string)`` stand in each document. Map-only."""
    spark, out = documents.sparkSession, None
    slices = max(1, -(-wanted.count() // SLICE))
    for part in range(slices):
        rows = wanted.where(F.pmod("shingle", F.lit(slices)) == part).toArrow()
        strings = spark.sparkContext.broadcast(dict(zip(rows.column("string").to_pylist(), rows.column("shingle").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], strings=strings) -> Iterator[pa.RecordBatch]:
            ids = strings.value
            for batch in batches:
                rows, found, sizes = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    page = Page(text)
                    words, here = page.words, set()
                    for start, end in zip(page.starts, page.ends):
                        for i in range(start, end + 1):
                            letters = ""
                            for w in words[i : min(i + 4, end + 1)]:
                                letters += w
                                if letters in ids:
                                    here.add(ids[letters])
                    if here:
                        rows += [row] * len(here)
                        found += here
                        sizes += [sum(map(len, words))] * len(here)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, pa.int64()), pa.array(sizes, pa.int64())], names=["doc", "shingle", "letters"])

        one = spread(documents).mapInArrow(run, f"doc {key_type}, shingle bigint, letters bigint")
        out = one if out is None else out.unionByName(one)
    return out


def prefix_shingles(own: DataFrame, rarity: DataFrame, overlap: int = OVERLAP, min_words: int = MIN_WORDS) -> DataFrame:
    """``(unit, shingle)`` that can make a candidate: of each window all but the ``overlap - 1`` commonest that occur."""
    first = F.explode(F.sequence(F.greatest(F.col("at") + F.col("size") - min_words, F.lit(0)), F.least("at", F.col("windows") - 1)))
    ranked = own.where(F.least("at", F.col("windows") - 1) >= F.greatest(F.col("at") + F.col("size") - min_words, F.lit(0))).join(rarity, "shingle")
    commonest = F.row_number().over(Window.partitionBy("unit", "window").orderBy(F.desc("docs"), F.desc("at")))
    return ranked.withColumn("window", first).withColumn("k", commonest).where(F.col("k") >= overlap).select("unit", "shingle").distinct()


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """``(doc, item, run)``: documents that hold at least ``min_words`` consecutive words of a passage."""
    key_type, item_type = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    docs = documents.where(F.length(text) > 0).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    units = items.where(F.col(passage).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.col(passage).alias("passage")).distinct()
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "passages")
    own = materialize(passage_shingles(units, min_words).withColumn("shingle", F.xxhash64("letters")), "passage-shingles")
    wanted = own.groupBy("shingle").agg(F.first("letters").alias("string"))
    hits = materialize(shingle_hits(docs, wanted, key_type), "shingle-hits")
    prefix = prefix_shingles(own, hits.groupBy("shingle").agg(F.count("*").alias("docs")), overlap, min_words)
    candidates = hits.join(prefix, "shingle").select("doc", "unit").distinct()
    shared = hits.join(own.select("shingle", "unit", "at", "least"), "shingle").join(candidates, ["doc", "unit"], "left_semi")
    near = F.exists(F.sequence(F.lit(0), F.size("ats") - overlap), lambda i: F.col("ats")[i + overlap - 1] - F.col("ats")[i] < min_words)
    bounded = shared.where(F.col("letters") >= F.floor(F.col("least") * SURVIVE)).groupBy("doc", "unit").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    bounded = materialize(bounded.where(F.size("ats") >= overlap).where(near).select("doc", "unit"), "leak-candidates")
    drop_table(hits)
    drop_table(own)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, runs = [], [], []
            for row, (page_text, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                page = Page(page_text)
                passages = [(one["item"], passage_words(one["passage"])) for one in asked]
                where = places(page, {letters for _, words in passages for _, _, letters in shingles(words)})
                for item, words in passages:
                    run = longest_run(page, words, min_words, where)
                    if run >= min_words:
                        at.append(row)
                        found.append(item)
                        runs.append(run)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, _ARROW[item_type]), pa.array(runs, pa.int32())], names=["doc", "item", "run"])

    asked = bounded.join(units, "unit").groupBy("doc").agg(F.collect_list(F.struct("item", "passage")).alias("asked"))
    # the names of the candidates go to the texts, not the texts to the candidates
    texts = docs.join(broadcast_if_small(bounded.select("doc").distinct()), "doc", "left_semi")
    return texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(verify, f"doc {key_type}, item {item_type}, run int").groupBy("doc", "item").agg(F.max("run").alias("run"))
