import random

import pytest

from vecloom.streaming.changefeed import DELETES, ChangeFeed, apply_batch

SCHEMA = "collection_name string, start_lsn bigint, entry_no int, lsn bigint, op string, id string, vector array<float>, metadata string, version bigint, written_at timestamp, arrived_at timestamp, batch string, seen string"


def rows_of(seed, n=600):
    rng = random.Random(seed)
    out = []
    for lsn in range(1, n):
        op = rng.choice(["AddVector", "I", "insert", "U", "update", "UPSERT ", "upsert", "D", " Delete", "DeleteVector", "CreateIndex"])
        id = None if op == "CreateIndex" else "hot" if rng.random() < 0.3 else f"p{rng.randrange(40)}"
        start = lsn // 50 * 50
        row = ["c1" if lsn % 3 else "c2", start, lsn - start, lsn, op, id, None if rng.random() < 0.1 else [1.0, 2.0], None if rng.random() < 0.2 else f'{{"n":{lsn}}}', None, None, None, "x", "y"]
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            copy = list(row)
            if rng.random() < 0.1:
                copy[3 if rng.random() < 0.5 else 1] = None
            out.append(tuple(copy))
    rng.shuffle(out)
    return out


def truth(rows):
    once = {(r[0], r[3] if r[3] is not None else r[1] + r[2]): r for r in rows if r[5]}
    live = {}
    for c, lsn in sorted(once):
        r = once[c, lsn]
        if r[4].strip().lower() in DELETES:
            live.pop((c, r[5]), None)
        else:
            live[c, r[5]] = (lsn, live.get((c, r[5]), (0, 0))[1] + 1)
    return live


def found(df):
    return {(r.collection_name, r.id): (r.lsn, r.version) for r in df.collect()}


@pytest.mark.parametrize("stretch", [7, 4096])
def test_batch_fold(spark, stretch):
    rows = rows_of(1)
    assert found(apply_batch(spark.createDataFrame(rows, SCHEMA), stretch)) == truth(rows)
    assert apply_batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_in_batches_and_restart(spark, tmp_path):
    rows = rows_of(2, 200)
    at, home = f"{tmp_path}/log", f"file://{tmp_path}/home"
    spark.createDataFrame(rows[: len(rows) // 2], SCHEMA).repartition(3).write.parquet(at)
    feed = ChangeFeed(spark, at, home=home, max_files=1, stretch=50).run_available()
    assert found(feed.current()) == truth(rows[: len(rows) // 2])
    spark.createDataFrame(rows[len(rows) // 2 :], SCHEMA).repartition(2).write.mode("append").parquet(at)
    again = ChangeFeed(spark, at, home=home, max_files=1, stretch=50).run_available()
    assert found(again.current()) == truth(rows)
    # nothing new: nothing changes
    assert found(ChangeFeed(spark, at, home=home, stretch=50).run_available().current()) == truth(rows)
    body = {(r.collection_name, r.id): r.metadata for r in again.current().collect()}
    assert body == {(r.collection_name, r.id): r.metadata for r in apply_batch(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_batches_are_folded_into_versions(spark, tmp_path):
    rows = rows_of(3, 120)
    at, home = f"{tmp_path}/log", f"file://{tmp_path}/home"
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(at)
    feed = ChangeFeed(spark, at, home=home, max_files=1, stretch=50, compact=2).run_available()
    assert found(feed.current()) == truth(rows)
    assert len(feed._written("versions")) == 2 and len(feed._written("states")) <= 5


def test_empty_log(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/log")
    assert ChangeFeed(spark, f"{tmp_path}/log").run_available().current().count() == 0
