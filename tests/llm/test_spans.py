import random

import numpy as np

from vecloom.llm.spans import SharedSpans, shingle_hashes, signatures, sliding_min


def brute(docs, span):
    out = set()
    for i, (a, s) in enumerate(docs):
        for b, t in docs[i + 1 :]:
            if s and t and a is not None and b is not None and {s[k : k + span] for k in range(len(s) - span + 1)} & {t[k : k + span] for k in range(len(t) - span + 1)}:
                out.add((min(a, b), max(a, b)))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], "doc_id bigint, text string, rep int, sig string, pos int")


def test_hashes_and_minima():
    x = np.array([3, 1, 2, 9, 8, 7, 1, 1], dtype=np.uint64)
    for w in range(1, 9):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(9 - w)]
    codes = np.frombuffer("abcabcab".encode("utf-32-le"), np.uint32)
    h = shingle_hashes(codes, 3)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé\n😀") for _ in range(n))
    shared = [text(n) for n in (40, 39, 41, 60, 200)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng.randrange(30))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "short"), (103, docs[3][1] + "q" * 50), (104, "z" * 500), (105, "z" * 45), (106, docs[5][1] * 2)]
    docs += [(200 + i, docs[7][1] + "copy" * 20) for i in range(4)]
    found = SharedSpans(frame(spark, docs), span=40, shingle=30)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 40)
    for r in found.links().collect():
        by = dict(docs)
        assert by[r.a][r.pos_a : r.pos_a + r.length] == by[r.b][r.pos_b : r.pos_b + r.length] and r.length >= 40
    covered = {r.key: r for r in found.coverage().collect()}
    assert set(covered) == {x for p in got for x in p}
    assert all(0 < r.shared_chars <= r.n_chars for r in covered.values())
    assert covered[200].copies == 4 and covered[203].class_id == 200 and covered[203].shared_chars == covered[203].n_chars


def test_empty_and_repeated_rows(spark):
    assert SharedSpans(frame(spark, [])).pairs().count() == 0
    same = "ab" * 200
    assert SharedSpans(frame(spark, [(1, same), (1, same), (None, same)])).pairs().count() == 0
    assert [tuple(r) for r in SharedSpans(frame(spark, [(2, same), (1, same)])).pairs().collect()] == [(1, 2)]


def test_periodic_texts_cost_few_signatures_and_lose_no_pair(spark):
    assert len(signatures("z" * 20_000, 300, 236)[0]) <= 4
    assert len(signatures("abc" * 7_000, 300, 236)[0]) <= 16
    rng = random.Random(8)
    docs, n = [], 0
    for unit in ("z", "ab", "abcabd", "0123456789012345678"):
        for size in (30, 38, 40, 41, 45, 52, 60, 79, 80, 81, 97, 150, 400):
            for head, tail in (("", ""), ("<<", ""), ("", ">>"), ("q" + unit[1:], "w" * 20), ("long other head " * 2, "tail")):
                at = rng.randrange(len(unit))
                body = (unit * (size // len(unit) + 2))[at : at + size]
                docs.append((n, head + body + tail))
                n += 1
    docs = rng.sample(docs, 130)
    for tile in (1024, 8):
        got = [tuple(r) for r in SharedSpans(frame(spark, docs), span=40, shingle=30, tile=tile).pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, 40)
