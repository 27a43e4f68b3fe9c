import collections

import numpy as np
import pytest

from vecloom.llm.density import DensityPeaks, all_pivots, learn_pivots
from vecloom.llm.mih import _codes, centred_flips, learn_rotations, measured_recall, neighbours, similar_pairs, table_plan
from vecloom.llm.vectors import Classes, valid_points

SCHEMA = "collection_name string, id string, vector array<float>, payload string, version bigint, segment_id int, pid string, key int, weight string"
NAN = float("nan")


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c, sizes in (("a", [60, 30, 8, 4]), ("b", [25])):
        n = 0
        for size in sizes:
            centre = rng.standard_normal(64)
            for _ in range(size):
                out.append([c, f"{c}{n:04d}", (rng.uniform(0.2, 5) * (centre + 0.33 * rng.standard_normal(64))).tolist(), 1])
                n += 1
        for _ in range(40):
            out.append([c, f"{c}{n:04d}", rng.standard_normal(64).tolist(), 1])
            n += 1
        for k in range(0, 60, 3):
            base = np.array(out[-1 - k][2])
            out.append([c, f"{c}{n:04d}", (base + 0.2 * np.abs(base).mean() * rng.standard_normal(64)).tolist(), 1])
            n += 1
    copies = out[5][2]
    out += [["a", f"copy{i}", copies, 1] for i in range(9)]
    out += [["b", "a0001", out[1][2], 1], ["a", "a0001", [9.0] * 64, None], ["a", "a0002", out[2][2], 1]]
    bad = [None, [], [1.0] * 63, [0.0] * 64, [NAN] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    out += [["a", f"bad{i}", v, 1] for i, v in enumerate(bad)] + [["a", "a0003", None, 7]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(c, i, v, None, n, 1, "x", 2, "w") for c, i, v, n in rows], SCHEMA)


def clean(rows):
    best = {}
    for c, i, v, n in rows:
        if (c, i) not in best or (n or -1) > best[c, i][0]:
            best[c, i] = (n or -1, v)
    out = collections.defaultdict(dict)
    for (c, i), (_, v) in best.items():
        if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            out[c][i] = x / np.linalg.norm(x)
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def test_valid_points(spark, rows):
    got = collections.defaultdict(set)
    for r in valid_points(frame(spark, rows)).collect():
        got[r.collection_name].add(r.id)
    assert {c: set(p) for c, p in clean(rows).items()} == got


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_equal_brute_force(spark, rows, block):
    got = collections.defaultdict(list)
    for r in neighbours(frame(spark, rows), 5, 0.95, block=block).orderBy("rank").collect():
        got[r.collection_name, r.id].append(r.other)
    hit = total = 0
    for c, points in clean(rows).items():
        ids = sorted(points)
        x = np.stack([points[i] for i in ids])
        s = np.round(x @ x.T, 9)
        for a, i in enumerate(ids):
            best = [ids[b] for b in sorted((b for b in range(len(ids)) if b != a and s[a, b] >= 0.95), key=lambda b: (-s[a, b], b))[:5]]
            total += len(best)
            hit += len(set(best) & set(got[c, i]))
            assert len(got[c, i]) <= 5 and len(set(got[c, i]) - set(best)) <= len(set(best) - set(got[c, i])) + 1
    assert total > 100 and hit >= 0.99 * total


def test_nothing_and_one(spark, rows):
    assert similar_pairs(frame(spark, [])).count() == 0
    assert similar_pairs(frame(spark, rows[:1])).count() == 0
    assert DensityPeaks(frame(spark, [])).labels().count() == 0
    assert DensityPeaks(frame(spark, rows[:1])).labels().count() == 0
    assert [tuple(r) for r in similar_pairs(frame(spark, [["c", "B", [1.0] * 64, None], ["c", "a", [2.0] * 64, None]])).collect()] == [("c", "B", "a")]


def test_measured_recall(spark, rows):
    got = measured_recall(frame(spark, rows), every=3).collect()
    assert {r.collection_name for r in got} == {"a", "b"}
    assert sum(r.exact for r in got) > 20 and all(r.recall is None or r.recall >= 0.9 for r in got)


def test_plan_of_tables():
    for n in (10, 10_000, 10_000_000):
        bits, tables = table_plan(n, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 5e-4
    mean, r = learn_rotations(np.random.default_rng(1).standard_normal((200, 64)), 2)
    assert np.allclose(r[0] @ r[0].T, np.eye(64), atol=1e-8) and not np.allclose(r[0], r[1])


def components(points, least, smallest):
    ids = sorted(points)
    x = np.stack([points[i] for i in ids])
    near, left, out = x @ x.T >= least, set(range(len(ids))), set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            more = [b for b in np.flatnonzero(near[a]).tolist() if b in left]
            left -= set(more)
            todo += more
        if len(group) >= smallest:
            out |= {(ids[i], ids[min(group)]) for i in group}
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_clusters_are_the_linked_groups(spark, rows, block):
    peaks = DensityPeaks(frame(spark, rows), block=block)
    got = {(r.collection_name, r.id, r.cluster_id) for r in peaks.labels().collect()}
    want = {(c, *x) for c, p in clean(rows).items() for x in components(p, 0.80, 5)}
    assert got == want and len({x[2] for x in want}) >= 4
    described = peaks.clusters().collect()
    assert sum(r["size"] for r in described) == len(want) and all(1 <= len(r.typical) <= 3 and r.peaks >= 1 for r in described)


def test_basins_end_at_the_densest_point(spark, rows):
    peaks = DensityPeaks(frame(spark, rows))
    got = {(r.collection_name, r.id): (r.peak_id, r.density) for r in peaks.basins().collect()}
    want = clean(rows)
    assert set(got) == {(c, i) for c, p in want.items() for i in p}
    for c, points in want.items():
        ids = sorted(points)
        x = np.stack([points[i] for i in ids])
        near = (x @ x.T >= 0.80) & ~np.eye(len(ids), dtype=bool)
        density = dict(zip(ids, near.sum(axis=1)))
        assert all(got[c, i][1] == density[i] for i in ids)
        # whoever is densest among its neighbours is a peak, everybody else ends at a denser one
        for a, i in enumerate(ids):
            around = [density[ids[b]] for b in np.flatnonzero(near[a])]
            if all(density[i] > d for d in around):
                assert got[c, i][0] == i
            assert density[got[c, i][0]] >= density[i]


def test_pivots_follow_the_data(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 64))
    rows = [["c", f"p{g:02d}-{i}", (c + 0.3 * rng.standard_normal(64)).tolist(), 1] for g, c in enumerate(centres) for i in range(8)]
    classes = Classes(frame(spark, rows))
    whole = classes.sample
    # a sample of a fraction of the rows sees few of the groups; the points it leaves are sampled again
    classes.sample = lambda **k: whole(rows=240, **k)
    assert len(learn_pivots(classes.sample())) < 50 <= len(all_pivots(classes))


def test_a_chain_is_one_cluster(spark):
    # each point is near its two neighbours only
    angle = [[float(np.cos(k * 0.55)), float(np.sin(k * 0.55)), *[0.0] * 62] for k in range(6)]
    got = DensityPeaks(frame(spark, [["c", f"p{k}", v, 1] for k, v in enumerate(angle)])).labels().collect()
    assert {(r.id, r.cluster_id, r["size"]) for r in got} == {(f"p{k}", "p0", 6) for k in range(6)}


def test_copies_alone_make_a_cluster(spark):
    v = np.random.default_rng(4).standard_normal((2, 64)).tolist()
    got = DensityPeaks(frame(spark, [["c", f"x{i}", v[0], 1] for i in range(5)] + [["c", f"y{i}", v[1], 1] for i in range(4)])).labels().collect()
    assert {(r.id, r.cluster_id) for r in got} == {(f"x{i}", "x0") for i in range(5)}


def test_pivots():
    x = np.random.default_rng(0).standard_normal((50, 64))
    assert len(learn_pivots(x / np.linalg.norm(x, axis=1)[:, None])) == 0
    assert len(learn_pivots(np.tile(x[:1] / np.linalg.norm(x[0]), (10, 1)))) == 1


def test_tables_follow_the_flips_of_centred_vectors():
    rng = np.random.default_rng(4)
    to_unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    spread, cone = to_unit(rng.standard_normal((2000, 64))), to_unit(rng.standard_normal((2000, 64)) + 1.35)
    assert 0.6 < (cone @ cone.T).mean() < 0.7
    assert table_plan(160_000, 0.95, flips=centred_flips(spread, 0.95))[1] <= table_plan(160_000, 0.95)[1] + 3
    bits, tables = table_plan(160_000, 0.95, flips=centred_flips(cone, 0.95))
    away = rng.standard_normal(cone.shape)
    away = to_unit(away - (away * cone).sum(axis=1, keepdims=True) * cone)
    near = 0.95 * cone + np.sqrt(1 - 0.95**2) * away

    def missed(tables):
        mean, rotations = learn_rotations(cone, -(-tables // (64 // bits)))
        code = _codes(mean, rotations, bits, tables, 64)
        return 1 - (code(cone) == code(near)).any(axis=1).mean()

    assert missed(table_plan(160_000, 0.95)[1]) > 0.005
    assert missed(tables) <= 0.0015
    assert table_plan(10**6, 0.95, flips=np.full(9, 0.5))[0] < table_plan(10**6, 0.95)[0]
