"""kNN: the pivot tree, byte-bounded tiles and exact re-ranking, against brute force."""

import tracemalloc

import numpy as np
import pytest

from ladderkit.operators import knn as Kn


def brute(q, qid, b, bid, k):
    out = {}
    for i, v in zip(qid, q):
        d = np.sqrt(((b - v) ** 2).sum(axis=1))
        out[int(i)] = [(int(bid[j]), d[j]) for j in np.lexsort((bid, d))[:k]]
    return out


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def check(got, want):
    rows = {}
    for r in got.collect():
        rows.setdefault(r["probe_id"], []).append((r["rank"], r["base_id"], r["dist"]))
    assert set(rows) == {i for i, w in want.items() if w}
    for i, w in want.items():
        assert [x[1] for x in sorted(rows.get(i, []))] == [x[0] for x in w]
        assert np.allclose([x[2] for x in sorted(rows.get(i, []))], [x[1] for x in w], rtol=1e-12, atol=0)


@pytest.mark.parametrize("dim,k", [(30, 50), (4, 3)])
def test_tree_search_with_hot_leaf_and_ties(spark, monkeypatch, dim, k):
    """A third of the base rows are one vector; leaves hold fewer rows than k; far offset of all values."""
    monkeypatch.setattr(Kn, "LEAF_ROWS", 8)
    rng = np.random.default_rng(dim)
    b = 1e6 + rng.normal(size=(600, dim))
    b[::3] = b[0]
    q = np.vstack([1e6 + rng.normal(size=(40, dim)), b[:3], np.full((1, dim), 1e6 + 50)])
    got = Kn.knn(frame(spark, q), frame(spark, b, 1000), k, block=37)
    check(got, brute(q, np.arange(len(q)), b, 1000 + np.arange(len(b)), k))


def test_few_rows_and_nulls(spark):
    x = np.arange(6.0).reshape(3, 2)
    base = frame(spark, x, 10).unionByName(spark.createDataFrame([(99, None)], "vec_id long, embedding array<double>"))
    check(Kn.knn(frame(spark, x), base, 5), brute(x, range(3), x, np.arange(10, 13), 5))
    assert Kn.knn(frame(spark, x), base.filter("vec_id = 99"), 5).count() == 0
    assert Kn.knn(base.filter("vec_id = 99"), base, 5).count() == 0


def test_tiles_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(Kn, "TILE_BYTES", 1 << 20)
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(3000, 64)), rng.normal(size=(5000, 64))
    tracemalloc.start()
    got = Kn._tile_topk(q, np.arange(3000), b, np.arange(5000), 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20      # some tiles and the results; all distances would take 120 MB, differences 7.7 GB
    want = brute(q[:50], range(50), b, np.arange(5000), 10)
    for i in range(50):
        at = got[0] == i
        assert got[1][at].tolist() == [x[0] for x in want[i]]


def test_tree_grows_and_stays_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = frame(spark, rng.normal(size=(500, 8))).toDF("_bid", "_bv")
    monkeypatch.setattr(Kn, "LEAF_ROWS", 5)
    tree, n = Kn._tree(rows, None)
    assert n == 500 and len(tree.leaves) == 100 and len(tree.tops) == 10 and tree.first[-1] == 100
    monkeypatch.setattr(Kn, "PIVOT_BYTES", 8 * 8 * 20)
    assert len(Kn._tree(rows, None)[0].leaves) == 20
    x = rng.normal(size=(50, 8))
    leaf, dist, top = tree.homes(x)
    assert np.allclose(dist, np.sqrt(((x - tree.leaves[leaf]) ** 2).sum(axis=1)))
    assert np.allclose(top, np.sqrt(((x - tree.tops[tree.top_of()[leaf]]) ** 2).sum(axis=1)))


def test_pca_query_is_exact_in_its_space(spark):
    """The 30-component query against brute force on the same projected vectors."""
    from ladderkit.operators import ml as M
    from ladderkit.plans import q_knn
    from tests.conftest import SF001
    probe, base = q_knn._split(spark, SF001)
    model = M.pca_fit_array(base, "embedding", 30)
    p, b = (M.pca_apply(model, x, "embedding").toPandas().sort_values("vec_id") for x in (probe, base))
    want = brute(np.array(p.pcs.tolist()), p.vec_id, np.array(b.pcs.tolist()), b.vec_id.to_numpy(), 50)
    got = q_knn.knn_pca30(spark, SF001).toPandas()
    assert len(got) == 50 * len(p)
    for i, g in got.groupby("probe_id"):
        assert g.sort_values("rank").base_id.tolist() == [x[0] for x in want[i]]


def test_a_probe_goes_to_a_block_once_however_many_leaves_it_needs(spark, monkeypatch):
    """In many dimensions every leaf is needed: the rows shuffled grow with the blocks and not with the leaves."""
    monkeypatch.setattr(Kn, "LEAF_ROWS", 4)
    rng = np.random.default_rng(8)
    q, b = rng.normal(size=(60, 24)), rng.normal(size=(400, 24))
    sent, whole = [], Kn._blocked_topk

    def spy(probes, parts, tree, sizes, radius, most, k):
        sent.append((len(tree.leaves), len(Kn._blocks(sizes, 2 * most))))
        return whole(probes, parts, tree, sizes, radius, most, k)

    monkeypatch.setattr(Kn, "_blocked_topk", spy)
    check(Kn.knn(frame(spark, q), frame(spark, b, 1000), 7, block=50), brute(q, range(60), b, np.arange(1000, 1400), 7))
    assert sent == [(100, 4)]


def test_blocks_cover_every_leaf_and_split_a_hot_one():
    assert Kn._blocks(np.array([3, 0, 4, 25, 1]), 10) == [(0, 4), (3, 4), (3, 4), (3, 5)]
    assert Kn._blocks(np.array([0, 5]), 10) == [(1, 2)]
