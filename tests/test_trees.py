"""Boosted trees from histograms against direct searches in numpy."""

import numpy as np
import pandas as pd
import pytest

from ladderkit.operators import trees as T


def _frame(n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.normal(size=n) * 0.1
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": np.arange(n) % 2})


def _bins(pdf, edges):
    return np.column_stack([np.searchsorted(e, pdf[f], side="left") + 1 for f, e in zip("abc", edges)])


def _grow(x, g, depth, n_bins, l2, symmetric):
    """Prediction of one tree by trying every cut on the rows themselves."""
    def score(mask):
        return g[mask].sum() ** 2 / (mask.sum() + l2)

    at = np.zeros(len(x), dtype=int)
    for level in range(depth):
        groups = [list(range(1 << level))] if symmetric else [[v] for v in range(1 << level)]
        nxt = at.copy()
        for group in groups:
            best = max(((round(sum(score((at == v) & (x[:, j] <= c)) + score((at == v) & (x[:, j] > c)) for v in group), 9), -j, -c)
                        for j in range(x.shape[1]) for c in range(n_bins)))
            for v in group:
                nxt[at == v] = 2 * v + (x[at == v, -best[1]] > -best[2])
        at = nxt
    return np.array([g[at == v].sum() / ((at == v).sum() + l2) for v in range(1 << depth)]), at


@pytest.mark.parametrize("symmetric", [True, False])
def test_one_tree_equals_a_direct_split_search(spark, symmetric):
    pdf = _frame()
    df = spark.createDataFrame(pdf).repartition(3)
    oof, models = T.boosted_oof(df, ["a", "b", "c"], "y", "fold", rounds=1, depth=2, bins=8, step=1.0, symmetric=symmetric)
    edges = T.bin_edges(df, ["a", "b", "c"], 8)
    x = _bins(pdf, edges)
    for k, m in models.items():
        use = (pdf.fold != k).to_numpy()
        assert abs(m.base - pdf.y[use].mean()) < 1e-12
        values, at = _grow(x[use], (pdf.y[use] - m.base).to_numpy(), 2, 9, 1.0, symmetric)
        assert np.allclose(m.trees[0].predict(x[use]), values[at], atol=1e-9)
        if symmetric:
            assert all(len(set(f)) == 1 and len(set(c)) == 1 for f, c in m.trees[0].cuts)
    got = oof.toPandas().sort_values("id")
    assert got.id.tolist() == pdf.id.tolist()
    for k, m in models.items():
        mine = (pdf.fold == k).to_numpy()
        assert np.allclose(got.pred[mine], m.predict(x[mine]))


def test_more_rounds_fit_better_and_drop_rate_zero_is_plain_boosting(spark):
    df = spark.createDataFrame(_frame())
    data = T.binned(df, ["a", "b", "c"], "y", "fold", "id", T.bin_edges(df, ["a", "b", "c"], 8)).checkpoint()
    plain = T.boost(data, 3, 9, 4, 2, step=0.5, seed=1)
    zero = T.boost(data, 3, 9, 4, 2, step=0.5, drop=0.0, seed=99)
    pdf = data.toPandas()
    x, y = pdf[["b0", "b1", "b2"]].to_numpy(), pdf.y.to_numpy()
    for k in plain:
        assert plain[k].weights == zero[k].weights == [0.5] * 4
        assert np.array_equal(plain[k].predict(x), zero[k].predict(x))
        use = (pdf.fold == k).to_numpy()
        errors = [np.mean((y[use] - plain[k].predict(x[use], without=range(r, 4))) ** 2) for r in range(5)]
        assert errors[4] < errors[2] < errors[0]


def test_trees_that_are_left_out_are_rescaled(spark):
    df = spark.createDataFrame(_frame())
    data = T.binned(df, ["a", "b", "c"], "y", "fold", "id", T.bin_edges(df, ["a", "b", "c"], 8)).checkpoint()
    one = T.boost(data, 3, 9, 1, 2, step=0.6)
    all_ = T.boost(data, 3, 9, 3, 2, step=0.6, drop=1.0)   # each round learns what the first one did
    x = data.toPandas()[["b0", "b1", "b2"]].to_numpy()
    for k in one:
        assert np.allclose(all_[k].weights, [0.2] * 3)
        assert np.allclose(all_[k].predict(x), one[k].predict(x))


def test_nulls_constants_and_empty_tables(spark):
    rows = [(i, None if i % 3 else float(i), 5.0, None if i == 7 else float(i % 3 == 0), i % 2 if i != 8 else None)
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, k double, y double, fold int")
    oof, _ = T.boosted_oof(df, ["a", "k"], "y", "fold", rounds=2, depth=1, bins=4, step=1.0, l2=0.0)
    got = oof.toPandas()
    assert sorted(got.id) == [i for i in range(40) if i not in (7, 8)]
    assert ((got.pred > 0.5) == (got.y > 0.5)).all()     # a null is a bin of its own
    empty, models = T.boosted_oof(df.limit(0), ["a", "k"], "y", "fold", rounds=1, depth=1)
    assert empty.count() == 0 and models == {}


def test_packed_rows_are_the_binned_rows(spark):
    data = T.binned(spark.createDataFrame(_frame()).repartition(3), ["a", "b", "c"], "y", "fold", "id",
                    T.bin_edges(spark.createDataFrame(_frame()), ["a", "b", "c"], 8)).checkpoint()
    want = data.toPandas()
    blocks = T.packed(data, 3).toPandas()
    assert len(blocks) < 10   # a row an Arrow batch
    bins = np.concatenate([np.frombuffer(b, np.int16).reshape(3, -1).T for b in blocks.bins])
    got = np.column_stack([np.frombuffer(b"".join(blocks.fold), np.int32), np.frombuffer(b"".join(blocks.y)), bins])
    assert np.array_equal(got[np.lexsort(got.T)], (w := want[["fold", "y", "b0", "b1", "b2"]].to_numpy(float))[np.lexsort(w.T)])
