"""Model-step invariants: Gram-based ridge CV equals a direct solve; OOF predictions cover every row once."""

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import __spark_entry__ as E
from ladderkit.operators import ml as M
from tests.conftest import SF001


def _data(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1] + [0.0, 5.0, -1.0]
    y = X @ [0.5, -0.02, 3.0] + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x1": X[:, 0], "x2": X[:, 1], "x3": X[:, 2], "y": y,
                        "fold": np.arange(n) % 4})
    return spark.createDataFrame(pdf), pdf


def test_ridge_grid_matches_direct_solve(spark):
    df, pdf = _data(spark)
    got = M.ridge_grid(spark, df, ["x1", "x2", "x3"], "y", "fold", [0.5, 50.0]).toPandas()
    for _, row in got.iterrows():
        tr, te = pdf[pdf.fold != row.fold], pdf[pdf.fold == row.fold]
        Xtr = tr[["x1", "x2", "x3"]].to_numpy()
        m, s = Xtr.mean(0), Xtr.std(0)
        Z = (Xtr - m) / s
        beta = np.linalg.solve(Z.T @ Z + row.alpha * np.eye(3), Z.T @ (tr.y.to_numpy() - tr.y.mean()))
        pred = tr.y.mean() + ((te[["x1", "x2", "x3"]].to_numpy() - m) / s) @ beta
        yt = te.y.to_numpy()
        r2 = 1 - np.sum((yt - pred) ** 2) / np.sum((yt - yt.mean()) ** 2)
        assert abs(r2 - row.r2) < 1e-9


def test_ridge_grid_keeps_digits_when_means_dwarf_spreads(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(800, 2)) * 0.04 + 1e5
    y = 1e4 + 0.5 * (X[:, 0] - 1e5) + rng.normal(size=800)
    pdf = pd.DataFrame({"x1": X[:, 0], "x2": X[:, 1], "y": y, "fold": np.arange(800) % 4})
    df = spark.createDataFrame(pdf)
    for winsor in (None, (0.0, 1.0)):  # cuts at the extremes change nothing
        got = M.ridge_grid(spark, df, ["x1", "x2"], "y", "fold", [1.0], winsor=winsor).toPandas()
        assert len(got) == 4
        for _, row in got.iterrows():
            tr, te = pdf[pdf.fold != row.fold], pdf[pdf.fold == row.fold]
            Xtr = tr[["x1", "x2"]].to_numpy()
            m, s = Xtr.mean(0), Xtr.std(0)
            Z = (Xtr - m) / s
            beta = np.linalg.solve(Z.T @ Z + np.eye(2), Z.T @ (tr.y.to_numpy() - tr.y.mean()))
            pred = tr.y.mean() + ((te[["x1", "x2"]].to_numpy() - m) / s) @ beta
            r2 = 1 - np.sum((te.y - pred) ** 2) / np.sum((te.y - te.y.mean()) ** 2)
            assert abs(r2 - row.r2) < 1e-9


def test_fair_fit_keeps_digits_when_means_dwarf_spreads(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500) * 0.04
    y = 3.0 * x + rng.normal(size=500) * 0.01
    near, far = (M.fair_irls(spark.createDataFrame(pd.DataFrame({"x": x + a, "y": y + b})), ["x"], "y")
                 for a, b in ((0.0, 0.0), (1e5, 1e4)))
    assert abs(near[1] - far[1]) < 1e-6 and abs(far[0] + far[1] * 1e5 - 1e4 - near[0]) < 1e-6


def test_oof_covers_every_row_once(spark):
    df, pdf = _data(spark, n=300)
    oof, imp, _ = M.cv_oof(df, ["x1", "x2", "x3"], "y", "fold", lambda: M.forest(trees=4, depth=3))
    o = oof.toPandas()
    assert sorted(o["id"]) == list(range(300))
    assert (o.merge(pdf[["id", "fold"]], on="id", suffixes=("", "_src")).eval("fold == fold_src")).all()
    assert imp.count() == 4 * 3


def test_inverse_normal_cdf(spark):
    from statistics import NormalDist
    ps = [0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(M.inv_norm_cdf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert abs(g - NormalDist().inv_cdf(p)) < 1e-8


def test_ridge_grid_winsorised_inside_folds(spark):
    df, pdf = _data(spark)
    got = M.ridge_grid(spark, df, ["x1", "x2", "x3"], "y", "fold", [5.0], winsor=(0.05, 0.95)).toPandas()
    for _, row in got.iterrows():
        tr, te = pdf[pdf.fold != row.fold], pdf[pdf.fold == row.fold]
        lo, hi = np.quantile(tr.y, 0.05), np.quantile(tr.y, 0.95)
        ytr = np.clip(tr.y.to_numpy(), lo, hi)
        Xtr = tr[["x1", "x2", "x3"]].to_numpy()
        m, s = Xtr.mean(0), Xtr.std(0)
        Z = (Xtr - m) / s
        beta = np.linalg.solve(Z.T @ Z + 5.0 * np.eye(3), Z.T @ (ytr - ytr.mean()))
        pred = ytr.mean() + ((te[["x1", "x2", "x3"]].to_numpy() - m) / s) @ beta
        yt = te.y.to_numpy()
        r2 = 1 - np.sum((yt - pred) ** 2) / np.sum((yt - yt.mean()) ** 2)
        assert abs(r2 - row.r2) < 1e-9


def test_ols_standardized_matches_numpy(spark):
    from ladderkit.operators import aggregates as A
    df, pdf = _data(spark)
    mom = A.moments(df, ["x1", "x2", "x3"], "y")
    beta, r2 = A.ols_standardized(mom, [0, 1, 2], ridge=0.01)
    X = pdf[["x1", "x2", "x3"]].to_numpy()
    Z = (X - X.mean(0)) / X.std(0)
    y = pdf.y.to_numpy()
    b = np.linalg.solve(Z.T @ Z + 0.01 * np.eye(3), Z.T @ y)  # no intercept, y not centred
    want = 1 - np.sum((y - Z @ b) ** 2) / np.sum((y - y.mean()) ** 2)
    assert np.allclose(beta, b, rtol=1e-9) and abs(r2 - want) < 1e-9


def test_gram_of_a_wide_frame_equals_numpy(spark):
    rng = np.random.default_rng(8)
    k, n = 120, 400
    X = rng.normal(size=(n, k)) + rng.normal(size=k) * 1e4
    names = [f"x{i}" for i in range(k)]
    pdf = pd.DataFrame(X, columns=names).assign(fold=np.arange(n) % 3)
    mean = X.mean(axis=0)
    got = M.gram(spark.createDataFrame(pdf).repartition(5), names, mean, "fold")
    assert sorted(got) == [0, 1, 2]
    for f, (m, s, Q) in got.items():
        Z = X[pdf.fold == f] - mean
        assert m == len(Z) and np.allclose(s, Z.sum(axis=0), atol=1e-8) and np.allclose(Q, Z.T @ Z, rtol=1e-9, atol=1e-8)


def test_gram_leaves_out_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (3.0, None, 0), (5.0, 7.0, None), (2.0, 1.0, 1)], "a double, b double, fold int")
    got = M.gram(df, ["a", "b"], [0.0, 0.0], "fold")
    assert {f: m for f, (m, _, _) in got.items()} == {0: 1.0, 1: 1.0}
    assert got[0][2].tolist() == [[1.0, 2.0], [2.0, 4.0]]
    assert M.gram(df.limit(0), ["a", "b"], [0.0, 0.0], "fold") == {}


def test_pooled_r2_of_the_ridge_grid(spark):
    df, pdf = _data(spark)
    got = M.ridge_grid(spark, df, ["x1", "x2", "x3"], "y", "fold", [0.5]).toPandas()
    sse = 0.0
    for k in range(4):
        yt = pdf[pdf.fold == k].y
        sse += (1 - got[got.fold == k].r2.iloc[0]) * np.sum((yt - yt.mean()) ** 2)
    assert np.allclose(got.pooled_r2, 1 - sse / np.sum((pdf.y - pdf.y.mean()) ** 2), atol=1e-9)


def test_evidence_updates_recover_both_precisions(spark):
    rng = np.random.default_rng(9)
    n, k = 4000, 30
    X, w = rng.normal(size=(n, k)) + 50.0, rng.normal(size=k) * 0.5
    y = X @ w + 7.0 + rng.normal(size=n) * 2.0
    D = np.column_stack([X, y])
    mean = D.mean(axis=0)
    Z = D - mean
    coef, at_zero, alpha, lam = M.evidence_ridge(float(n), Z.sum(axis=0), Z.T @ Z)
    assert abs(alpha - 0.25) < 0.02 and 1.5 < lam < 10.0
    # a fixed point: the ridge of that penalty
    S, b = Z[:, :k].T @ Z[:, :k], Z[:, :k].T @ Z[:, k]
    assert np.allclose(coef, np.linalg.solve(S + lam / alpha * np.eye(k), b), atol=1e-6) and abs(at_zero) < 1e-6
    assert np.abs(coef - w).max() < 0.2


def test_only_some_folds_are_scored_by_models_of_all_others(spark):
    df, pdf = _data(spark)
    from pyspark.ml.regression import LinearRegression
    make = lambda: LinearRegression(labelCol="label", solver="normal")
    oof, _, _ = M.cv_oof(df, ["x1", "x2", "x3"], "y", "fold", make, only=[0, 2])
    got = oof.toPandas().set_index("id").pred
    assert sorted(got.index) == pdf.id[pdf.fold.isin([0, 2])].tolist()
    for k in (0, 2):
        tr, te = pdf[pdf.fold != k], pdf[pdf.fold == k]
        A = np.column_stack([np.ones(len(tr)), tr[["x1", "x2", "x3"]]])
        beta = np.linalg.lstsq(A, tr.y, rcond=None)[0]
        want = np.column_stack([np.ones(len(te)), te[["x1", "x2", "x3"]]]) @ beta
        assert np.allclose(got[te.id], want, atol=1e-6)


def test_residual_fit_adds_the_margin_back(spark):
    df, pdf = _data(spark)
    from pyspark.ml.regression import LinearRegression
    make = lambda: LinearRegression(labelCol="label", solver="normal")
    feats = ["x1", "x2", "x3"]
    rows, tests = M.residual_fit(df, feats, "y", F.col("x1") * 1.5, make, "fold", test=df)
    plain, _, _ = M.cv_oof(df, feats, "y", "fold", make)
    # a linear learner with an intercept absorbs a linear margin
    both = rows.toPandas().set_index("id").pred, plain.toPandas().set_index("id").pred
    assert len(both[0]) == len(pdf) and np.allclose(both[0].sort_index(), both[1].sort_index(), atol=1e-6)
    t = tests.toPandas()
    assert len(t) == len(pdf) and set(t.n_models) == {4}


def test_tune_makes_exactly_the_trials_asked_for(spark):
    df, _ = _data(spark, n=200)
    got = [M.tune(df, ["x1", "x3"], "y", "fold", n_trials=3, only=[0]).collect() for _ in range(2)]
    assert [r.trial for r in got[0]] == [0, 1, 2] and got[0] == got[1]


def test_tune_query_scores_the_rows_of_every_fold(spark, monkeypatch):
    whole, scored = M.cv_oof, []

    def quick(df, feats, y, fold, make_est, **kw):
        out = whole(df, feats, y, fold, lambda: LinearRegression(labelCol="label", solver="normal"), **kw)
        scored.append((out[0].count(), df.count()))
        return out

    monkeypatch.setattr(M, "cv_oof", quick)
    assert len(E.queries()["tune"](spark, SF001).collect()) == len(scored) == 4
    assert all(n == rows > 0 for n, rows in scored)


def test_drift_auc_is_held_out(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"id": np.arange(600), "same": rng.normal(size=600), "noise": rng.normal(size=600),
                        "moved": rng.normal(size=600) + (np.arange(600) >= 300) * 3.0})
    df = spark.createDataFrame(pdf)
    got = M.drift_rank(df.filter("id < 300"), df.filter("id >= 300"), ["same", "noise", "moved"], batch=2, drop=1).toPandas()
    auc = got.drop_duplicates("batch").set_index("batch").auc
    assert 0.4 < auc[0] < 0.6 and auc[1] > 0.95   # in-sample scores of noise would be far above a half
    assert got.feature[got["rank"] == 1].item() == "moved" and got.dropped.sum() == 1


def test_pca_query_keeps_every_component(spark):
    got = E.queries()["pca"](spark, SF001).toPandas()
    assert sorted(got.component) == list(range(8))
    assert abs(got.variance.sum() - 8) < 0.05   # all of the standardised features' variance


def test_stack_fit_query_takes_every_oscillator(spark, monkeypatch):
    given, whole, folds = [], M.stack_fit, M.cv_oof
    monkeypatch.setattr(M, "cv_oof", lambda df, feats, y, fold, make_est: folds(
        df, feats, y, fold, lambda: LinearRegression(labelCol="label", solver="normal")))
    monkeypatch.setattr(M, "stack_fit", lambda wide, cols, y: given.append(cols) or whole(wide, cols, y))
    assert len(E.queries()["stack_fit"](spark, SF001).collect()) == 1
    assert given == [["p_gbt", "p_lr", "osc_0", "osc_1", "osc_2", "osc_3"]]


def test_moments_equal_numpy_and_skip_rows_not_finite(spark):
    from ladderkit.operators import aggregates as A
    rng = np.random.default_rng(12)
    X = rng.normal(size=(500, 40)) + rng.normal(size=40) * 1e4
    names = [f"x{i}" for i in range(39)] + ["y"]
    pdf = pd.DataFrame(X, columns=names)
    bad = pdf.copy().iloc[:2]
    bad.loc[bad.index[0], "x3"], bad.loc[bad.index[1], "y"] = np.nan, np.inf
    mom = A.moments(spark.createDataFrame(pd.concat([pdf, bad])).repartition(4), names[:-1], "y")
    assert mom["n"] == 500 and np.allclose(mom["mean"], X.mean(axis=0), rtol=1e-12)
    assert np.allclose(mom["cov"], np.cov(X.T, bias=True), rtol=1e-8, atol=1e-9)
    empty = A.moments(spark.createDataFrame(pdf).limit(0), names[:-1], "y")
    assert empty["n"] == 0 and not empty["cov"].any()


def test_elastic_grid_equals_spark_ml(spark):
    df, _ = _data(spark)
    feats, alphas = ["x1", "x2", "x3"], [0.001, 0.05, 0.4]
    got = M.elastic_grid(spark, df, feats, "y", "fold", alphas).toPandas()
    assert len(got) == 12
    for a in alphas:
        for k in range(4):
            lr = LinearRegression(labelCol="label", regParam=a, elasticNetParam=0.5, maxIter=500, tol=1e-12)
            m = M.make_pipeline(feats, lr).fit(df.filter(F.col("fold") != k).withColumn("label", F.col("y")))
            te = m.transform(df.filter(F.col("fold") == k)).select("y", "prediction").toPandas()
            r2 = 1 - ((te.y - te.prediction) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum()
            assert abs(r2 - got[(got.alpha == a) & (got.fold == k)].r2.iloc[0]) < 1e-6


def test_elastic_grid_drops_weak_features_and_takes_constants(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "k": 7.0, "y": 2.0 * x[:, 0] + rng.normal(size=400) * 0.1,
                        "fold": np.arange(400) % 2})
    g = M.FoldGram(spark.createDataFrame(pdf), ["a", "b", "k"], "y", "fold")
    *_, beta = M._elastic_solve(*g.total(), 0.1, 0.1, np.zeros(3))
    assert beta[0] > 0.5 and beta[1] == 0.0 and beta[2] == 0.0


def test_pruning_stops_a_bad_trial_and_keeps_the_best(spark):
    df, _ = _data(spark, n=400)

    def draw(rng, seen=[]):
        seen.append(1)
        reg = [1.0, 0.5, 50.0, 0.0][len(seen) - 1]   # the third learns next to nothing, the last is the best
        return 0, reg, lambda: LinearRegression(labelCol="label", regParam=reg, solver="normal")

    got = M.tune_pruned(df, ["x1", "x2", "x3"], "y", "fold", n_trials=4, startup=2, draw=draw).toPandas()
    assert got.pruned.tolist() == [False, False, True, False]
    assert got.folds_scored.tolist() == [4, 4, 1, 4]
    assert got.r2.idxmax() == 3


def test_vectors_are_assembled_once_for_all_folds(spark, monkeypatch):
    df, pdf = _data(spark)
    calls, whole = [], M.VectorAssembler._transform
    monkeypatch.setattr(M.VectorAssembler, "_transform", lambda self, d: calls.append(1) or whole(self, d))
    oof, _, _ = M.cv_oof(df, ["x1", "x2", "x3"], "y", "fold", lambda: LinearRegression(labelCol="label", solver="normal"))
    assert calls == [1] and oof.count() == len(pdf)


def test_trials_share_rows_assembled_once(spark, monkeypatch):
    df, _ = _data(spark, n=200)
    calls, whole = [], M.VectorAssembler._transform
    monkeypatch.setattr(M.VectorAssembler, "_transform", lambda self, d: calls.append(1) or whole(self, d))
    monkeypatch.setattr(M, "gbt", lambda *a, **kw: LinearRegression(labelCol="label", solver="normal"))
    assert M.tune(df, ["x1", "x3"], "y", "fold", n_trials=3).count() == 3 and calls == [1]
    calls.clear()
    got = M.tune_pruned(df, ["x1", "x3"], "y", "fold", n_trials=3, startup=3).collect()
    assert calls == [1] and [(r.trial, r.folds_scored, r.pruned) for r in got] == [(t, 4, False) for t in range(3)]


def test_fits_of_different_folds_run_at_the_same_time(spark, monkeypatch):
    import threading
    df, pdf = _data(spark, n=200)
    gate = threading.Barrier(2)

    class Meets(LinearRegression):
        def fit(self, rows):
            gate.wait(60)   # broken unless another fit runs
            return super().fit(rows)

    make = lambda: Meets(labelCol="label", solver="normal")
    oof, _, _ = M.cv_oof(df, ["x1", "x2", "x3"], "y", "fold", make)
    assert oof.count() == len(pdf)
    monkeypatch.setattr(M, "FIT_ROWS", len(pdf))   # many rows: one fit after the other
    with M.FoldRows(df, ["x1", "x2", "x3"], "y", "fold") as rows:
        assert rows.slots.acquire(blocking=False) and not rows.slots.acquire(blocking=False)


def test_stack_fit_query_joins_its_columns_once(spark, monkeypatch):
    plans, whole = [], M.stack_fit
    monkeypatch.setattr(M, "gbt", lambda: LinearRegression(labelCol="label", solver="normal"))
    monkeypatch.setattr(M, "stack_fit", lambda wide, cols, y: plans.append(
        wide._jdf.queryExecution().toString()) or whole(wide, cols, y))
    assert len(E.queries()["stack_fit"](spark, SF001).collect()) == 1
    assert len(plans) == 1 and "Join" not in plans[0]   # means, moments and metrics read a copy
