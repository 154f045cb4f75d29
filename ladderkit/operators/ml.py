"""Model steps on Spark ML and on Gram aggregates.

Spark ML is the learner library here (no external boosting libraries), so the
reference's boosted trees map to ``GBTRegressor``/``RandomForestRegressor``
and Huber to ``LinearRegression(loss="huber")``. Linear models that only need
second moments (ridge grids, Fair-loss IRLS) are solved from Gram aggregates:
one ``groupBy(fold)`` pass gives every fold's moments, a training fold's Gram
is ``total - fold``, and each (alpha, fold) solve is a k x k system on the
driver - the data is read once for the whole grid.
"""

from __future__ import annotations

from contextlib import nullcontext
from multiprocessing.pool import ThreadPool
from threading import Semaphore
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import c, lit_d
from ..session import ensure_checkpoint_dir, written
from .windows import rank_ordinal


# M1, M2, E28 -------------------------------------------------------------------
def features_pipeline(feats: Sequence[str], standardize: bool = True, pca_k: int | None = None) -> list:
    """E28 + M1 (+ M2): assemble (stable order, invalid kept), standardise, optional PCA."""
    stages = [VectorAssembler(inputCols=list(feats), outputCol="raw", handleInvalid="keep")]
    col = "raw"
    if standardize:
        stages.append(StandardScaler(inputCol=col, outputCol="std", withMean=True, withStd=True))
        col = "std"
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=col, outputCol="pca"))
        col = "pca"
    return stages + [_Rename(col)]


class _Rename:
    """Marker for the final feature column name (resolved by :func:`make_pipeline`)."""

    def __init__(self, col: str):
        self.col = col


def make_pipeline(feats: Sequence[str], estimator, standardize: bool = True, pca_k: int | None = None) -> Pipeline:
    stages = features_pipeline(feats, standardize, pca_k)
    col = stages.pop().col
    estimator.setFeaturesCol(col)
    return Pipeline(stages=stages + [estimator])


def standardize_fit(train: DataFrame, feats: Sequence[str]) -> PipelineModel:
    """M1: scaler fitted on the training fold only (sample std, as Spark ML defines it)."""
    return Pipeline(stages=features_pipeline(feats, True)[:-1]).fit(train)


def pca_scores(df: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    """M2: PCA to k components after standardisation (component signs are arbitrary)."""
    m = Pipeline(stages=features_pipeline(feats, True, k)[:-1]).fit(df)
    return m.transform(df).select("*", vector_to_array("pca").alias("pcs"))


# M3 ----------------------------------------------------------------------------
# Coefficients of Acklam's published rational approximation of the inverse normal CDF.
ACKLAM = (
    [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00],
    [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00],
)


def inv_norm_cdf(p: Column) -> Column:
    """Inverse standard normal CDF (Acklam's rational approximation, |rel err| < 1.2e-9) as a Column."""
    a, b, cc, d = ACKLAM
    lo, hi = 0.02425, 1 - 0.02425

    def poly(coef, x):
        out = lit_d(coef[0])
        for k in coef[1:]:
            out = out * x + lit_d(k)
        return out

    q = p - 0.5
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + 1.0)
    ql = F.sqrt(-2.0 * F.ln(p))
    lower = poly(cc, ql) / ((((lit_d(d[0]) * ql + d[1]) * ql + d[2]) * ql + d[3]) * ql + 1.0)
    qh = F.sqrt(-2.0 * F.ln(1.0 - p))
    upper = -poly(cc, qh) / ((((lit_d(d[0]) * qh + d[1]) * qh + d[2]) * qh + d[3]) * qh + 1.0)
    return F.when(p < lo, lower).when(p > hi, upper).otherwise(central)


def quantile_normal(df: DataFrame, col: str, id_col: str, out: str = "qnorm") -> DataFrame:
    """M3: rank (global, no single task) -> ``Phi^-1((rank + 0.5) / n)``."""
    r = rank_ordinal(df, col, id_col, "_frac")
    total = df.count()
    return r.withColumn(out, inv_norm_cdf((F.col("rank0") + 0.5) / F.lit(float(total)))).drop("_frac", "rank0")


# M4, M5, M8 (Gram) -------------------------------------------------------------
def gram(df: DataFrame, cols: Sequence[str], mean: Sequence[float], fold: str | None = None, weight=None) -> dict:
    """``{fold: (n, sums, X'X)}`` of ``cols`` about ``mean``, each row counted ``weight(x)`` times.

    Arrow batches are multiplied to one block a fold and partition; the blocks are summed on the
    shuffle by (fold, column), so the aggregates grow with the columns and not with their pairs.
    Rows with a null in any column or without a fold are left out.
    """
    k = len(cols)
    mean = np.array(mean, dtype=float)
    names = [f"c{i}" for i in range(k)]
    d = df.select((F.lit(0) if fold is None else F.col(fold)).alias("fold"),
                  *[F.col(x).cast("double").alias(n) for x, n in zip(cols, names)]).dropna()

    def blocks(batches):
        acc: dict = {}
        for b in batches:
            x = b[names].to_numpy(np.float64) - mean
            w = np.ones(len(x)) if weight is None else weight(x)
            for f, at in b.groupby("fold").indices.items():
                n, s, q = acc.get(f, (0.0, 0.0, 0.0))
                xw = x[at] * w[at, None]
                acc[f] = n + w[at].sum(), s + xw.sum(axis=0), q + xw.T @ x[at]
        for f, (n, s, q) in acc.items():
            out = pd.DataFrame(q, columns=[f"q{j}" for j in range(k)])
            yield out.assign(fold=f, i=np.arange(k), n=n, s=s)

    sums = ["n", "s", *[f"q{j}" for j in range(k)]]
    schema = f"fold {d.schema['fold'].dataType.simpleString()}, i int, " + ", ".join(f"{x} double" for x in sums)
    rows = d.mapInPandas(blocks, schema).groupBy("fold", "i").agg(*[F.sum(x).alias(x) for x in sums]).collect()
    out: dict = {}
    for r in rows:  # one row a fold and column
        n, s, q = out.setdefault(r["fold"], (float(r["n"]), np.zeros(k), np.zeros((k, k))))
        s[r["i"]] = r["s"]
        q[r["i"]] = r[4:]
    return out


def _means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Means of the columns over the rows that are complete in all of them."""
    d = df.select(*[F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate(cols)]).dropna()
    return [v or 0.0 for v in d.agg(*[F.avg(x) for x in d.columns]).first()]


class FoldGram:
    """Per-fold moments of ``[x..., y]`` about the overall means (see :func:`gram`).

    A first pass takes the means, so columns whose mean dwarfs their spread lose no digits. The
    last ``like_y`` features are variants of ``y`` and are shifted by its mean.
    """

    def __init__(self, df: DataFrame, feats: Sequence[str], y: str, fold: str | None, like_y: int = 0):
        self.feats = list(feats)
        cols = self.feats + [y]
        self.mean = _means(df, cols)
        self.mean[len(cols) - 1 - like_y:] = [self.mean[-1]] * (like_y + 1)
        self.folds = gram(df, cols, self.mean, fold)

    def total(self, exclude=None):
        n, s, Q = 0.0, 0.0, 0.0
        for f, (nf, sf, Qf) in self.folds.items():
            if f != exclude:
                n, s, Q = n + nf, s + sf, Q + Qf
        return n, s, Q


def _ridge_solve(n, s, Q, alpha):
    """Ridge on population-standardised x with intercept (= mean y) from raw moments."""
    k = len(s) - 1
    m = s[:k] / n
    cov = Q[:k, :k] / n - np.outer(m, m)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd = np.where(sd == 0, 1.0, sd)
    ybar = s[k] / n
    S = n * cov / np.outer(sd, sd)
    b = (Q[:k, k] - m * s[k]) / sd
    beta = np.linalg.solve(S + alpha * np.eye(k), b)
    return m, sd, ybar, beta


def _fold_errors(fold_mom, m, sd, ybar, beta) -> tuple[float, float]:
    """Squared error of a fold under a fit, and the fold's squared spread about its own mean."""
    nk, sk, Qk = fold_mom
    k = len(m)
    sz = (sk[:k] - nk * m) / sd
    Szz = (Qk[:k, :k] - np.outer(m, sk[:k]) - np.outer(sk[:k], m) + nk * np.outer(m, m)) / np.outer(sd, sd)
    szy = (Qk[:k, k] - m * sk[k]) / sd
    yy, sy = Qk[k, k], sk[k]
    sse = yy - 2 * ybar * sy + nk * ybar ** 2 - 2 * beta @ (szy - ybar * sz) + beta @ Szz @ beta
    return float(sse), float(yy - sy * sy / nk)


def _spread(g: FoldGram) -> float:
    """Squared spread of ``y`` (the last column) about its overall mean."""
    n, s, Q = g.total()
    return float(Q[-1, -1] - s[-1] ** 2 / n) if n else 0.0


def _grid_frame(spark: SparkSession, errors: list[tuple[float, int, float, float]], spread: float) -> DataFrame:
    """(alpha, fold, r2, pooled_r2): R^2 per fold, and over all out-of-fold rows of the alpha."""
    pooled: dict[float, float] = {}
    for a, _, sse, _ in errors:
        pooled[a] = pooled.get(a, 0.0) + sse
    return spark.createDataFrame([(a, f, 1.0 - sse / sst if sst > 0 else 0.0, 1.0 - pooled[a] / spread if spread > 0 else 0.0)
                                  for a, f, sse, sst in errors], "alpha double, fold int, r2 double, pooled_r2 double")


def ridge_grid(spark: SparkSession, df: DataFrame, feats: Sequence[str], y: str, fold: str,
               alphas: Sequence[float], winsor: tuple[float, float] | None = None) -> DataFrame:
    """M4: ridge alpha grid under (grouped) CV - R^2 on each held-out fold and pooled over all of
    them (about the overall mean), from one aggregate.

    ``winsor=(lo, hi)``: the *training* target of every fold is clipped to that training fold's
    ``lo``/``hi`` percentiles (computed inside the fold - clipping before the split would leak),
    while R^2 is scored on the original held-out target. Percentiles for all folds come from one
    grouped sort; the clipped targets of all folds enter the same single Gram aggregate.
    """
    feats = list(feats)
    if winsor is None:
        g = FoldGram(df, feats, y, fold)
        rows = []
        for a in alphas:
            for f in sorted(g.folds):
                m, sd, ybar, beta = _ridge_solve(*g.total(exclude=f), a)
                rows.append((float(a), int(f), *_fold_errors(g.folds[f], m, sd, ybar, beta)))
        return _grid_frame(spark, rows, _spread(g))
    from .quantiles import quantiles
    ks = sorted(r[0] for r in df.select(fold).distinct().collect())  # the k fold labels
    # every row joins the training side of each fold it does not belong to
    trains = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k != F.col(fold))
    ex = df.select(F.col(y).cast("double").alias("_y"), F.explode(trains).alias("_k"))
    cut = {(int(r["_k"]), float(r["p"])): r["q"] for r in quantiles(ex, "_y", list(winsor), group=["_k"]).collect()}
    clipped = [F.least(F.greatest(F.col(y), F.lit(cut[(k, float(winsor[0]))])), F.lit(cut[(k, float(winsor[1]))]))
               .alias(f"_yc{i}") for i, k in enumerate(ks)]
    extra = [f"_yc{i}" for i in range(len(ks))]
    g = FoldGram(df.select(fold, *feats, y, *clipped), feats + extra, y, fold, like_y=len(extra))
    nf = len(feats)
    rows = []
    for a in alphas:
        for i, f in enumerate(ks):
            n, s_, Q = g.total(exclude=f)
            idx = list(range(nf)) + [nf + i]  # train on the fold's own clipped target
            m, sd, ybar, beta = _ridge_solve(n, s_[idx], Q[np.ix_(idx, idx)], a)
            nk, sk, Qk = g.folds[f]
            ev = list(range(nf)) + [len(sk) - 1]  # evaluate on the original target
            rows.append((float(a), int(f), *_fold_errors((nk, sk[ev], Qk[np.ix_(ev, ev)]), m, sd, ybar, beta)))
    return _grid_frame(spark, rows, _spread(g))


def _soft(v: float, t: float) -> float:
    return float(np.sign(v) * max(abs(v) - t, 0.0))


def _elastic_solve(n, s, Q, l1: float, l2: float, beta, tol: float = 1e-10, sweeps: int = 10_000):
    """Elastic net by coordinate descent on the correlations of ``[x..., y]``, started at ``beta``.

    Minimises ``|y - xb|^2 / 2n + l1 |b|_1 + l2 |b|^2 / 2`` over population-standardised x and y.
    Returns ``(means, sds, mean of y, coefficients in units of y, coefficients)``.
    """
    k = len(s) - 1
    m = s / n
    cov = Q / n - np.outer(m, m)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    sd = np.where(sd == 0, 1.0, sd)
    corr = cov / np.outer(sd, sd)
    A, b = corr[:k, :k], corr[:k, k]
    beta = np.array(beta, dtype=float)
    for _ in range(sweeps):
        step = 0.0
        for j in range(k):
            if A[j, j] <= 0:  # a constant column
                beta[j] = 0.0
                continue
            new = _soft(b[j] - A[j] @ beta + A[j, j] * beta[j], l1) / (A[j, j] + l2)
            step, beta[j] = max(step, abs(new - beta[j])), new
        if step < tol:
            break
    return m[:k], sd[:k], m[k], beta * sd[k], beta


def elastic_grid(spark: SparkSession, df: DataFrame, feats: Sequence[str], y: str, fold: str,
                 alphas: Sequence[float], l1_ratio: float = 0.5) -> DataFrame:
    """M5: elastic-net alpha grid under (grouped) CV from one grouped Gram aggregate.

    The rows are read for the means and the moments only; every (alpha, fold) fit is a coordinate
    descent on the training folds' moments, from the fit of the next larger alpha. ``alpha`` is in
    units of y, as Spark ML's ``regParam`` is. Returns (alpha, fold, r2, pooled_r2).
    """
    g = FoldGram(df, feats, y, fold)
    rows = []
    for f in sorted(g.folds):
        n, s, Q = g.total(exclude=f)
        sd_y = float(np.sqrt(max(Q[-1, -1] / n - (s[-1] / n) ** 2, 0.0))) if n else 0.0
        beta = np.zeros(len(g.feats))
        for a in sorted(alphas, reverse=True):
            if sd_y == 0:  # nothing to learn from: the mean, or zero without rows
                k = len(beta)
                fit = np.zeros(k), np.ones(k), (s[-1] / n if n else 0.0), beta
            else:
                *fit, beta = _elastic_solve(n, s, Q, l1_ratio * a / sd_y, (1.0 - l1_ratio) * a / sd_y, beta)
            rows.append((float(a), int(f), *_fold_errors(g.folds[f], *fit)))
    return _grid_frame(spark, rows, _spread(g))


def fair_irls(df: DataFrame, feats: Sequence[str], y: str, c_fair: float = 1.0, iters: int = 6) -> np.ndarray:
    """M8 (Fair loss): iteratively reweighted least squares, one weighted Gram aggregate per iteration.

    The sums are taken about the column means, so large means lose no digits; rows with a null in
    any column are left out. Returns ``[intercept, beta...]`` on the raw features.
    """
    cols = [*feats, y]
    mean = np.array(_means(df, cols))
    beta = np.zeros(len(cols))
    for _ in range(iters):
        def weight(x, b=beta):
            return 1.0 / (1.0 + np.abs(x[:, -1] - b[0] - x[:, :-1] @ b[1:]) / c_fair)
        (n, s, Q), = gram(df, cols, mean, weight=weight).values()
        A = np.block([[np.array([[n]]), s[None, :-1]], [s[:-1, None], Q[:-1, :-1]]])
        beta = np.linalg.solve(A + 1e-9 * np.eye(len(A)), np.concatenate([[s[-1]], Q[:-1, -1]]))
    return np.concatenate([[beta[0] + mean[-1] - beta[1:] @ mean[:-1]], beta[1:]])


# M7, M9-M12, A24 ---------------------------------------------------------------
def gbt(seed: int = 42, max_iter: int = 8, depth: int = 3, loss: str = "squared", validation: str | None = None,
        step: float = 0.1):
    extra = {"validationIndicatorCol": validation, "validationTol": 0.01} if validation else {}
    return GBTRegressor(labelCol="label", maxIter=max_iter, maxDepth=depth, stepSize=step, seed=seed, lossType=loss,
                        subsamplingRate=0.8, **extra)


def forest(seed: int = 42, trees: int = 12, depth: int = 4):
    return RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)


FITS = 4                  # fits of one set of rows that run at the same time, to fill idle cores
FIT_ROWS = 40_000_000     # rows that these fits may read together: each keeps the bins of its own


class FoldRows:
    """Rows for fits under folds: read and assembled once, kept on the executors' disks until the block ends.

    Takes the place of the table in :func:`cv_oof`, so several calls share the rows. The executors'
    memory is left to the learners, which keep their own copy.
    """

    def __init__(self, df: DataFrame, feats: Sequence[str], y: str, fold: str, id_col: str = "id",
                 early_stopping: bool = False):
        ensure_checkpoint_dir(df.sparkSession)
        self.sparkSession = df.sparkSession
        self.assembler, = features_pipeline(feats, standardize=False)[:-1]
        data = self.assembler.transform(df.withColumn("label", F.col(y).cast("double"))).select(id_col, fold, "label", "raw")
        if early_stopping:
            from ..functions.expr import hash01
            data = data.withColumn("_val", hash01(id_col, 99) < 0.1)
        self.data = data.persist(StorageLevel.DISK_ONLY)
        sizes = {r[0]: r["count"] for r in self.data.groupBy(fold).count().collect()}   # the k fold labels
        self.folds, self.n = sorted(sizes), sum(sizes.values())
        self.slots = Semaphore(max(1, min(FITS, FIT_ROWS // max(1, self.n))))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.data.unpersist()

    def count(self) -> int:
        return self.n


def _at_once(spark: SparkSession, fn, items: Sequence) -> list:
    """``fn`` of every item, in their order, each in a thread of its own."""
    if len(items) < 2:
        return [fn(x) for x in items]
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items, chunksize=1)


def cv_oof(df: DataFrame | FoldRows, feats: Sequence[str], y: str, fold: str, make_est, id_col: str = "id",
           early_stopping: bool = False, test: DataFrame | None = None, only: Sequence[int] | None = None):
    """M7: fit on ``fold != k``, predict ``fold == k`` for every fold; union = out-of-fold predictions.

    Returns ``(oof, importances, test_preds)``: OOF ``(id, fold, y, pred)``, per-fold feature
    importances ``(fold, feature, gain)`` and, if ``test`` is given, per-fold test predictions.
    ``early_stopping`` (M10) marks a hash-chosen 10 % of the training fold as validation. With
    ``only`` just those folds are held out and scored, each by a model of all the other folds.
    The fits are independent of each other and run at the same time as far as ``FIT_ROWS`` allows.
    """
    if not isinstance(df, FoldRows):
        with FoldRows(df, feats, y, fold, id_col, early_stopping) as rows:
            return cv_oof(rows, feats, y, fold, make_est, id_col, early_stopping, test, only)
    data, spark = df.data, df.sparkSession
    folds = [k for k in df.folds if only is None or k in only]

    def fitted(k):
        with df.slots:
            return make_est().setFeaturesCol("raw").fit(data.filter(F.col(fold) != k))

    oof, imps, tests = None, [], None
    for k, model in zip(folds, _at_once(spark, fitted, folds)):
        p = model.transform(data.filter(F.col(fold) == k)).select(id_col, fold, F.col("label").alias(y),
                                                                    F.col("prediction").alias("pred"))
        oof = p if oof is None else oof.unionByName(p)
        if hasattr(model, "featureImportances"):
            imps += [(int(k), f, float(v)) for f, v in zip(feats, model.featureImportances.toArray())]
        if test is not None:
            tp = model.transform(df.assembler.transform(test)).select(id_col, F.lit(int(k)).alias(fold), F.col("prediction").alias("pred"))
            tests = tp if tests is None else tests.unionByName(tp)
    imp_df = spark.createDataFrame(imps, "fold int, feature string, gain double") if imps else None
    oof = written(oof, "oof")  # OOF on the shared folder, column by column: the rows kept for the fits may go
    if tests is not None:
        tests = written(tests, "tests")
    return oof, imp_df, tests


def fold_mean_score(test_preds: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean of per-fold test predictions by ID."""
    return test_preds.groupBy(id_col).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_models"))


def seed_average(preds: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Union of per-seed predictions, averaged by ID."""
    u = preds[0]
    for p in preds[1:]:
        u = u.unionByName(p)
    return u.groupBy(id_col).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_seeds"))


# M14 ---------------------------------------------------------------------------
def drift_rank(train: DataFrame, test: DataFrame, feats: Sequence[str], id_col: str = "id", batch: int = 100,
               drop: int = 85, folds: int = 3, seed: int = 42) -> DataFrame:
    """Adversarial validation - classify train vs test from each batch of features under folds
    by the hash of the id; ``auc`` is over the held-out scores of the batch, ``importance`` the mean
    over its folds. Features are ranked by importance over all batches, the first ``drop`` are to go.
    """
    from ..functions.expr import hash01
    from .metrics import auc
    rows = (train.select(id_col, *feats).withColumn("label", F.lit(0.0))
            .unionByName(test.select(id_col, *feats).withColumn("label", F.lit(1.0))))
    u = rows.withColumn("_fold", F.floor(hash01(id_col, seed) * folds).cast("int")).checkpoint()
    found = []
    for i in range(0, len(feats), batch):
        some = list(feats[i:i + batch])
        scored, gain = None, np.zeros(len(some))
        for k in range(folds):
            clf = GBTClassifier(labelCol="label", maxIter=8, maxDepth=3, seed=seed)
            m = make_pipeline(some, clf, standardize=False).fit(u.filter(F.col("_fold") != k))
            gain += m.stages[-1].featureImportances.toArray() / folds
            p = m.transform(u.filter(F.col("_fold") == k)).select("label", vector_to_array("probability")[1].alias("score"))
            scored = p if scored is None else scored.unionByName(p)
        a = float(auc(scored, "label", "score").first()["auc"])
        found += [(f, i // batch, float(v), a) for f, v in zip(some, gain)]
    found.sort(key=lambda t: (-t[2], t[0]))
    return train.sparkSession.createDataFrame(
        [(f, n, v, r, a, r <= drop) for r, (f, n, v, a) in enumerate(found, 1)],
        "feature string, batch int, importance double, rank int, auc double, dropped boolean")


# M15, M16, M22 -----------------------------------------------------------------
def evidence_ridge(n: float, s: np.ndarray, Q: np.ndarray, iters: int = 300, tol: float = 1e-10,
                   prior: float = 1e-6) -> tuple[np.ndarray, float, float, float]:
    """(coefficients, intercept, noise precision, weight precision) of a Gaussian linear model whose
    two precisions maximise the evidence by fixed-point updates, from the moments of ``[x..., y]``."""
    k = len(s) - 1
    C = Q - np.outer(s, s) / n
    S, b, yy = C[:k, :k], C[:k, k], C[k, k]
    val, vec = np.linalg.eigh(S)
    val = np.clip(val, 0.0, None)
    turned = vec.T @ b
    alpha, lam = (n / yy if yy > 0 else 1.0), 1.0
    coef = np.zeros(k)
    for _ in range(iters):
        last, coef = coef, vec @ (turned / (val + lam / alpha))
        used = float(np.sum(alpha * val / (lam + alpha * val)))
        sse = max(float(yy - 2 * coef @ b + coef @ S @ coef), 0.0)
        lam = (used + 2 * prior) / (float(coef @ coef) + 2 * prior)
        alpha = (n - used + 2 * prior) / (sse + 2 * prior)
        if np.abs(coef - last).sum() < tol:
            break
    return coef, float((s[k] - coef @ s[:k]) / n), float(alpha), float(lam)


def stack_fit(oof_wide: DataFrame, base_cols: Sequence[str], y: str, scale: float = 1.15):
    """Linear meta-model on out-of-fold base predictions, its noise and weight precisions by
    evidence updates from one Gram aggregate; returns ``(terms, rows with stacked)``, output scaled."""
    g = FoldGram(oof_wide, base_cols, y, None)
    coef, intercept, alpha, lam = evidence_ridge(*g.total())
    mean = np.array(g.mean)
    intercept += float(mean[-1] - coef @ mean[:-1])
    out = lit_d(intercept)
    for x, v in zip(base_cols, coef):
        out = out + F.col(x).cast("double") * lit_d(float(v))
    terms = {"intercept": intercept, "alpha": alpha, "lambda": lam, **dict(zip(base_cols, coef.tolist()))}
    return terms, oof_wide.withColumn("stacked", out * lit_d(scale))


def residual_fit(df: DataFrame, feats: Sequence[str], y: str, base: Column, make_est, fold: str, id_col: str = "id",
                 test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Learn ``y - base`` under folds and add the base margin back: out-of-fold rows
    ``(id, y, base, pred)`` and, with ``test``, its rows' predictions averaged over the folds' models."""
    data = df.withColumn("_base", base).withColumn("_res", (F.col(y) - F.col("_base")).cast("double"))
    oof, _, tests = cv_oof(data, feats, "_res", fold, make_est, id_col, test=test)
    rows = (oof.select(id_col, "pred").join(data.select(id_col, y, F.col("_base").alias("base")), id_col)
            .withColumn("pred", F.col("base") + F.col("pred")))
    if tests is not None:
        tests = (fold_mean_score(tests, id_col).join(test.select(id_col, base.alias("base")), id_col)
                 .withColumn("pred", F.col("base") + F.col("pred")))
    return rows, tests


# M18, M19, M23 -----------------------------------------------------------------
def tune(df: DataFrame, feats: Sequence[str], y: str, fold: str, n_trials: int = 4, seed: int = 42,
         only: Sequence[int] | None = None) -> DataFrame:
    """Bounded random search - exactly ``n_trials`` seeded draws of depth and step, each scored by
    the R^2 of its out-of-fold predictions (of the folds ``only``, if given)."""
    from .metrics import regression_metrics
    rng = np.random.default_rng(seed)
    trials = [(t, int(rng.integers(2, 6)), float(round(rng.uniform(0.05, 0.3), 3))) for t in range(n_trials)]

    with FoldRows(df, feats, y, fold) as data:
        def scored(trial):
            _, depth, step = trial
            oof, _, _ = cv_oof(data, feats, y, fold, lambda: gbt(seed, depth=depth, step=step), only=only)
            # sums meet in any order: digits beyond the twelfth differ from run to run
            return (*trial, round(float(regression_metrics(oof, y, "pred").first()["r2"]), 12))

        rows = _at_once(df.sparkSession, scored, trials)
    return df.sparkSession.createDataFrame(rows, "trial int, max_depth int, step_size double, r2 double")


def tune_pruned(df: DataFrame, feats: Sequence[str], y: str, fold: str, n_trials: int = 8, seed: int = 42,
                startup: int = 3, draw=None) -> DataFrame:
    """M18 with pruning: seeded draws, scored fold by fold, all trials at the same time, stopped by the median rule.

    After each fold the trial's R^2 over the rows predicted so far is held against the median of
    the earlier trials' R^2 after as many folds; a trial below it is stopped. The first ``startup``
    trials run through. ``draw(rng)`` gives a trial's ``(depth, step, learner)``. Returns (trial,
    max_depth, step_size, folds_scored, pruned, r2), with r2 over the folds scored. Boosted trees
    that differ in depth, step and rounds only grow in the same passes over the rows.
    """
    from . import gbt as G
    from .metrics import regression_metrics

    def default(rng):
        depth, step = int(rng.integers(2, 6)), float(round(rng.uniform(0.05, 0.3), 3))
        return depth, step, lambda: gbt(seed, depth=depth, step=step)

    rng = np.random.default_rng(seed)
    trials = [(draw or default)(rng) for _ in range(n_trials)]
    scores: list[list[float]] = [[] for _ in trials]
    oof: dict = {}
    alive, pruned = list(range(n_trials)), set()
    learners = [make() for _, _, make in trials]
    together = G.fits(learners)
    with nullcontext(G.FoldBlocks(df, feats, y, fold)) if together else FoldRows(df, feats, y, fold) as data:
        for i, k in enumerate(data.folds):
            scored = data.score(k, {t: learners[t] for t in alive}) if together else None

            def score(t):
                if together:
                    part = scored.select(F.col("y").alias(y), F.col(f"p{t}").alias("pred"))
                else:
                    part, _, _ = cv_oof(data, feats, y, fold, trials[t][2], only=[k])
                oof[t] = oof[t].unionByName(part) if t in oof else part
                r2 = regression_metrics(oof[t], y, "pred").first()["r2"]
                scores[t].append(0.0 if r2 is None else float(r2))

            _at_once(df.sparkSession, score, alive)   # a trial's next fold waits for no later trial
            reached: list[float] = []   # scores of earlier trials after as many folds
            for t in list(alive):
                if t >= startup and reached and scores[t][-1] < float(np.median(reached)) and i + 1 < len(data.folds):
                    pruned.add(t)
                    alive.remove(t)
                reached.append(scores[t][-1])
    rows = [(t, depth, step, len(scores[t]), t in pruned, scores[t][-1] if scores[t] else None)
            for t, (depth, step, _) in enumerate(trials)]
    return df.sparkSession.createDataFrame(
        rows, "trial int, max_depth int, step_size double, folds_scored int, pruned boolean, r2 double")


def refit_score(train: DataFrame, test: DataFrame, feats: Sequence[str], y: str, reg: float = 0.1,
                id_col: str = "id") -> DataFrame:
    """Refit the chosen setting on all labelled rows and score the unlabelled table."""
    lr = LinearRegression(labelCol="label", regParam=reg, elasticNetParam=0.0, solver="normal")
    m = make_pipeline(feats, lr).fit(train.withColumn("label", F.col(y).cast("double")))
    return m.transform(test).select(id_col, F.col("prediction").alias("pred"))


def save_load_roundtrip(model: PipelineModel, path: str) -> PipelineModel:
    """Persist a fitted pipeline and load it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def pca_fit_array(train: DataFrame, col: str, k: int) -> PipelineModel:
    """M2 on an array column: standardise + PCA fitted on ``train`` only (use ``pca_apply`` on any frame)."""
    from pyspark.ml.functions import array_to_vector
    v = train.withColumn("_vec", array_to_vector(F.col(col)))
    return Pipeline(stages=[StandardScaler(inputCol="_vec", outputCol="_std", withMean=True, withStd=True),
                            PCA(k=k, inputCol="_std", outputCol="_pca")]).fit(v)


def pca_apply(model: PipelineModel, df: DataFrame, col: str, out: str = "pcs") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    v = df.withColumn("_vec", array_to_vector(F.col(col)))
    return model.transform(v).withColumn(out, vector_to_array("_pca")).drop("_vec", "_std", "_pca")
