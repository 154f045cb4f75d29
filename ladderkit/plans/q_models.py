"""Step 12 queries: model steps on Spark ML / Gram aggregates (rows-only checks; see tests for invariants).

Learners differ from the reference's native boosting libraries, so the numbers
are not comparable with its logged scores; what is checked is the mechanics:
fold hygiene, OOF coverage, determinism, grid shapes and closed-form identities.
"""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.book import oscillators
from ..functions.expr import clean, hash01, lit_d, rndf
from ..operators import folds as Fo
from ..operators import ml as M
from ..operators import trees as T
from ..operators.metrics import importance_mean, regression_metrics
from ..operators.windows import forward_block
from ..session import ensure_checkpoint_dir, written
from . import sqlgen as S
from .fixtures import v_preds, v_ticks, v_wide, with_views
from .q_folds import GREEDY_CTES
from .registry import register

FEATS = [f"f{i}" for i in range(1, 9)]
BASE_FEATS = ["f1", "f2", "f8"]
ALPHAS = [10.0 ** e for e in range(-2, 7)]


def _wide_folds(spark, sf):
    """Features and group folds, written once: every fit of a query reads the copy."""
    return Fo.group_kfold(v_wide(spark, sf), "grp", 5, method="greedy").checkpoint()


def _round_metrics(df, keep):
    return df.select(*keep, *[rndf(c).alias(c) for c in df.columns if c not in keep])


_STD_SQL = with_views("v_wide", extra=[
    "s AS (SELECT grp, COUNT(*) AS n FROM v_wide GROUP BY grp)",
    "fm AS (SELECT grp, (row_number() OVER (ORDER BY n DESC, grp) - 1) % 5 AS fold FROM s)",
    "d AS (SELECT v.*, fm.fold FROM v_wide v JOIN fm ON fm.grp = v.grp)",
    "st AS (SELECT " + ", ".join(f"AVG(f{i}) AS m{i}, stddev_samp(f{i}) AS s{i}" for i in range(1, 9)) + " FROM d WHERE fold <> 0)",
    "z AS (" + "\nUNION ALL\n".join(f"SELECT {i - 1} AS i, (f{i} - m{i}) / s{i} AS v FROM d CROSS JOIN st WHERE fold = 0"
                                     for i in range(1, 9)) + ")"]) + f"""
SELECT CAST(i AS INTEGER) AS i, {S.r('AVG(v)', 5)} AS mean, {S.r('stddev_samp(v)', 5)} AS std FROM z GROUP BY i"""


@register("standardize", _STD_SQL)
def standardize(spark, sf):
    """M1: scaler fitted on the training folds only (round-robin group folds), applied to the held-out fold."""
    d = Fo.group_kfold(v_wide(spark, sf), "grp", 5, method="round_robin")
    tr, te = d.filter("fold <> 0"), d.filter("fold = 0")
    m = M.standardize_fit(tr, FEATS)
    from pyspark.ml.functions import vector_to_array
    z = m.transform(te).select(vector_to_array("std").alias("z"))
    return z.select(F.posexplode("z").alias("i", "v")).groupBy("i").agg(
        (F.round(F.avg("v"), 5) + 0.0).alias("mean"), (F.round(F.stddev_samp("v"), 5) + 0.0).alias("std"))


@register("pca")
def pca(spark, sf):
    """M2: PCA to all components after standardisation; variance of each score column."""
    s = M.pca_scores(v_wide(spark, sf), FEATS, len(FEATS))
    return s.select(F.posexplode("pcs").alias("component", "v")).groupBy("component").agg(
        rndf(F.var_pop("v")).alias("variance"))


def _inv_norm_sql(p: str) -> str:
    """SQL twin of :func:`ladderkit.operators.ml.inv_norm_cdf` (same Horner order and constants)."""
    a, b, cc, d = M.ACKLAM

    def lit(v):
        return f"CAST({v!r} AS DOUBLE)"

    def poly(coef, x):
        out = lit(coef[0])
        for k in coef[1:]:
            out = f"(({out}) * ({x}) + {lit(k)})"
        return out

    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    central = f"(({poly(a, r)}) * {q} / (({poly(b, r)}) * {r} + 1.0))"

    def tail(x):
        den = f"((((({lit(d[0])} * {x} + {lit(d[1])}) * {x} + {lit(d[2])}) * {x} + {lit(d[3])}) * {x}) + 1.0)"
        return poly(cc, x), den
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    nl, dl = tail(ql)
    nh, dh = tail(qh)
    return (f"CASE WHEN {p} < 0.02425 THEN ({nl}) / {dl} WHEN {p} > {1 - 0.02425!r} THEN (-({nh})) / {dh} "
            f"ELSE {central} END")


@register("quantile_normal", with_views("v_preds", extra=[
    "r AS (SELECT id, (row_number() OVER (ORDER BY p2, id) - 1 + 0.5) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) AS p "
    "FROM v_preds)"]) + f"SELECT id, {S.rf(_inv_norm_sql('p'))} AS qnorm FROM r")
def quantile_normal(spark, sf):
    """M3: rank -> inverse normal CDF (global rank via the dense index)."""
    q = M.quantile_normal(v_preds(spark, sf).select("id", "p2"), "p2", "id")
    return q.select("id", rndf("qnorm").alias("qnorm"))


def _grid_ctes(feats, alphas, tag=""):
    """CTEs of a ridge grid under the greedy folds: errors (alpha, fold, sse, sst) per held-out fold as ``err<tag>``."""
    k = len(feats)
    pred = " + ".join(f"m[{i}][{k + 1}] * ({f} - mean[{i}]) / sd[{i}]" for i, f in enumerate(feats, 1))
    means, sds = ", ".join(f"AVG({f})" for f in feats), ", ".join(S.pop_std(f) for f in feats)
    return f"""
, eq{tag} AS (SELECT held AS fold, AVG(target) AS ybar, [{means}] AS mean, [{sds}] AS sd, {S.normal_equations(feats, "target")} AS m
  FROM train GROUP BY held),
solve{tag} AS (SELECT alpha, fold, 1 AS k, {S.add_ridge("m", "alpha")} AS m FROM eq{tag}, (SELECT unnest({alphas}::DOUBLE[]) AS alpha)
  UNION ALL SELECT alpha, fold, k + 1, {S.solve_step("m", "k")} FROM solve{tag} WHERE k <= {k}),
err{tag} AS (SELECT alpha, fold, SUM((target - ybar - ({pred})) ** 2) AS sse, COUNT(*) * VAR_POP(target) AS sst
  FROM (SELECT alpha, fold, m FROM solve{tag} WHERE k = {k + 1}) JOIN (SELECT fold, ybar, mean, sd FROM eq{tag}) USING (fold)
  JOIN folded USING (fold) GROUP BY alpha, fold)"""


_FOLDED = GREEDY_CTES + """, folded AS (SELECT v_wide.*, g.fold FROM v_wide JOIN g USING (grp)),
train AS (SELECT h.fold AS held, folded.* FROM folded JOIN (SELECT DISTINCT fold FROM folded) h ON folded.fold <> h.fold)"""


@register("ridge_grid", _FOLDED + _grid_ctes(FEATS, ALPHAS) + f"""
SELECT alpha, fold, {S.rf("1 - sse / sst")} AS r2,
       {S.rf("1 - SUM(sse) OVER (PARTITION BY alpha) / (SELECT COUNT(*) * VAR_POP(target) FROM folded)")} AS pooled_r2 FROM err""")
def ridge_grid(spark, sf):
    """M4: ridge alpha grid under group 5-fold CV from one grouped Gram aggregate."""
    return _round_metrics(M.ridge_grid(spark, _wide_folds(spark, sf), FEATS, "target", "fold", ALPHAS),
                          ["alpha", "fold"])


@register("ridge_grid_winsor")
def ridge_grid_winsor(spark, sf):
    """M4 (winsorised target): training targets clipped at 1/99 % of each training fold, R^2 on the original."""
    g = M.ridge_grid(spark, _wide_folds(spark, sf), FEATS, "target", "fold", [1.0, 100.0, 10000.0], winsor=(0.01, 0.99))
    return _round_metrics(g, ["alpha", "fold"])


@register("ablation", _FOLDED + _grid_ctes(BASE_FEATS, [1.0, 100.0], "_base") + _grid_ctes(FEATS, [1.0, 100.0], "_all")
          + " UNION ALL ".join(f"""
SELECT alpha, {S.rf("AVG(1 - sse / sst)")} AS mean_r2, '{name}' AS feature_set FROM err_{name} GROUP BY alpha""" for name in ("base", "all")))
def ablation(spark, sf):
    """Base columns only vs all columns, mean held-out R^2 per alpha."""
    d = _wide_folds(spark, sf)
    out = None
    for name, feats in (("base", BASE_FEATS), ("all", FEATS)):
        g = M.ridge_grid(spark, d, feats, "target", "fold", [1.0, 100.0]).groupBy("alpha").agg(
            rndf(F.avg("r2")).alias("mean_r2")).withColumn("feature_set", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


@register("elastic_grid")
def elastic_grid(spark, sf):
    """M5: elastic net (l1 ratio 0.5) alpha grid from one Gram aggregate, R^2 per held-out fold and, with a
    null fold, pooled."""
    g = M.elastic_grid(spark, _wide_folds(spark, sf), FEATS, "target", "fold", [0.0001, 0.001, 0.01])
    per = g.select("alpha", "fold", rndf("r2").alias("r2"))
    return per.unionByName(g.select("alpha", F.lit(None).cast("int").alias("fold"), rndf("pooled_r2").alias("r2")).distinct())


@register("cv_oof")
def cv_oof(spark, sf):
    """M7 + M9 + M10: boosted trees with early stopping under group folds; per-fold metrics."""
    oof, _, _ = M.cv_oof(_wide_folds(spark, sf), FEATS, "target", "fold", lambda: M.gbt(validation="_val"),
                         early_stopping=True)
    return _round_metrics(regression_metrics(oof, "target", "pred", ["fold"]), ["fold", "n"])


@register("symmetric_trees")
def symmetric_trees(spark, sf):
    """M9: boosted symmetric trees (one cut a level) of all folds at once; out-of-fold metrics per fold."""
    oof, _ = T.boosted_oof(_wide_folds(spark, sf), FEATS, "target", "fold", rounds=6, depth=4)
    return _round_metrics(regression_metrics(oof, "target", "pred", ["fold"]), ["fold", "n"])


@register("dart_trees")
def dart_trees(spark, sf):
    """M9: boosting that leaves out earlier trees by seed and rescales them; out-of-fold metrics per fold."""
    oof, _ = T.boosted_oof(_wide_folds(spark, sf), FEATS, "target", "fold", rounds=8, depth=3, symmetric=False, drop=0.1)
    return _round_metrics(regression_metrics(oof, "target", "pred", ["fold"]), ["fold", "n"])


@register("importance_mean")
def importance_mean_q(spark, sf):
    """Mean feature importance over folds (random forest, group folds)."""
    _, imp, _ = M.cv_oof(_wide_folds(spark, sf), FEATS, "target", "fold", lambda: M.forest())
    return _round_metrics(importance_mean(imp, "feature", "gain"), ["feature", "n"])


@register("top_importance")
def top_importance(spark, sf):
    """The top-3 features by fold-averaged importance (a top-k report)."""
    _, imp, _ = M.cv_oof(_wide_folds(spark, sf), FEATS, "target", "fold", lambda: M.forest())
    top = importance_mean(imp, "feature", "gain").orderBy(F.col("mean_gain").desc(), "feature").limit(3)
    return _round_metrics(top, ["feature", "n"])


@register("robust_fit")
def robust_fit(spark, sf):
    """M8: Huber (linear), absolute-loss boosting and Fair-loss IRLS; R^2 of each on a held-out group fold."""
    d = _wide_folds(spark, sf).withColumn("label", F.col("target"))
    tr, te = d.filter("fold <> 0"), d.filter("fold = 0")
    hub = M.make_pipeline(FEATS, LinearRegression(labelCol="label", loss="huber", regParam=0.0, maxIter=50)).fit(tr)
    gab = M.make_pipeline(FEATS, M.gbt(loss="absolute"), standardize=False).fit(tr)
    beta = M.fair_irls(tr, FEATS, "target")
    fair = lit_d(beta[0])
    for i, f in enumerate(FEATS):
        fair = fair + F.col(f) * lit_d(beta[i + 1])
    parts = [regression_metrics(hub.transform(te), "label", "prediction").withColumn("model", F.lit("huber")),
             regression_metrics(gab.transform(te), "label", "prediction").withColumn("model", F.lit("gbt_absolute")),
             regression_metrics(te.withColumn("prediction", fair), "label", "prediction").withColumn("model", F.lit("fair_irls"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _round_metrics(out, ["model", "n"])


@register("seed_average")
def seed_average(spark, sf):
    """Three seeds of a subsampled forest averaged by ID."""
    d = v_wide(spark, sf).withColumn("label", F.col("target")).checkpoint()
    preds = []
    for seed in (1, 2, 3):
        m = M.make_pipeline(FEATS, M.forest(seed=seed, trees=6), standardize=False).fit(d)
        preds.append(m.transform(d).select("id", F.col("prediction").alias("pred")))
    avg = M.seed_average(preds)
    return avg.select("id", "n_seeds", rndf("pred").alias("pred"))


@register("fold_mean")
def fold_mean(spark, sf):
    """Per-fold models score the holdout rows; predictions averaged by ID."""
    d = _wide_folds(spark, sf)
    hold = hash01("id") < 0.2
    _, _, tests = M.cv_oof(d.filter(~hold), FEATS, "target", "fold", lambda: M.gbt(), test=d.filter(hold))
    fm = M.fold_mean_score(tests)
    return fm.select("id", "n_models", rndf("pred").alias("pred"))


@register("stack_fit")
def stack_fit(spark, sf):
    """OOF boosted-tree and ridge predictions + oscillators into an evidence-tuned meta-model, x1.15."""
    d = _wide_folds(spark, sf)
    with M.FoldRows(d, FEATS, "target", "fold") as rows:
        gb, _, _ = M.cv_oof(rows, FEATS, "target", "fold", lambda: M.gbt())
        lr, _, _ = M.cv_oof(rows, FEATS, "target", "fold",
                            lambda: LinearRegression(labelCol="label", regParam=0.1, solver="normal"))
    osc = oscillators(FEATS, len(FEATS) // 2)
    names = [f"osc_{i}" for i in range(len(osc))]
    wide = (gb.select("id", "target", F.col("pred").alias("p_gbt"))
            .join(lr.select("id", F.col("pred").alias("p_lr")), "id").join(d.select("id", *osc), "id"))
    wide = written(wide, "stack")   # means, moments and metrics each read it: the joins run once
    _, out = M.stack_fit(wide, ["p_gbt", "p_lr", *names], "target")
    return _round_metrics(regression_metrics(out, "target", "stacked"), ["n"])


@register("residual_fit")
def residual_fit(spark, sf):
    """Learn the residual over a base margin (1.5 * f1) under group folds and add it back."""
    out, _ = M.residual_fit(_wide_folds(spark, sf), FEATS, "target", F.col("f1") * 1.5, lambda: M.gbt(), "fold")
    base = regression_metrics(out, "target", "base").withColumn("model", F.lit("base"))
    res = regression_metrics(out, "target", "pred").withColumn("model", F.lit("base_plus_residual"))
    return _round_metrics(base.unionByName(res), ["model", "n"])


@register("tune")
def tune(spark, sf):
    """Bounded, seeded random search; each trial is scored on the out-of-fold rows of all group folds."""
    return _round_metrics(M.tune(_wide_folds(spark, sf), FEATS, "target", "fold"), ["trial", "max_depth"])


@register("tune_pruned")
def tune_pruned(spark, sf):
    """Seeded search whose trials are scored fold by fold and stopped by the median rule."""
    d = Fo.group_kfold(v_wide(spark, sf), "grp", 5, method="greedy")   # read once: the search writes its rows itself
    t = M.tune_pruned(d, FEATS, "target", "fold", n_trials=5, startup=2)
    return t.select("trial", "max_depth", "step_size", "folds_scored", "pruned", rndf("r2").alias("r2"))


@register("compare_params")
def compare_params(spark, sf):
    """Capacity comparison - boosted trees per parameter set, two folds scored, each by a model of the others."""
    out = None
    with M.FoldRows(_wide_folds(spark, sf), FEATS, "target", "fold") as rows:
        for depth, it in ((2, 5), (3, 8), (4, 8), (5, 8), (3, 16)):
            oof, _, _ = M.cv_oof(rows, FEATS, "target", "fold", lambda: M.gbt(max_iter=it, depth=depth), only=[0, 1])
            r = regression_metrics(oof, "target", "pred").select(F.lit(depth).alias("max_depth"), F.lit(it).alias("max_iter"),
                                                                 rndf("r2").alias("r2"))
            out = r if out is None else out.unionByName(r)
    return out


@register("blend_fold")
def blend_fold(spark, sf):
    """Fixed 0.7 boosted trees + 0.3 ridge blend, per-fold R^2."""
    d = _wide_folds(spark, sf)
    with M.FoldRows(d, FEATS, "target", "fold") as rows:
        gb, _, _ = M.cv_oof(rows, FEATS, "target", "fold", lambda: M.gbt())
        lr, _, _ = M.cv_oof(rows, FEATS, "target", "fold",
                            lambda: LinearRegression(labelCol="label", regParam=0.1, solver="normal"))
    j = gb.select("id", "fold", "target", F.col("pred").alias("a")).join(lr.select("id", F.col("pred").alias("b")), "id")
    j = j.withColumn("blend", F.col("a") * 0.7 + F.col("b") * 0.3)
    return _round_metrics(regression_metrics(j, "target", "blend", ["fold"]), ["fold", "n"])


@register("drift_rank")
def drift_rank(spark, sf):
    """Train-vs-test classifiers per batch of features with their held-out AUC; the top features are to go."""
    t = v_ticks(spark, sf)
    feats = ["price", "s2", "price_l1", "s2_l1"]
    t = t.select("id", "is_test", *[clean(f, null=0.0).alias(f) for f in feats])
    r = M.drift_rank(t.filter("is_test = 0"), t.filter("is_test = 1"), feats, batch=2, drop=1)
    return r.select("feature", "batch", "rank", "dropped", rndf("importance").alias("importance"), rndf("auc").alias("auc"))


def _forward_sql(n, reg):
    """Coefficients by the normal solver's definition: penalty ``reg`` / sd(y) on the correlation matrix."""
    cols = [f"fwd_{i}" for i in range(1, n + 1)]
    ratios = ", ".join(f"{S.nz(f'lead(price, {i}) OVER w - price', 'ABS(price) + 1e-8')} AS {c}" for i, c in enumerate(cols, 1))
    means, sds = ", ".join(f"AVG({c})" for c in cols), ", ".join(S.pop_std(c) for c in cols)
    coef = "list_transform(solve.m, lambda r, i: r[{0}] / sd[i])".format(n + 1)
    return with_views("v_ticks", extra=[
        f"f AS (SELECT target, is_test, {ratios} FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id))",
        f"""eq AS (SELECT AVG(target) AS ybar, COUNT(*) * {reg} / STDDEV_POP(target) AS penalty, [{means}] AS mean, [{sds}] AS sd,
  {S.normal_equations(cols, "target")} AS m FROM f WHERE is_test = 0 AND target IS NOT NULL)""",
        f"""solve AS (SELECT 1 AS k, {S.add_ridge("m", "penalty")} AS m FROM eq UNION ALL
  SELECT k + 1, {S.solve_step("m", "k")} FROM solve WHERE k <= {n})""",
        f"fit AS (SELECT ybar, mean, {coef} AS b FROM solve, eq WHERE k = {n + 1})",
    ]).replace("WITH ", "WITH RECURSIVE ", 1) + "".join(
        f"SELECT '{c}' AS term, {S.rf(f'b[{i}]')} AS coef FROM fit UNION ALL " for i, c in enumerate(cols, 1)) + (
        f"SELECT 'intercept' AS term, {S.rf('ybar - list_sum(list_transform(b, lambda v, i: v * mean[i]))')} AS coef FROM fit")


@register("forward_regression", _forward_sql(19, 0.001))
def forward_regression(spark, sf):
    """M6: ridge of the target on the next 19 price ratios (W3); coefficients."""
    fb = forward_block(v_ticks(spark, sf), "price", ["grp"], ["t", "id"], 19).filter("is_test = 0")
    cols = [f"fwd_{i}" for i in range(1, 20)]
    ok = F.col("target").isNotNull()
    for c_ in cols:
        ok = ok & F.col(c_).isNotNull()
    d = fb.filter(ok).withColumn("label", F.col("target"))
    m = M.make_pipeline(cols, LinearRegression(labelCol="label", regParam=0.001, solver="normal"), standardize=False).fit(d)
    lr = m.stages[-1]
    rows = [(c_, float(v)) for c_, v in zip(cols, lr.coefficients.toArray())] + [("intercept", float(lr.intercept))]
    return spark.createDataFrame(rows, "term string, coef double").select("term", rndf("coef").alias("coef"))


def _refit_sql(feats, reg=0.1):
    """The fit that Spark ML's normal solver defines: penalty ``reg`` / sd(y) on the correlation matrix."""
    k = len(feats)
    pred = " + ".join(f"m[{i}][{k + 1}] * ({f} - mean[{i}]) / sd[{i}]" for i, f in enumerate(feats, 1))
    means, sds = ", ".join(f"AVG({f})" for f in feats), ", ".join(S.pop_std(f) for f in feats)
    u = "CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0"
    return with_views("v_wide", extra=[
        f"u AS (SELECT *, {u} < 0.2 AS hold FROM v_wide)",
        f"""eq AS (SELECT AVG(target) AS ybar, COUNT(*) * {reg} / STDDEV_POP(target) AS penalty, [{means}] AS mean, [{sds}] AS sd,
  {S.normal_equations(feats, "target")} AS m FROM u WHERE NOT hold)""",
        f"""solve AS (SELECT 1 AS k, {S.add_ridge("m", "penalty")} AS m FROM eq UNION ALL
  SELECT k + 1, {S.solve_step("m", "k")} FROM solve WHERE k <= {k})""",
    ]).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT id, {S.rf(f"ybar + {pred}")} AS pred
FROM u, (SELECT ybar, mean, sd FROM eq), (SELECT m FROM solve WHERE k = {k + 1}) WHERE hold"""


@register("refit_score", _refit_sql(FEATS))
def refit_score(spark, sf):
    """Refit on all labelled rows and score the unlabelled ones."""
    d = v_wide(spark, sf)
    hold = hash01("id") < 0.2
    p = M.refit_score(d.filter(~hold), d.filter(hold), FEATS, "target")
    return p.select("id", rndf("pred").alias("pred"))


@register("save_load", with_views("v_wide") + "SELECT COUNT(*) AS n, CAST(0.0 AS DOUBLE) AS max_abs_diff FROM v_wide")
def save_load(spark, sf):
    """Persist a fitted pipeline to the shared folder, load it, check identical predictions."""
    d = v_wide(spark, sf).withColumn("label", F.col("target"))
    m = M.make_pipeline(FEATS, LinearRegression(labelCol="label", regParam=0.1, solver="normal")).fit(d)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/ladderkit-model-{uuid.uuid4().hex}"
    m2 = M.save_load_roundtrip(m, path)
    a = m.transform(d).select("id", F.col("prediction").alias("a"))
    b = m2.transform(d).select("id", F.col("prediction").alias("b"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
