"""Step 4 queries: regression metrics, per-fold metrics, ROC AUC, formula scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import hash_u32, lit_d, rndf, sdiv
from ..operators import metrics as Me
from . import sqlgen as S
from .fixtures import PRED_COLS, v_preds, v_ticks, with_views
from .q_folds import U32_SQL
from .registry import register


def _m(p):
    return (f"CAST(COUNT(*) AS BIGINT) AS n, {S.rf(f'1.0 - SUM(pow(y - {p}, 2)) / (var_pop(y) * COUNT(*))')} AS r2, "
            f"{S.rf(f'sqrt(AVG(pow(y - {p}, 2)))')} AS rmse, {S.rf(f'AVG(ABS(y - {p}))')} AS mae")


@register("r2_rmse_mae", with_views("v_preds") + "\nUNION ALL\n".join(
    f"SELECT '{p}' AS model, {_m(p)} FROM v_preds" for p in PRED_COLS))
def r2_rmse_mae(spark, sf):
    """R^2, RMSE and MAE of each prediction column (one unpivoted aggregate)."""
    p = v_preds(spark, sf)
    long = p.select("y", *PRED_COLS).unpivot(["y"], PRED_COLS, "model", "p")
    m = Me.regression_metrics(long, "y", "p", ["model"])
    return m.select("model", "n", *[rndf(c).alias(c) for c in ["r2", "rmse", "mae"]])


@register("fold_metrics", with_views("v_preds", extra=[
    f"f AS (SELECT CAST({U32_SQL} % 5 AS INTEGER) AS fold, y, p1 FROM v_preds)",
    f"per AS (SELECT fold, COUNT(*) AS n, 1.0 - SUM(pow(y - p1, 2)) / (var_pop(y) * COUNT(*)) AS r2, "
    f"sqrt(AVG(pow(y - p1, 2))) AS rmse, AVG(ABS(y - p1)) AS mae FROM f GROUP BY fold)"]) + f"""
SELECT fold, CAST(n AS BIGINT) AS n, {S.rf('r2')} AS r2, {S.rf('rmse')} AS rmse, {S.rf('mae')} AS mae,
       {S.rf('(SELECT AVG(r2) FROM per)')} AS mean_r2, {S.rf('(SELECT stddev_pop(r2) FROM per)')} AS std_r2 FROM per""")
def fold_metrics(spark, sf):
    """Per-fold R^2 / RMSE / MAE and sizes, plus mean and std of R^2 over folds."""
    p = v_preds(spark, sf).withColumn("fold", F.pmod(hash_u32("id"), F.lit(5)).cast("int"))
    per, _ = Me.fold_metrics(p, "y", "p1", "fold")
    folds = Window.partitionBy()  # over the k-row per-fold table only
    j = per.withColumn("mean_r2", F.avg("r2").over(folds)).withColumn("std_r2", F.stddev_pop("r2").over(folds))
    return j.select("fold", "n", *[rndf(c).alias(c) for c in ["r2", "rmse", "mae", "mean_r2", "std_r2"]])


@register("auc", with_views("v_preds", extra=[
    "l AS (SELECT CASE WHEN y > p1 THEN 1 ELSE 0 END AS label, p2 AS s FROM v_preds)",
    "r AS (SELECT label, rank() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l)"]) + f"""
SELECT {S.rf('(SUM(CASE WHEN label = 1 THEN rk END) - SUM(label) * (SUM(label) + 1) / 2.0) / (SUM(label) * (COUNT(*) - SUM(label)))')} AS auc,
       CAST(SUM(label) AS BIGINT) AS n_pos, CAST(COUNT(*) - SUM(label) AS BIGINT) AS n_neg FROM r""")
def auc(spark, sf):
    """Exact ROC AUC (tie-averaged rank sum) via per-score counts and a distributed running sum."""
    p = v_preds(spark, sf).withColumn("label", F.when(F.col("y") > F.col("p1"), 1).otherwise(0))
    a = Me.auc(p, "label", "p2")
    return a.select(rndf("auc").alias("auc"), "n_pos", "n_neg")


def _formulas():
    p, prev = F.col("price"), F.col("price") - F.col("price_l1")
    pos = (p > 0) & (prev > 0)
    d = p - prev
    return {
        "ret_simple": sdiv(lit_d(100.0) * d, prev),
        "ret_absden": sdiv(lit_d(100.0) * d, F.abs(prev) + lit_d(1e-10)),
        "ret_log": F.when(pos, lit_d(100.0) * F.ln(p / prev)),
        "diff": d,
        "sqrt_scaled": F.signum(d) * F.sqrt(F.abs(d)),
    }


_PREV = "(price - price_l1)"
_D = f"(price - {_PREV})"
_FSQL = {
    "ret_simple": f"CASE WHEN {_PREV} = 0 THEN NULL ELSE 100.0 * {_D} / {_PREV} END",
    "ret_absden": f"100.0 * {_D} / (ABS({_PREV}) + 1e-10)",
    "ret_log": f"CASE WHEN price > 0 AND {_PREV} > 0 THEN 100.0 * ln(price / {_PREV}) END",
    "diff": _D,
    "sqrt_scaled": f"sign({_D}) * sqrt(ABS({_D}))",
}


@register("score_formulas", with_views("v_ticks", extra=[
    "fx AS (" + "\nUNION ALL\n".join(f"SELECT '{n}' AS formula, target AS y, {e} AS p FROM v_ticks" for n, e in _FSQL.items()) + ")"]) + f"""
SELECT formula, CAST(COUNT(*) AS BIGINT) AS n, {S.rf(S.corr('p', 'y'))} AS corr,
       {S.rf('1.0 - SUM(pow(y - p, 2)) / (var_pop(y) * COUNT(*))')} AS r2,
       {S.rf('1.0 - SUM(pow(y - p * 0.01, 2)) / (var_pop(y) * COUNT(*))')} AS r2_scaled
FROM fx WHERE p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL GROUP BY formula""")
def score_formulas(spark, sf):
    """P15 + P18: a table of named return formulas, each scored against the target in one aggregate."""
    sc = Me.score_formulas(v_ticks(spark, sf), _formulas(), "target", scale=0.01)
    return sc.select("formula", "n", *[rndf(c).alias(c) for c in ["corr", "r2", "r2_scaled"]])
