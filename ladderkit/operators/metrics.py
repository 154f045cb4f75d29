"""Model-evaluation metrics (A12-A15, A24, P15, P16) as single aggregates.

R^2 uses ``n * var_pop(y)`` for the total sum of squares (a numerically stable
central moment) and a direct ``sum((y - p)^2)``; grouped variants are one
``groupBy`` with partial aggregation.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, lit_d, safe_corr
from .sequence import running_sum


def r2_col(y, p) -> Column:
    """A12 aggregate: ``1 - SSE / SST`` (NULL when the target is constant)."""
    y, p = c(y), c(p)
    ok = y.isNotNull() & p.isNotNull()
    yv, pv = F.when(ok, y), F.when(ok, p)
    sse = F.sum((yv - pv) * (yv - pv))
    sst = F.var_pop(yv) * F.count(yv)
    return lit_d(1.0) - F.try_divide(sse, sst)


def rmse_col(y, p) -> Column:
    return F.sqrt(F.avg((c(y) - c(p)) * (c(y) - c(p))))


def mae_col(y, p) -> Column:
    return F.avg(F.abs(c(y) - c(p)))


def regression_metrics(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """R^2, RMSE, MAE and n (optionally per group, e.g. per fold)."""
    aggs = [F.count(F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), 1)).alias("n"),
            r2_col(y, p).alias("r2"), rmse_col(y, p).alias("rmse"), mae_col(y, p).alias("mae")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def fold_metrics(df: DataFrame, y: str, p: str, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics and sizes, then mean/std over folds plus the pooled metrics."""
    per = regression_metrics(df, y, p, [fold])
    over = per.agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
                   F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("n_folds"))
    return per, over


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC by the rank-sum formula with average ranks for ties.

    Positives/negatives are counted per distinct score (partial aggregation),
    then a distributed running sum of negatives along the score order gives,
    for every score, the negatives strictly below it.
    """
    per = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, lit_d(1.0)).otherwise(lit_d(0.0))).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, lit_d(0.0)).otherwise(lit_d(1.0))).alias("_neg"))
    cum = running_sum(per, ["_s"], ["_neg"], inclusive=False)
    return cum.agg(
        F.try_divide(F.sum(F.col("_pos") * (F.col("_neg_cum") + F.col("_neg") / 2.0)),
                     F.sum("_pos") * F.sum("_neg")).alias("auc"),
        F.sum("_pos").cast("long").alias("n_pos"), F.sum("_neg").cast("long").alias("n_neg"))


def importance_mean(df: DataFrame, feature: str = "feature", value: str = "gain") -> DataFrame:
    """Mean importance per feature over folds/seeds."""
    return df.groupBy(feature).agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def score_formulas(df: DataFrame, formulas: dict[str, Column], y: str, scale: float | None = None) -> DataFrame:
    """Evaluate named formulas in one select, score each in one unpivoted aggregate.

    Returns ``(formula, n, corr, r2[, r2_scaled])`` where ``r2_scaled`` uses the
    prediction multiplied by ``scale``.
    """
    names = list(formulas)
    wide = df.select(F.col(y).cast("double").alias("_y"), *[formulas[n].cast("double").alias(n) for n in names])
    long = wide.unpivot(["_y"], names, "formula", "p")
    ok = F.col("p").isNotNull() & ~F.isnan("p") & F.col("_y").isNotNull()
    lv = long.filter(ok)
    aggs = [F.count(F.lit(1)).alias("n"), safe_corr("p", "_y").alias("corr"), r2_col("_y", "p").alias("r2")]
    if scale is not None:
        aggs.append(r2_col("_y", F.col("p") * F.lit(float(scale))).alias("r2_scaled"))
    return lv.groupBy("formula").agg(*aggs)


def scale_target(df: DataFrame, y: str, kind: str = "zscore", out: str | None = None) -> tuple[DataFrame, dict]:
    """Z-score or min-max-to-[-1, 1] target scaling; returns the frame and the inverse parameters."""
    out = out or f"{y}_scaled"
    if kind == "zscore":
        r = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        s = r["s"] or 1.0
        return df.withColumn(out, (F.col(y) - F.lit(r["m"])) / F.lit(s)), {"kind": kind, "m": r["m"], "s": s}
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    span = (r["hi"] - r["lo"]) or 1.0
    return (df.withColumn(out, F.lit(2.0) * (F.col(y) - F.lit(r["lo"])) / F.lit(span) - F.lit(1.0)),
            {"kind": kind, "lo": r["lo"], "hi": r["hi"]})


def unscale_target(col, params: dict) -> Column:
    """Inverse of :func:`scale_target`."""
    if params["kind"] == "zscore":
        return c(col) * F.lit(params["s"]) + F.lit(params["m"])
    span = (params["hi"] - params["lo"]) or 1.0
    return (c(col) + F.lit(1.0)) / F.lit(2.0) * F.lit(span) + F.lit(params["lo"])
