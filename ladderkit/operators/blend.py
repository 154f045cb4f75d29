"""Blending, scaling and calibration (B1-B15) from one moment aggregate.

R^2 of any linear blend ``s * sum_i w_i p_i`` depends only on the means and the
population covariance matrix of ``(p_1..p_k, y)``:

    SSE / n = (ybar - s * w'pbar)^2 + var_y - 2 s w'cov(p, y) + s^2 w'Cov(p) w

so every grid (pairs x alpha, simplex, scale, shrink) costs **one** pass over
the data; the grid itself is a tiny generated frame evaluated with Column
arithmetic on literal moments. Centred moments avoid the cancellation that
raw sums suffer when R^2 is close to 0.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import c, clip, lit_d
from .metrics import r2_col


class Moments:
    """n, means and population covariances of predictions and target (driver literals, size k^2)."""

    def __init__(self, df: DataFrame, y: str, preds: Sequence[str]):
        self.preds = list(preds)
        allc = self.preds + [y]
        ok = F.lit(True)
        for x in allc:
            ok = ok & F.col(x).isNotNull() & ~F.isnan(F.col(x))
        d = df.filter(ok)
        aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(allc)]
        for i in range(len(allc)):
            for j in range(i, len(allc)):
                aggs.append(F.covar_pop(allc[i], allc[j]).alias(f"c{i}_{j}"))
        r = d.agg(*aggs).first()
        k = len(allc)
        self.n = int(r["n"])
        self.mean = np.array([float(r[f"m{i}"]) for i in range(k)])
        cov = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                cov[i, j] = cov[j, i] = float(r[f"c{i}_{j}"])
        self.cov = cov
        self.k = k - 1

    def r2_expr(self, weights: Sequence, scale=1.0) -> Column:
        """R^2 of ``scale * sum w_i p_i`` as a Column (weights/scale may be Columns)."""
        k = self.k
        w = [x if isinstance(x, Column) else lit_d(x) for x in weights]
        s = scale if isinstance(scale, Column) else lit_d(scale)
        wp = sum((w[i] * lit_d(self.mean[i]) for i in range(k)), lit_d(0.0))
        wc = sum((w[i] * lit_d(self.cov[i, k]) for i in range(k)), lit_d(0.0))
        quad = sum((w[i] * w[j] * lit_d(self.cov[i, j]) for i in range(k) for j in range(k)), lit_d(0.0))
        vy = self.cov[k, k]
        sse_n = (lit_d(self.mean[k]) - s * wp) ** 2 + lit_d(vy) - lit_d(2.0) * s * wc + s * s * quad
        return lit_d(1.0) - sse_n / lit_d(vy)

    def r2(self, weights: Sequence[float], scale: float = 1.0) -> float:
        k = self.k
        w = np.asarray(weights, dtype=float)
        sse_n = ((self.mean[k] - scale * w @ self.mean[:k]) ** 2 + self.cov[k, k]
                 - 2 * scale * w @ self.cov[:k, k] + scale ** 2 * w @ self.cov[:k, :k] @ w)
        return float(1.0 - sse_n / self.cov[k, k])


# B1, B13, B15 ------------------------------------------------------------------
def blend(cols: Sequence, weights: Sequence[float]) -> Column:
    """B1: fixed weighted average with normalised weights."""
    tot = float(sum(weights))
    out = lit_d(0.0)
    for x, w in zip(cols, weights):
        out = out + c(x) * lit_d(w / tot)
    return out


def mean_columns(cols: Sequence) -> Column:
    """Plain mean of prediction columns."""
    return blend(cols, [1.0] * len(cols))


# B2-B5 -------------------------------------------------------------------------
def blend_pairs(spark: SparkSession, mom: Moments, steps: int = 9) -> DataFrame:
    """B2: every model pair with alpha = 0.1..0.9: R^2 of ``alpha p_a + (1 - alpha) p_b``."""
    rows = [(mom.preds[i], mom.preds[j], i, j) for i, j in combinations(range(mom.k), 2)]
    pairs = spark.createDataFrame(rows, "a string, b string, ia int, ib int")
    grid = (pairs.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .withColumn("alpha", F.col("_s") / F.lit(float(steps + 1))))
    w = [F.when(F.col("ia") == i, F.col("alpha")).when(F.col("ib") == i, lit_d(1.0) - F.col("alpha")).otherwise(lit_d(0.0))
         for i in range(mom.k)]
    return grid.select("a", "b", "alpha", mom.r2_expr(w).alias("r2"))


def blend_simplex(spark: SparkSession, mom: Moments, step: float = 0.1) -> DataFrame:
    """All 3-model weight triples on a simplex grid (weights sum to 1)."""
    m = int(round(1.0 / step))
    g = (spark.range(0, m + 1).select(F.col("id").alias("i"))
         .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m) - F.col("i"))))
         .select((F.col("i") / float(m)).alias("w1"), (F.col("j") / float(m)).alias("w2"),
                 ((F.lit(m) - F.col("i") - F.col("j")) / float(m)).alias("w3")))
    return g.select("w1", "w2", "w3", mom.r2_expr([F.col("w1"), F.col("w2"), F.col("w3")]).alias("r2"))


def scale_grid(spark: SparkSession, mom: Moments, weights: Sequence[float], lo: float = 0.5, hi: float = 2.0,
               step: float = 0.05) -> DataFrame:
    """R^2 of the scaled blend for scale in [lo, hi) by step; closed-form optimum via ``best_scale``."""
    n = int(round((hi - lo) / step))
    g = spark.range(0, n).select((F.lit(lo) + F.col("id") * F.lit(step)).alias("scale"))
    return g.select("scale", mom.r2_expr(weights, F.col("scale")).alias("r2"))


def best_scale(mom: Moments, weights: Sequence[float]) -> float:
    """Closed-form least-squares scale ``sum(y p) / sum(p^2)`` from the moments."""
    k = mom.k
    w = np.asarray(weights, dtype=float)
    syp = mom.cov[:k, k] @ w + mom.mean[k] * (w @ mom.mean[:k])
    spp = w @ mom.cov[:k, :k] @ w + (w @ mom.mean[:k]) ** 2
    return float(syp / spp) if spp > 0 else 0.0


def shrink_guard(spark: SparkSession, mom: Moments, weights: Sequence[float], steps: int = 100) -> DataFrame:
    """If the blend is worse than predicting 0, the shrink factor alpha in [0, 1] (step 0.01) that
    maximises R^2 of ``alpha * blend``; otherwise alpha = 1. One row ``(zero_r2, blend_r2, alpha, r2)``."""
    zero_r2 = 1.0 - (mom.mean[mom.k] ** 2 + mom.cov[mom.k, mom.k]) / mom.cov[mom.k, mom.k]
    blend_r2 = mom.r2(weights)
    g = spark.range(0, steps + 1).select((F.col("id") / float(steps)).alias("alpha"))
    g = g.select("alpha", mom.r2_expr(weights, F.col("alpha")).alias("r2"))
    best = g.orderBy(F.col("r2").desc(), F.col("alpha")).limit(1)
    return best.select(lit_d(zero_r2).alias("zero_r2"), lit_d(blend_r2).alias("blend_r2"),
                       F.when(lit_d(blend_r2) < lit_d(zero_r2), F.col("alpha")).otherwise(lit_d(1.0)).alias("alpha"),
                       F.when(lit_d(blend_r2) < lit_d(zero_r2), F.col("r2")).otherwise(lit_d(blend_r2)).alias("r2"))


# B6, B7 ------------------------------------------------------------------------
def r2_weights(spark: SparkSession, mom: Moments) -> DataFrame:
    """Weights proportional to max(0, R^2); equal weights if none is positive."""
    r2s = [mom.r2([1.0 if j == i else 0.0 for j in range(mom.k)]) for i in range(mom.k)]
    pos = [max(0.0, r) for r in r2s]
    tot = sum(pos)
    ws = [p / tot for p in pos] if tot > 0 else [1.0 / mom.k] * mom.k
    return spark.createDataFrame(list(zip(mom.preds, r2s, ws)), "model string, r2 double, weight double")


def best_solo_guard(spark: SparkSession, mom: Moments, weights: Sequence[float]) -> DataFrame:
    """Use the best single model if it beats the blend."""
    b = mom.r2(weights)
    solo = [(p, mom.r2([1.0 if j == i else 0.0 for j in range(mom.k)])) for i, p in enumerate(mom.preds)]
    name, r = sorted(solo, key=lambda t: (-t[1], t[0]))[0]
    choice, r2 = (name, r) if r > b else ("blend", b)
    return spark.createDataFrame([(choice, r2, b)], "choice string, r2 double, blend_r2 double")


# B8-B10 ------------------------------------------------------------------------
def std_scale(df: DataFrame, pred: str, y: str, clip_to_target: bool = False, out: str = "scaled") -> DataFrame:
    """Rescale the prediction by ``std(y) / std(p)`` (population), optionally clipped to the target range."""
    r = df.agg(F.stddev_pop(y).alias("sy"), F.stddev_pop(pred).alias("sp"), F.min(y).alias("lo"),
               F.max(y).alias("hi")).first()
    k = (r["sy"] / r["sp"]) if r["sp"] else 1.0
    e = F.col(pred) * lit_d(k)
    if clip_to_target:
        e = clip(e, r["lo"], r["hi"])
    return df.withColumn(out, e)


def quantile_linear_fit(df: DataFrame, pred: str, y: str, qs: Sequence[float]) -> tuple[float, float]:
    """Least squares of target quantiles on prediction quantiles (exact, interpolated).

    Both quantile sets come from one grouped sort over the stacked ``(side, value)`` frame.
    """
    from .quantiles import quantiles
    stacked = df.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(pred).cast("double").alias("v")),
                                          F.struct(F.lit(1).alias("side"), F.col(y).cast("double").alias("v")))).alias("e"))
    got = {(int(r["side"]), float(r["p"])): r["q"] for r in
           quantiles(stacked.select("e.side", "e.v"), "v", qs, group=["side"]).collect()}
    xs = [got[(0, float(q))] for q in qs]
    ys = [got[(1, float(q))] for q in qs]
    k = len(qs)
    sx, sy = sum(xs), sum(ys)
    sxy = sum(a * b for a, b in zip(xs, ys))
    sxx = sum(a * a for a in xs)
    m = (k * sxy - sx * sy) / (k * sxx - sx * sx + 1e-10)
    return m, (sy - m * sx) / k


def fixed_scale(col, k: float, lo: float | None = None, hi: float | None = None) -> Column:
    """Constant scale with optional clip to target bounds."""
    return clip(c(col) * lit_d(k), lo, hi)


def variant_scores(df: DataFrame, y: str, variants: Sequence[str]) -> DataFrame:
    """R^2 of each variant column against the target (one unpivoted aggregate)."""
    long = df.select(F.col(y).alias("_y"), *variants).unpivot(["_y"], list(variants), "variant", "p")
    return long.groupBy("variant").agg(r2_col("_y", "p").alias("r2"))
