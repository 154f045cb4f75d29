"""Grouped aggregates, histograms and univariate fits.

All are hash aggregates with partial (map-side) combine, so a hot group costs
one buffer per task before the shuffle, never a single task holding the group.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, is_finite, lit_d, nan_to_null, safe_corr


def group_summary(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """A2: per-group count, mean and sample std."""
    x = nan_to_null(F.col(value))
    return df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def group_means_spread(summary: DataFrame) -> DataFrame:
    """A2: range and std of group means."""
    return summary.agg((F.max("mean") - F.min("mean")).alias("range_of_means"),
                       F.stddev_samp("mean").alias("std_of_means"), F.count(F.lit(1)).alias("n_groups"))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """A3 (mean/count part): per-key mean and count maps; medians via ``quantiles(group=...)``."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def bin_span(df: DataFrame, bin_col: str, group: str, value: str, min_groups: int = 2) -> DataFrame:
    """A4: per bin - distinct groups, count, sample std; keep bins spanning >= ``min_groups`` groups.

    ``count_distinct`` on (bin, group) is planned by Spark as a two-level
    aggregate (expand + partial), so it stays distributed.
    """
    out = df.groupBy(bin_col).agg(F.count_distinct(group).alias("n_groups"), F.count(value).alias("n"),
                                  F.stddev_samp(value).alias("value_std"))
    return out.filter(F.col("n_groups") >= min_groups)


def group_range(df: DataFrame, group: str, value: str) -> DataFrame:
    """A5: per-group min, max, mean, sample std."""
    return df.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"),
                                 F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts ordered by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def nunique(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct count per column (exact or HyperLogLog++)."""
    fn = (lambda x: F.approx_count_distinct(x, rsd)) if approx else F.count_distinct
    return df.agg(*[fn(F.col(x)).alias(f"nunique_{x}") for x in cols])


def coverage(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Share of rows meeting each named condition, in one aggregate."""
    return df.agg(*[F.avg(F.when(cond, lit_d(1.0)).otherwise(lit_d(0.0))).alias(n) for n, cond in conds.items()])


def match_rate(df: DataFrame, a: str, b: str, tols: Sequence[float] = (0.0, 1e-6, 1e-4, 1.0)) -> DataFrame:
    """Share of rows with |a - b| within each tolerance (0 means exact equality)."""
    d = F.abs(F.col(a) - F.col(b))
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = [F.count(F.when(ok, 1)).alias("n_pairs")]
    for t in tols:
        cond = (F.col(a) == F.col(b)) if t == 0 else (d < F.lit(t))
        name = "rate_exact" if t == 0 else f"rate_lt_{t:g}".replace(".", "p").replace("-", "m")
        aggs.append(F.avg(F.when(ok, F.when(cond, lit_d(1.0)).otherwise(lit_d(0.0)))).alias(name))
    return df.agg(*aggs)


def histogram(df: DataFrame, col: str, n_bins: int) -> DataFrame:
    """Equal-width histogram from min to max, last bin right-closed, empty bins kept.

    Two small aggregates: min/max (one row), then counts by bin; the bin frame
    is generated with ``sequence`` (``n_bins`` rows) and left-joined.
    """
    x = nan_to_null(F.col(col).cast("double"))
    d = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    mm = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, left double, right double, mid double, n long")
    width = (hi - lo) / n_bins if hi > lo else 0.0
    if hi > lo:
        b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n_bins))), F.lit(n_bins - 1))
    else:
        b = F.lit(0)
    counts = d.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    edges = bins.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"))
    return (edges.join(counts, "bin", "left")
            .select("bin", "left", "right", ((F.col("left") + F.col("right")) / 2.0).alias("mid"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def finite_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P6 gate: share of finite values per column (skip a column under e.g. 0.9)."""
    return df.agg(*[F.avg(F.when(is_finite(x), lit_d(1.0)).otherwise(lit_d(0.0))).alias(x) for x in cols])


def linear_fit(df: DataFrame, y: str, features: Sequence[str], min_finite: float = 0.9) -> DataFrame:
    """Per feature raw R^2 (feature as prediction), slope/intercept and linear R^2.

    Moments come from one unpivoted aggregate; rows where the feature is not
    finite are skipped; features finite in fewer than ``min_finite`` of the
    rows are dropped. Constant feature -> slope 0, linear R^2 0.
    """
    long = df.select(F.col(y).cast("double").alias("_y"),
                     *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["_y"], list(features), "feature", "x")
    ok = is_finite("x")
    xv, yv = F.when(ok, F.col("x")), F.when(ok, F.col("_y"))
    m = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(xv).alias("n"),
        F.avg(xv).alias("mx"), F.avg(yv).alias("my"), F.var_pop(xv).alias("vx"), F.var_pop(yv).alias("vy"),
        F.covar_pop(xv, yv).alias("cxy"), F.sum((yv - xv) * (yv - xv)).alias("sse_raw"))
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx")).otherwise(lit_d(0.0))
    sst = F.col("vy") * F.col("n")
    r2_lin = F.when(F.col("vx") > 0, lit_d(1.0) - F.try_divide(
        sst - F.col("n") * F.col("cxy") * F.col("cxy") / F.col("vx"), sst)).otherwise(lit_d(0.0))
    return (m.filter(F.col("n") >= F.lit(min_finite) * F.col("n_all"))
            .select("feature", (lit_d(1.0) - F.try_divide(F.col("sse_raw"), sst)).alias("r2_raw"),
                    slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
                    r2_lin.alias("r2_lin")))


def top_bottom(df: DataFrame, k_top: int, top_by: str, k_bottom: int, bottom_by: str, name: str = "feature") -> DataFrame:
    """Top-k by one score and bottom-k by another, tagged (a top-k report)."""
    top = df.orderBy(F.col(top_by).desc(), F.col(name)).limit(k_top).withColumn("side", F.lit("top"))
    bot = df.orderBy(F.col(bottom_by).asc(), F.col(name)).limit(k_bottom).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot)


def best(df: DataFrame, name: str, score: str) -> DataFrame:
    """Best-of selection - the row with the highest score (ties: smallest name)."""
    return df.orderBy(F.col(score).desc(), F.col(name).asc()).limit(1)


def combine_scalars(parts: Sequence[tuple[str, DataFrame]], value: str = "v") -> DataFrame:
    """Put named one-row scalar frames side by side: union them as ``(name, v)`` rows and pick each
    name with one conditional aggregate - no join, so no cartesian product is ever planned."""
    u = None
    for name, df in parts:
        r = df.select(F.lit(name).alias("_name"), F.col(value).cast("double").alias("_v"))
        u = r if u is None else u.unionByName(r)
    return u.agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name, _ in parts])


def pair_corr(df: DataFrame, a, b, name: str = "corr") -> DataFrame:
    """A10: safe Pearson correlation and its square for an ad-hoc pair."""
    return df.agg(safe_corr(a, b).alias(name)).withColumn(f"{name}_sq", F.col(name) * F.col(name))


# ---------------------------------------------------------------- Gram / OLS


def moments(df: DataFrame, cols: Sequence[str], y: str) -> dict:
    """n, means and the population covariance matrix of ``cols + [y]`` over rows finite in all of them.

    The matrix comes as Gram blocks about the means (``ml.gram``), so the plan grows with the
    columns and not with their pairs. Returns plain numbers (size fixed by the column count)
    for small solves on the driver.
    """
    from .ml import _means, gram
    allc = list(cols) + [y]
    k = len(allc)
    d = df.select(*[F.when(is_finite(x), c(x).cast("double")).alias(f"c{i}") for i, x in enumerate(allc)])
    mean = np.array(_means(d, d.columns))
    n, s, q = gram(d, d.columns, mean).get(0, (0.0, np.zeros(k), np.zeros((k, k))))
    if n:
        s, q = s / n, q / n
    return {"n": int(n), "mean": mean + s, "cov": q - np.outer(s, s)}


def ols_standardized(mom: dict, idx: Sequence[int], ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """OLS/ridge on population-standardised columns, no intercept, y not centred.

    From the moments only: ``Xs'Xs = n * corr``, ``Xs'y = n * cov(x, y) / sd``,
    ``SSE = y'y - 2 b'Xs'y + b'Xs'Xs b``. Returns ``(beta, r2)``.
    """
    n, cov, mean = mom["n"], mom["cov"], mom["mean"]
    k = cov.shape[0] - 1
    sd = np.sqrt(np.diag(cov)[:k])
    sd = np.where(sd == 0, 1.0, sd)
    ii = list(idx)
    xtx = n * cov[np.ix_(ii, ii)] / np.outer(sd[ii], sd[ii]) + ridge * np.eye(len(ii))
    xty = n * cov[ii, k] / sd[ii]
    beta = np.linalg.solve(xtx, xty)
    yy = n * (cov[k, k] + mean[k] ** 2)
    sse = yy - 2 * beta @ xty + beta @ xtx @ beta - ridge * beta @ beta
    sst = n * cov[k, k]
    return beta, float(1.0 - sse / sst) if sst > 0 else 0.0
