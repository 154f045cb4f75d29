"""Wide-table profiling.

A wide table with hundreds of feature columns is profiled in one scan by
unpivoting to ``(feature, x)`` and grouping by ``feature``: partial aggregation
keeps one buffer per feature per task, the shuffle moves ``#features x
#partitions`` rows, and codegen is not lost to ``spark.sql.codegen.maxFields``
as it would be with a 445-column ``agg``.
"""

from __future__ import annotations

import re
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_finite, lit_d, nan_to_null, safe_corr

META_COLS = ("ID", "CV_GROUP", "TARGET")


def feature_cols(df: DataFrame, drop: Iterable[str] = META_COLS) -> list[str]:
    """All columns except the metadata ones, in schema order."""
    dropped = set(drop)
    return [c for c in df.columns if c not in dropped]


def cols_like(df: DataFrame, suffix: str | None = None, prefix: str | None = None,
              contains_any: Sequence[str] | None = None, base_only: bool = False,
              lag_pattern: str = r"_LagT\d+$") -> list[str]:
    """Select columns by name pattern (lag suffix, no-lag base, prefix, contains-any)."""
    out = []
    for c in df.columns:
        if suffix is not None and not c.endswith(suffix):
            continue
        if prefix is not None and not c.startswith(prefix):
            continue
        if contains_any is not None and not any(s in c for s in contains_any):
            continue
        if base_only and re.search(lag_pattern, c):
            continue
        out.append(c)
    return out


def to_long(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (),
            name: str = "feature", value: str = "x") -> DataFrame:
    """Unpivot feature columns to ``(ids..., feature, x)`` with doubles and NaN -> NULL."""
    cast = df.select(*ids, *[nan_to_null(F.col(f).cast("double")).alias(f) for f in features])
    return cast.unpivot(list(ids), list(features), name, value)


def target_corr(df: DataFrame, y: str, features: Sequence[str] | None = None) -> DataFrame:
    """Population Pearson correlation of every feature with ``y``; constant -> 0.

    Returns ``(feature, corr)`` - one row per feature, from one scan.
    """
    feats = list(features) if features is not None else feature_cols(df, drop=(y,) + META_COLS)
    long = to_long(df.withColumn("_y", nan_to_null(F.col(y).cast("double"))), feats, ids=["_y"])
    return long.groupBy("feature").agg(safe_corr("x", "_y").alias("corr"))


def top_features(corr: DataFrame, n: int, score: str = "corr") -> DataFrame:
    """O2: top-``n`` features by |score|, ties broken by name (a top-k report)."""
    return corr.orderBy(F.abs(F.col(score)).desc(), F.col("feature").asc()).limit(n)


def select_features(corr: DataFrame, threshold: float, cap: int | None = None,
                    score: str = "corr") -> DataFrame:
    """O3: keep |score| > threshold, optionally only the ``cap`` strongest."""
    kept = corr.filter(F.abs(F.col(score)) > F.lit(threshold))
    return top_features(kept, cap, score) if cap else kept


def corr_distribution(corr: DataFrame, thresholds: Sequence[float] = (0.01, 0.005, 0.002),
                      score: str = "corr") -> DataFrame:
    """Count above each |corr| threshold, max and mean |corr| (one row)."""
    a = F.abs(F.col(score))
    aggs = [F.count(F.lit(1)).alias("n_features"), F.max(a).alias("max_abs_corr"),
            F.avg(a).alias("mean_abs_corr")]
    for t in thresholds:
        tag = f"{t:g}".replace(".", "p").replace("-", "m")
        aggs.append(F.count_if(a > F.lit(t)).alias(f"n_above_{tag}"))
    return corr.agg(*aggs)


def quality_profile(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per column NULL/NaN count, +-inf count, sample std and a constant flag."""
    feats = list(features) if features is not None else feature_cols(df)
    long = df.select(*[F.col(f).cast("double").alias(f) for f in feats]).unpivot([], feats, "feature", "x")
    x = F.col("x")
    finite_x = F.when(is_finite(x), x)
    return long.groupBy("feature").agg(
        F.count_if(x.isNull() | F.isnan(x)).cast("long").alias("n_missing"),
        F.count_if(x.isNotNull() & ~F.isnan(x) & (F.abs(x) == F.lit(float("inf")))).cast("long").alias("n_inf"),
        F.stddev_samp(finite_x).alias("std"),
    ).withColumn("is_constant", F.when(F.col("std") == 0, F.lit(1)).otherwise(F.lit(0)))


def summary(df: DataFrame, features: Sequence[str], exact_median: bool = True) -> DataFrame:
    """A1: mean, population/sample std, min, max (one aggregate) and median (sort-based quantile)."""
    from .quantiles import quantiles
    long = to_long(df, features)
    x = F.col("x")
    mom = long.groupBy("feature").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_pop"),
        F.stddev_samp(x).alias("std_samp"), F.min(x).alias("min"), F.max(x).alias("max"))
    med = quantiles(long, "x", [0.5], group=["feature"], exact=exact_median, few_groups=True)
    return mom.join(med.select("feature", F.col("q").alias("median")), "feature", "left")


def shape(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Biased skewness and excess kurtosis per column (population moments)."""
    long = to_long(df, features)
    return long.groupBy("feature").agg(F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))


def percentiles(df: DataFrame, features: Sequence[str], ps: Sequence[float],
                exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Percentile list per column ``(feature, p, value)``; exact (sort-based) or sketch."""
    from .quantiles import quantiles
    long = to_long(df, features)
    q = quantiles(long, "x", ps, group=["feature"], exact=exact, accuracy=accuracy, few_groups=True)
    return q.select("feature", "p", F.col("q").alias("value"))


def percentile_values(df: DataFrame, col: str, ps: Sequence[float], exact: bool = True) -> list[float]:
    """Percentile cut values as driver literals (``len(ps)`` numbers)."""
    from .quantiles import quantile_values
    return quantile_values(df, col, ps, exact=exact)


def winsor_loss(df: DataFrame, col: str, levels: Sequence[float], exact: bool = True) -> DataFrame:
    """Share of rows outside the [p, 1-p] percentile band for each level p.

    One percentile aggregate computes every cut (literals), a second pass counts.
    """
    qs = sorted({float(p) for p in levels} | {1.0 - float(p) for p in levels})
    cut = dict(zip(qs, percentile_values(df, col, qs, exact)))
    x = nan_to_null(F.col(col).cast("double"))
    aggs = []
    for p in levels:
        lo, hi = lit_d(cut[float(p)]), lit_d(cut[1.0 - float(p)])
        aggs.append(F.avg(F.when((x < lo) | (x > hi), lit_d(1.0)).otherwise(lit_d(0.0))).alias(
            f"loss_{str(p).replace('.', 'p')}"))
    return df.agg(*aggs)
