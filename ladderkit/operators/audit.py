"""Audits and reports (V1, V2, V5, M14 drift scores).

Each check is a join or an aggregate whose output is a handful of rows; the
row-level work stays distributed (anti/semi joins, grouped counts, a
distributed running sum for the exact KS statistic).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lit_d, safe_corr
from .aggregates import combine_scalars, histogram
from .folds import sample_n
from .metrics import regression_metrics
from .sequence import running_sum


def check_predictions(preds: DataFrame, expected: DataFrame, id_col: str = "ID", value: str = "TARGET") -> DataFrame:
    """V1: prediction-table contract - row count, exact ID set (anti joins both ways), duplicates, NULLs."""
    e = expected.select(id_col).distinct()
    p = preds.select(id_col, value)
    # each check is one aggregate; combine_scalars places the one-row results side by side (no join)
    parts = [
        ("n_rows", p.agg(F.count(F.lit(1)).alias("v"))),
        ("n_dup_ids", p.agg((F.count(F.lit(1)) - F.count_distinct(id_col)).alias("v"))),
        ("n_null", p.agg(F.count_if(F.col(value).isNull() | F.isnan(F.col(value))).alias("v"))),
        ("n_expected", e.agg(F.count(F.lit(1)).alias("v"))),
        ("n_missing", e.join(p, id_col, "left_anti").agg(F.count(F.lit(1)).alias("v"))),
        ("n_extra", p.join(e, id_col, "left_anti").agg(F.count(F.lit(1)).alias("v"))),
    ]
    res = combine_scalars(parts)
    res = res.select(*[F.col(n).cast("long").alias(n) for n, _ in parts])
    return res.withColumn(
        "ok", ((F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_null") == 0)
               & (F.col("n_dup_ids") == 0) & (F.col("n_rows") == F.col("n_expected"))).cast("int"))


def _one(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check_name"), "value")


def leakage_audit(train: DataFrame, test: DataFrame, id_col: str, time_key: Column, feature_cols: Sequence[str],
                  price_key: Column, target: str) -> DataFrame:
    """V2: one row per check - id overlap, time-key overlap, duplicated feature vectors,
    price-key overlap (shares of test rows) and the ID-target correlation on train."""
    def overlap_share(name: str, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        # share of b's rows whose key occurs in a: left equi-join on a's distinct keys, then one average
        ka = a.select(*keys).dropna().distinct().withColumn("_hit", F.lit(1.0))
        j = b.select(*keys).join(ka, keys, "left")
        return j.agg(F.avg(F.coalesce(F.col("_hit"), F.lit(0.0))).alias("value")).select(
            F.lit(name).alias("check_name"), F.col("value").cast("double").alias("value"))

    tr = train.select(F.col(id_col).alias("_id"), time_key.alias("_t"), price_key.alias("_p"), *feature_cols, target)
    te = test.select(F.col(id_col).alias("_id"), time_key.alias("_t"), price_key.alias("_p"), *feature_cols)
    parts = [overlap_share("id_overlap", tr, te, ["_id"]),
             overlap_share("time_overlap", tr, te, ["_t"]),
             overlap_share("feature_duplicate", tr, te, list(feature_cols)),
             overlap_share("price_overlap", tr, te, ["_p"]),
             _one(tr, "id_target_corr", safe_corr(F.col("_id").cast("double"), F.col(target)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_scores(train: DataFrame, test: DataFrame, features: Sequence[str], bins: int = 10,
                 eps: float = 1e-6) -> DataFrame:
    """M14 (SQL-checkable part): per feature the exact two-sample KS statistic and the PSI on
    ``bins`` equal-width bins over the pooled range. Returns ``(feature, ks, psi)``.

    KS: counts per (feature, value) on each side, then a distributed running sum
    along (feature, value) gives both empirical CDFs at every distinct value.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    feats = list(features)

    def long(df, side):
        return df.select(*[F.col(f).cast("double").alias(f) for f in feats]).unpivot([], feats, "feature", "x").filter(
            F.col("x").isNotNull() & ~F.isnan("x")).withColumn("side", F.lit(side))

    u = long(train, 0).unionByName(long(test, 1))
    # per-(feature, value) counts: everything below derives from this table, materialised once
    per = u.groupBy("feature", "x").agg(F.count_if(F.col("side") == 0).cast("double").alias("a"),
                                        F.count_if(F.col("side") == 1).cast("double").alias("b")).checkpoint()
    tot = per.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.min("x").alias("lo"),
                                     F.max("x").alias("hi"))
    cum = running_sum(per, ["feature", "x"], ["a", "b"])
    start = cum.groupBy("feature").agg(F.min(F.col("a_cum") - F.col("a")).alias("a0"),
                                       F.min(F.col("b_cum") - F.col("b")).alias("b0"))
    ks = (cum.join(start, "feature").join(tot, "feature")
          .groupBy("feature").agg(F.max(F.abs((F.col("a_cum") - F.col("a0")) / F.col("na")
                                              - (F.col("b_cum") - F.col("b0")) / F.col("nb"))).alias("ks")))
    binned = per.join(tot, "feature").withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
                                                                 * F.lit(float(bins))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
    cnt = binned.groupBy("feature", "bin").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    sh = cnt.join(tot, "feature").select("feature", (F.col("ca") / F.col("na") + lit_d(eps)).alias("pa"),
                                         (F.col("cb") / F.col("nb") + lit_d(eps)).alias("pb"))
    psi = sh.groupBy("feature").agg(F.sum((F.col("pa") - F.col("pb")) * F.ln(F.col("pa") / F.col("pb"))).alias("psi"))
    return ks.join(psi, "feature")


def report_kpis(df: DataFrame, y: str, p: str) -> DataFrame:
    """V5 KPIs: n, R^2, RMSE, MAE plus target/prediction mean and std."""
    from .metrics import mae_col, r2_col, rmse_col
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    return df.agg(F.count(F.when(ok, 1)).alias("n"), r2_col(y, p).alias("r2"), rmse_col(y, p).alias("rmse"),
                  mae_col(y, p).alias("mae"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"),
                  F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"))


def report_histograms(df: DataFrame, series: dict[str, Column], bins: int = 20) -> DataFrame:
    """V5 histograms: one long table ``(series, bin, left, right, n)`` for several series."""
    out = None
    for name, col in series.items():
        h = histogram(df.select(col.alias("_v")), "_v", bins).select(F.lit(name).alias("series"), "bin", "left", "right", "n")
        out = h if out is None else out.unionByName(h)
    return out


def report_scatter(df: DataFrame, cols: Sequence[str], n: int, id_col: str = "id") -> DataFrame:
    """V5 scatter sample: a deterministic fixed-size sample (R1) of the given columns."""
    return sample_n(df.select(id_col, *cols), n, id_col)
