"""Step 3 queries: summaries, grouped aggregates, quantiles, histograms, fits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.expr import key, rnd, rndf
from ..operators import aggregates as A
from ..operators import profile as P
from ..operators.metrics import scale_target, unscale_target
from ..operators.quantiles import quantiles, winsorize
from ..operators.sequence import shift
from . import sqlgen as S
from .fixtures import v_ticks, v_wide, with_views
from .registry import register

FEATS8 = [f"f{i}" for i in range(1, 9)]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# A1 --------------------------------------------------------------------------
@register("summary", with_views("v_wide") + _union(
    f"""SELECT '{f}' AS feature, CAST(COUNT({f}) AS BIGINT) AS n, {S.rf(f'AVG({f})')} AS mean,
       {S.rf(f'stddev_pop({f})')} AS std_pop, {S.rf(f'stddev_samp({f})')} AS std_samp, {S.rf(f'MIN({f})')} AS min,
       {S.rf(f'MAX({f})')} AS max, {S.rf(f'quantile_cont({f}, 0.5)')} AS median FROM v_wide""" for f in FEATS8))
def summary(spark, sf):
    """A1: mean / std / min / max / median per column."""
    s = P.summary(v_wide(spark, sf), FEATS8)
    return s.select("feature", "n", *[rndf(x).alias(x) for x in ["mean", "std_pop", "std_samp", "min", "max", "median"]])


# A2 --------------------------------------------------------------------------
@register("group_summary", with_views("v_ticks") + f"""
SELECT grp, CAST(COUNT(target) AS BIGINT) AS n, {S.rf('AVG(target)')} AS mean, {S.rf('stddev_samp(target)')} AS std
FROM v_ticks GROUP BY grp""")
def group_summary(spark, sf):
    """A2: per-group count / mean / std of the target."""
    g = A.group_summary(v_ticks(spark, sf), "grp", "target")
    return g.select("grp", "n", rndf("mean").alias("mean"), rndf("std").alias("std"))


@register("group_means_spread", with_views("v_ticks") + f"""
, g AS (SELECT grp, AVG(target) AS mean FROM v_ticks GROUP BY grp)
SELECT {S.rf('MAX(mean) - MIN(mean)')} AS range_of_means, {S.rf('stddev_samp(mean)')} AS std_of_means,
       CAST(COUNT(*) AS BIGINT) AS n_groups FROM g""".replace("\n, g AS", ", g AS", 1).replace(
    "\n\n", "\n"))
def group_means_spread(spark, sf):
    """A2: range and std of group means."""
    g = A.group_means_spread(A.group_summary(v_ticks(spark, sf), "grp", "target"))
    return g.select(rndf("range_of_means").alias("range_of_means"), rndf("std_of_means").alias("std_of_means"),
                    "n_groups")


# A3 --------------------------------------------------------------------------
@register("group_stats", with_views("v_ticks") + f"""
SELECT CAST(round_even(s2, 0) AS BIGINT) AS s2_key, {S.rf('AVG(target)')} AS mean,
       {S.rf('quantile_cont(target, 0.5)')} AS median, CAST(COUNT(target) AS BIGINT) AS n
FROM v_ticks WHERE s2 IS NOT NULL GROUP BY 1""")
def group_stats(spark, sf):
    """A3: mean / median / count per rounded key (median from the sort-based exact quantile)."""
    t = v_ticks(spark, sf).withColumn("s2_key", key("s2", 0)).filter(F.col("s2_key").isNotNull())
    m = A.group_stats(t, "s2_key", "target")
    med = quantiles(t, "target", [0.5], group=["s2_key"]).select("s2_key", F.col("q").alias("median"))
    return m.join(med, "s2_key", "left").select("s2_key", rndf("mean").alias("mean"), rndf("median").alias("median"), "n")


# A4 --------------------------------------------------------------------------
@register("bin_span", with_views("v_ticks") + f"""
SELECT CAST(round_even(price, 0) AS BIGINT) AS price_bin, CAST(COUNT(DISTINCT grp) AS BIGINT) AS n_groups,
       CAST(COUNT(target) AS BIGINT) AS n, {S.rf('stddev_samp(target)')} AS value_std
FROM v_ticks GROUP BY 1 HAVING COUNT(DISTINCT grp) >= 2""")
def bin_span(spark, sf):
    """A4: bins (rounded price) spanning more than one group, with count and target std."""
    t = v_ticks(spark, sf).withColumn("price_bin", key("price", 0))
    b = A.bin_span(t, "price_bin", "grp", "target")
    return b.select("price_bin", "n_groups", "n", rndf("value_std").alias("value_std"))


# A5 --------------------------------------------------------------------------
@register("group_range", with_views("v_ticks") + f"""
SELECT grp, {S.rf('MIN(price)')} AS min, {S.rf('MAX(price)')} AS max, {S.rf('AVG(price)')} AS mean,
       {S.rf('stddev_samp(price)')} AS std FROM v_ticks GROUP BY grp""")
def group_range(spark, sf):
    """A5: per-group min / max / mean / std of price."""
    g = A.group_range(v_ticks(spark, sf), "grp", "price")
    return g.select("grp", *[rndf(x).alias(x) for x in ["min", "max", "mean", "std"]])


# A6, A7 ----------------------------------------------------------------------
@register("value_counts", with_views("v_ticks") + """
SELECT s2, CAST(COUNT(*) AS BIGINT) AS n FROM v_ticks GROUP BY s2 ORDER BY s2""")
def value_counts(spark, sf):
    """Value counts ordered by value."""
    return A.value_counts(v_ticks(spark, sf), "s2")


@register("nunique", with_views("v_ticks") + """
SELECT CAST(COUNT(DISTINCT grp) AS BIGINT) AS nunique_grp, CAST(COUNT(DISTINCT s2) AS BIGINT) AS nunique_s2,
       CAST(COUNT(DISTINCT price) AS BIGINT) AS nunique_price FROM v_ticks""")
def nunique(spark, sf):
    """Distinct counts."""
    return A.nunique(v_ticks(spark, sf), ["grp", "s2", "price"])


# A19 -------------------------------------------------------------------------
_PS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@register("percentiles", with_views("v_wide") + _union(
    f"SELECT '{f}' AS feature, CAST({p!r} AS DOUBLE) AS p, {S.rf(f'quantile_cont({f}, {p!r})')} AS value FROM v_wide"
    for f in ["f1", "f2", "target"] for p in _PS))
def percentiles(spark, sf):
    """Exact linear-interpolation percentiles (sort-based, distributed)."""
    q = P.percentiles(v_wide(spark, sf), ["f1", "f2", "target"], _PS)
    return q.select("feature", "p", rndf("value").alias("value"))


# A18 -------------------------------------------------------------------------
def _shape_sql(f):
    m = f"(SELECT AVG({f}) FROM v_wide)"
    return (f"SELECT '{f}' AS feature, {S.rf(f'AVG(pow({f} - {m}, 3)) / pow(AVG(pow({f} - {m}, 2)), 1.5)')} AS skew, "
            f"{S.rf(f'AVG(pow({f} - {m}, 4)) / pow(AVG(pow({f} - {m}, 2)), 2) - 3.0')} AS kurt FROM v_wide")


@register("shape", with_views("v_wide") + _union(_shape_sql(f) for f in FEATS8))
def shape(spark, sf):
    """Biased skewness and excess kurtosis."""
    s = P.shape(v_wide(spark, sf), FEATS8)
    return s.select("feature", rndf("skew").alias("skew"), rndf("kurt").alias("kurt"))


# A20 -------------------------------------------------------------------------
@register("winsor_loss", with_views("v_wide") + """
, q AS (SELECT quantile_cont(target, 0.01) AS lo1, quantile_cont(target, 0.99) AS hi1,
               quantile_cont(target, 0.05) AS lo5, quantile_cont(target, 0.95) AS hi5 FROM v_wide)
SELECT ROUND(AVG(CASE WHEN target < lo1 OR target > hi1 THEN 1.0 ELSE 0.0 END), 6) AS loss_0p01,
       ROUND(AVG(CASE WHEN target < lo5 OR target > hi5 THEN 1.0 ELSE 0.0 END), 6) AS loss_0p05
FROM v_wide, q""".replace("\n, q AS", ", q AS", 1))
def winsor_loss(spark, sf):
    """Share of rows removed by clipping at 1/99 and 5/95 percentiles."""
    w = P.winsor_loss(v_wide(spark, sf), "target", [0.01, 0.05])
    return w.select(rnd("loss_0p01").alias("loss_0p01"), rnd("loss_0p05").alias("loss_0p05"))


# P10, P11 --------------------------------------------------------------------
@register("winsorize", with_views("v_wide") + f"""
, q AS (SELECT quantile_cont(target, 0.01) AS lo, quantile_cont(target, 0.99) AS hi FROM v_wide),
c AS (SELECT id, least(greatest(target, lo), hi) AS t, least(greatest(f1, 10.0), 200.0) AS f1c FROM v_wide, q)
SELECT {S.rf('SUM(t)')} AS sum_t, {S.rf('MIN(t)')} AS min_t, {S.rf('MAX(t)')} AS max_t,
       {S.rf('SUM(f1c)')} AS sum_f1c FROM c""".replace("\n, q AS", ", q AS", 1))
def winsorize_q(spark, sf):
    """P11 winsorise at percentiles (cuts as literals) and P10 clip to constants."""
    w = winsorize(v_wide(spark, sf), "target", 0.01, 0.99, out="t")
    w = w.withColumn("f1c", F.least(F.greatest("f1", F.lit(10.0)), F.lit(200.0)))
    return w.agg(rndf(F.sum("t")).alias("sum_t"), rndf(F.min("t")).alias("min_t"), rndf(F.max("t")).alias("max_t"),
                 rndf(F.sum("f1c")).alias("sum_f1c"))


# A21 -------------------------------------------------------------------------
@register("histogram", with_views("v_wide") + """
, mm AS (SELECT MIN(target) AS lo, MAX(target) AS hi FROM v_wide),
b AS (SELECT CAST(least(floor((target - lo) / (hi - lo) * 20.0), 19) AS INTEGER) AS bin FROM v_wide, mm),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT bins.bin, ROUND(lo + bins.bin * ((hi - lo) / 20), 6) AS "left",
       ROUND(lo + (bins.bin + 1) * ((hi - lo) / 20), 6) AS "right",
       CAST(COUNT(b.bin) AS BIGINT) AS n
FROM bins CROSS JOIN mm LEFT JOIN b ON b.bin = bins.bin GROUP BY bins.bin, lo, hi""".replace("\n, mm AS", ", mm AS", 1))
def histogram(spark, sf):
    """20-bin equal-width histogram of the target with edges."""
    h = A.histogram(v_wide(spark, sf), "target", 20)
    return h.select("bin", rnd("left").alias("left"), rnd("right").alias("right"), "n")


# A16, O4 ---------------------------------------------------------------------
def _linfit_sql(f):
    return (f"SELECT '{f}' AS feature, 1.0 - SUM(pow(target - {f}, 2)) / (var_pop(target) * COUNT(*)) AS r2_raw, "
            f"CASE WHEN var_pop({f}) > 0 THEN covar_pop({f}, target) / var_pop({f}) ELSE 0.0 END AS slope, "
            f"AVG(target) - (CASE WHEN var_pop({f}) > 0 THEN covar_pop({f}, target) / var_pop({f}) ELSE 0.0 END) * AVG({f}) AS intercept, "
            f"CASE WHEN var_pop({f}) > 0 THEN 1.0 - (var_pop(target) * COUNT(*) - COUNT(*) * covar_pop({f}, target) * covar_pop({f}, target) / var_pop({f})) / (var_pop(target) * COUNT(*)) ELSE 0.0 END AS r2_lin "
            f"FROM v_wide")


_LINFIT = "lf AS (" + _union(_linfit_sql(f) for f in [f"f{i}" for i in range(1, 10)]) + ")"


@register("linear_fit", with_views("v_wide", extra=[_LINFIT]) + f"""
SELECT feature, {S.rf('r2_raw')} AS r2_raw, {S.rf('slope')} AS slope, {S.rf('intercept')} AS intercept,
       {S.rf('r2_lin')} AS r2_lin FROM lf""")
def linear_fit(spark, sf):
    """Raw R^2, slope, intercept and linear R^2 per feature (constant feature -> 0)."""
    lf = A.linear_fit(v_wide(spark, sf), "target", [f"f{i}" for i in range(1, 10)])
    return lf.select("feature", *[rndf(x).alias(x) for x in ["r2_raw", "slope", "intercept", "r2_lin"]])


@register("top_bottom", with_views("v_wide", extra=[_LINFIT]) + f"""
SELECT * FROM (SELECT feature, {S.rf('r2_lin')} AS r2_lin, {S.rf('r2_raw')} AS r2_raw, 'top' AS side FROM lf
               ORDER BY r2_lin DESC, feature LIMIT 3)
UNION ALL
SELECT * FROM (SELECT feature, {S.rf('r2_lin')} AS r2_lin, {S.rf('r2_raw')} AS r2_raw, 'bottom' AS side FROM lf
               ORDER BY r2_raw ASC, feature LIMIT 2)""")
def top_bottom(spark, sf):
    """Top 3 by linear R^2 and bottom 2 by raw R^2."""
    lf = A.linear_fit(v_wide(spark, sf), "target", [f"f{i}" for i in range(1, 10)])
    tb = A.top_bottom(lf, 3, "r2_lin", 2, "r2_raw")
    return tb.select("feature", rndf("r2_lin").alias("r2_lin"), rndf("r2_raw").alias("r2_raw"), "side")


# A17 -------------------------------------------------------------------------
_OLS = [f"f{i}" for i in range(1, 9)]


def _ols_pair_sql(a, b):
    n = "COUNT(*)"
    rab = f"(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})))"
    u = f"({n} * covar_pop({a}, target) / stddev_pop({a}))"
    v = f"({n} * covar_pop({b}, target) / stddev_pop({b}))"
    A_, B_, D_ = n, f"({n} * {rab})", n
    det = f"({A_} * {D_} - {B_} * {B_})"
    b1 = f"(({D_} * {u} - {B_} * {v}) / {det})"
    b2 = f"(({A_} * {v} - {B_} * {u}) / {det})"
    yy = f"({n} * (var_pop(target) + AVG(target) * AVG(target)))"
    sse = f"({yy} - 2 * ({b1} * {u} + {b2} * {v}) + ({b1} * {b1} * {A_} + 2 * {b1} * {b2} * {B_} + {b2} * {b2} * {D_}))"
    r2 = f"(1.0 - {sse} / ({n} * var_pop(target)))"
    return f"SELECT '{a}' AS fa, '{b}' AS fb, {S.rf(b1)} AS beta_a, {S.rf(b2)} AS beta_b, {S.rf(r2)} AS r2 FROM v_wide"


@register("ols_pairs", with_views("v_wide") + _union(_ols_pair_sql(a, b) for a, b in combinations(_OLS, 2)))
def ols_pairs(spark, sf):
    """OLS on every pair of standardised features (no intercept) from one Gram aggregate; solves on the driver."""
    mom = A.moments(v_wide(spark, sf), _OLS, "target")
    rows = []
    for i, j in combinations(range(len(_OLS)), 2):
        beta, r2 = A.ols_standardized(mom, [i, j])
        rows.append((_OLS[i], _OLS[j], float(beta[0]), float(beta[1]), r2))
    df = spark.createDataFrame(rows, "fa string, fb string, beta_a double, beta_b double, r2 double")
    return df.select("fa", "fb", rndf("beta_a").alias("beta_a"), rndf("beta_b").alias("beta_b"), rndf("r2").alias("r2"))


# A25 -------------------------------------------------------------------------
@register("match_rate", with_views("v_ticks") + """
, n AS (SELECT price AS a, (lead(price, 1) OVER w) - (lead(price_l1, 1) OVER w) AS b
        FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id))
SELECT CAST(COUNT(b) AS BIGINT) AS n_pairs,
       ROUND(AVG(CASE WHEN b IS NULL THEN NULL WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS rate_exact,
       ROUND(AVG(CASE WHEN b IS NULL THEN NULL WHEN ABS(a - b) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS rate_lt_1em06,
       ROUND(AVG(CASE WHEN b IS NULL THEN NULL WHEN ABS(a - b) < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS rate_lt_0p0001,
       ROUND(AVG(CASE WHEN b IS NULL THEN NULL WHEN ABS(a - b) < 1.0 THEN 1.0 ELSE 0.0 END), 6) AS rate_lt_1
FROM n""".replace("\n, n AS", ", n AS", 1))
def match_rate(spark, sf):
    """Current price vs the next row's reconstructed prior level, at several tolerances."""
    t = v_ticks(spark, sf)
    s = shift(t, ["grp"], ["t", "id"], leads={"price": [1], "price_l1": [1]})
    s = s.withColumn("b", F.col("price_lead1") - F.col("price_l1_lead1"))
    m = A.match_rate(s, "price", "b")
    return m.select("n_pairs", *[rnd(c).alias(c) for c in m.columns if c != "n_pairs"])


# A23 -------------------------------------------------------------------------
@register("coverage", with_views("v_ticks") + """
SELECT ROUND(AVG(CASE WHEN price_l3 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage_l3,
       ROUND(AVG(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage_up FROM v_ticks""")
def coverage(spark, sf):
    """Share of rows meeting each condition (one aggregate)."""
    t = v_ticks(spark, sf)
    c = A.coverage(t, {"coverage_l3": F.col("price_l3").isNotNull(), "coverage_up": F.col("target") > 0})
    return c.select(*[rnd(x).alias(x) for x in c.columns])


# P16, P17 --------------------------------------------------------------------
@register("target_scaling", with_views("v_wide") + f"""
, s AS (SELECT AVG(target) AS m, stddev_pop(target) AS sd, MIN(target) AS lo, MAX(target) AS hi FROM v_wide),
z AS (SELECT (target - m) / sd AS z, 2.0 * (target - lo) / (hi - lo) - 1.0 AS mm, target * 100.0 AS pct FROM v_wide, s)
SELECT ROUND(AVG(z), 6) + 0.0 AS mean_z, ROUND(stddev_pop(z), 6) AS std_z, ROUND(MIN(mm), 6) AS min_mm,
       ROUND(MAX(mm), 6) AS max_mm, {S.rf('SUM(pct)')} AS sum_pct FROM z""".replace("\n, s AS", ", s AS", 1))
def target_scaling(spark, sf):
    """P16 z-score and min-max [-1, 1] target scaling with inverse; P17 unit rescale x100."""
    w = v_wide(spark, sf)
    z, pz = scale_target(w, "target", "zscore", out="z")
    mm, pm = scale_target(z, "target", "minmax", out="mm")
    out = mm.withColumn("back", unscale_target("z", pz)).withColumn("pct", F.col("target") * 100.0)
    return out.agg(rnd(F.avg("z")).alias("mean_z"), rnd(F.stddev_pop("z")).alias("std_z"),
                   rnd(F.min("mm")).alias("min_mm"), rnd(F.max("mm")).alias("max_mm"),
                   rndf(F.sum("pct")).alias("sum_pct"))


def _ridge_sql(feats: list[str], y: str, view: str, ridge: float) -> str:
    """Standardised ridge in SQL: normal equations from pair covariances, solved by Gauss-Jordan steps
    of a recursive CTE (positive definite, so the pivots are the diagonal)."""
    k = len(feats)
    return with_views(view, extra=[
        f"eq AS (SELECT COUNT(*) * VAR_POP({y}) AS sst, COUNT(*) * (VAR_POP({y}) + AVG({y}) * AVG({y})) AS yy, "
        f"{S.normal_equations(feats, y)} AS m FROM {view})",
        f"solve AS (SELECT 1 AS k, {S.add_ridge('m', str(ridge))} AS m FROM eq UNION ALL "
        f"SELECT k + 1, {S.solve_step('m', 'k')} FROM solve WHERE k <= {k})",
        f"beta AS (SELECT list_transform(m, lambda r: r[{k + 1}]) AS b FROM solve WHERE k = {k + 1})",
        f"""fit AS (SELECT b, 1 - (yy - list_sum(list_transform(b, lambda v, i: v * m[i][{k + 1}]))
    - {ridge} * list_sum(list_transform(b, lambda v: v * v))) / sst AS r2 FROM beta, eq)""",
    ]).replace("WITH ", "WITH RECURSIVE ", 1) + " UNION ALL ".join(
        [f"SELECT '{f}' AS term, {S.rf(f'b[{i}]')} AS value FROM fit" for i, f in enumerate(feats, 1)]
        + [f"SELECT 'r2' AS term, {S.rf('r2')} AS value FROM fit"])


@register("ols_all", _ridge_sql([f"f{i}" for i in range(1, 9)], "target", "v_wide", 0.01))
def ols_all(spark, sf):
    """A17 (all features): ridge lambda = 0.01 on all standardised features, no intercept, from the same
    single moment aggregate; coefficients and R^2."""
    feats = [f"f{i}" for i in range(1, 9)]
    mom = A.moments(v_wide(spark, sf), feats, "target")
    beta, r2 = A.ols_standardized(mom, list(range(len(feats))), ridge=0.01)
    rows = [(f, float(b)) for f, b in zip(feats, beta)] + [("r2", r2)]
    return spark.createDataFrame(rows, "term string, value double").select("term", rndf("value").alias("value"))
