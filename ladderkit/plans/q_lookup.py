"""Step 6 queries: overlap / lookup joins, priority override, key-set logic, prediction joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash01, key, lit_d, rnd, rndf, safe_corr
from ..operators import link as L
from ..operators.metrics import r2_col
from ..sources.scan import join_on_id
from . import sqlgen as S
from .fixtures import v_preds, v_ticks, with_views
from .q_windows import h01
from .registry import register


def _split(spark, sf):
    t = v_ticks(spark, sf)
    return t.filter(F.col("is_test") == 0), t.filter(F.col("is_test") == 1)


def K(expr: str, d: int) -> str:
    """SQL twin of :func:`ladderkit.functions.expr.key`."""
    return f"CAST(round_even(({expr}) * {float(10 ** d)!r}, 0) AS BIGINT)"


# J1 --------------------------------------------------------------------------
@register("overlap_join", with_views("v_ticks", extra=[
    f"ca AS (SELECT s2, {K('price', 0)} AS pk, COUNT(*) AS na FROM v_ticks WHERE is_test = 0 GROUP BY 1, 2)",
    f"cb AS (SELECT s2, {K('price', 0)} AS pk, COUNT(*) AS nb FROM v_ticks WHERE is_test = 1 GROUP BY 1, 2)"]) + """
SELECT CAST(COALESCE(SUM(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN na * nb END), 0) AS BIGINT) AS n_pairs,
       CAST(COALESCE(SUM(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN na END), 0) AS BIGINT) AS n_left_matched,
       CAST(COALESCE(SUM(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN nb END), 0) AS BIGINT) AS n_right_matched,
       CAST(COALESCE(SUM(na), 0) AS BIGINT) AS n_left, CAST(COALESCE(SUM(nb), 0) AS BIGINT) AS n_right,
       ROUND(SUM(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN nb END) / SUM(nb), 6) AS share_right_matched
FROM ca FULL OUTER JOIN cb ON ca.s2 = cb.s2 AND ca.pk = cb.pk""")
def overlap_join(spark, sf):
    """Many-to-many train/test join size and match share, from per-key counts (no pair blow-up)."""
    tr, te = _split(spark, sf)
    cols = lambda d: d.select("s2", key("price", 0).alias("pk"))
    o = L.overlap_counts(cols(tr), cols(te), ["s2", "pk"])
    return o.withColumn("share_right_matched", rnd("share_right_matched"))


# J2 --------------------------------------------------------------------------
_LK = f"""lk AS (SELECT {K('price', 4)} AS pk, AVG(target) AS m, quantile_cont(target, 0.5) AS med, COUNT(*) AS n
       FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL GROUP BY 1)"""


@register("lookup_join", with_views("v_ticks", extra=[_LK]) + f"""
SELECT t.id, {S.rf('lk.m')} AS target_mean, {S.rf('lk.med')} AS target_median, CAST(lk.n AS DOUBLE) AS target_n
FROM v_ticks t LEFT JOIN lk ON lk.pk = {K('t.price', 4)} WHERE t.is_test = 1""")
def lookup_join(spark, sf):
    """Aggregate train targets by rounded price (mean, exact median, count), left-attach to test rows."""
    tr, te = _split(spark, sf)
    j = L.lookup_join(te.withColumn("pk", key("price", 4)), tr.withColumn("pk", key("price", 4)), ["pk"], "target",
                      with_median=True)
    return j.select("id", rndf("target_mean").alias("target_mean"), rndf("target_median").alias("target_median"),
                    F.col("target_n").cast("double").alias("target_n"))


@register("lookup_coverage", with_views("v_ticks", extra=[_LK]) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_probe, ROUND(AVG(CASE WHEN lk.m IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM v_ticks t LEFT JOIN lk ON lk.pk = {K('t.price', 4)} WHERE t.is_test = 1""")
def lookup_coverage(spark, sf):
    """J2 report: share of probe rows with a lookup hit."""
    tr, te = _split(spark, sf)
    j = L.lookup_join(te.withColumn("pk", key("price", 4)), tr.withColumn("pk", key("price", 4)), ["pk"], "target")
    return j.agg(F.count(F.lit(1)).alias("n_probe"),
                 rnd(F.avg(F.when(F.col("target_mean").isNotNull(), 1.0).otherwise(0.0))).alias("coverage"))


# J3 --------------------------------------------------------------------------
@register("override", with_views("v_ticks", extra=[
    f"la AS (SELECT grp, {K('price', 4)} AS pk, AVG(target) AS m FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL GROUP BY 1, 2)",
    f"lb AS (SELECT {K('price', 0)} AS pb, AVG(target) AS m FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL GROUP BY 1)"]) + f"""
SELECT t.id, {S.rf('COALESCE(la.m, CASE WHEN lb.m IS NOT NULL THEN 0.5 * lb.m + 0.5 * 0.0 ELSE 0.0 END) * 1.05')} AS pred
FROM v_ticks t LEFT JOIN la ON la.grp = t.grp AND la.pk = {K('t.price', 4)}
LEFT JOIN lb ON lb.pb = {K('t.price', 0)} WHERE t.is_test = 1""")
def override(spark, sf):
    """J3 + P12: default 0, 50/50 blend where the coarse lookup hits, overwrite where the exact one hits; x1.05."""
    tr, te = _split(spark, sf)
    te = te.withColumn("pk", key("price", 4)).withColumn("pb", key("price", 0))
    tr = tr.withColumn("pk", key("price", 4)).withColumn("pb", key("price", 0))
    a = L.lookup_table(tr, ["grp", "pk"], "target").withColumnRenamed("target_mean", "a_mean")
    b = L.lookup_table(tr, ["pb"], "target").withColumnRenamed("target_mean", "b_mean")
    j = te.join(a, ["grp", "pk"], "left").join(b, ["pb"], "left")
    pred = L.override(lit_d(0.0), [("blend", F.col("b_mean"), 0.5), ("replace", F.col("a_mean"), 1.0)]) * lit_d(1.05)
    return j.select("id", rndf(pred).alias("pred"))


# J4 --------------------------------------------------------------------------
@register("lookup_backtest", with_views("v_ticks", extra=[
    f"tr AS (SELECT * FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL AND {h01()} >= 0.2)",
    f"ho AS (SELECT * FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL AND {h01()} < 0.2)",
    f"lk AS (SELECT {K('price', 0)} AS pb, AVG(target) AS m FROM tr GROUP BY 1)",
    f"j AS (SELECT ho.target AS y, lk.m AS p FROM ho LEFT JOIN lk ON lk.pb = {K('ho.price', 0)})"]) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_holdout, ROUND(AVG(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
       {S.rf('1.0 - SUM(CASE WHEN p IS NOT NULL THEN pow(y - p, 2) END) / (var_pop(CASE WHEN p IS NOT NULL THEN y END) * COUNT(p))')} AS r2,
       {S.rf(S.corr('CASE WHEN p IS NOT NULL THEN y END', 'p'))} AS corr
FROM j""")
def lookup_backtest(spark, sf):
    """Fit the lookup on 80 % of train (hash split), score R^2 / corr / coverage on the 20 %."""
    t = v_ticks(spark, sf).filter((F.col("is_test") == 0) & F.col("target").isNotNull()).withColumn("pb", key("price", 0))
    h = hash01("id")
    fit, hold = t.filter(h >= 0.2), t.filter(h < 0.2)
    j = L.lookup_join(hold, fit, ["pb"], "target")
    hit = F.col("target_mean").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_holdout"), rnd(F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("coverage"),
                 rndf(r2_col(F.when(hit, F.col("target")), F.col("target_mean"))).alias("r2"),
                 rndf(safe_corr(F.when(hit, F.col("target")), F.col("target_mean"))).alias("corr"))


# J5, U2, U3 ------------------------------------------------------------------
_KEYS = (f"ka AS (SELECT DISTINCT {K('price', 1)} AS pk FROM v_ticks WHERE is_test = 0)",
         f"kb AS (SELECT DISTINCT {K('price', 1)} AS pk FROM v_ticks WHERE is_test = 1)")


@register("key_overlap", with_views("v_ticks", extra=list(_KEYS)) + """
SELECT CAST(COUNT(ka.pk) AS BIGINT) AS n_left, CAST(COUNT(kb.pk) AS BIGINT) AS n_right,
       CAST(COUNT(CASE WHEN ka.pk IS NOT NULL AND kb.pk IS NOT NULL THEN 1 END) AS BIGINT) AS n_both,
       CAST(COUNT(CASE WHEN ka.pk IS NOT NULL AND kb.pk IS NULL THEN 1 END) AS BIGINT) AS n_left_only,
       CAST(COUNT(CASE WHEN kb.pk IS NOT NULL AND ka.pk IS NULL THEN 1 END) AS BIGINT) AS n_right_only
FROM ka FULL OUTER JOIN kb ON ka.pk = kb.pk""")
def key_overlap(spark, sf):
    """Overlap and one-sided key counts between train and test (rounded price keys)."""
    tr, te = _split(spark, sf)
    return L.key_overlap(tr.select(key("price", 1).alias("pk")), te.select(key("price", 1).alias("pk")), ["pk"])


@register("intersect_keys", with_views("v_ticks", extra=list(_KEYS)) + "SELECT pk FROM ka INTERSECT SELECT pk FROM kb")
def intersect_keys(spark, sf):
    """Distinct keys present in both train and test."""
    tr, te = _split(spark, sf)
    return L.intersect_keys(tr.select(key("price", 1).alias("pk")), te.select(key("price", 1).alias("pk")), ["pk"])


@register("except_keys", with_views("v_ticks", extra=list(_KEYS)) + """
SELECT 'train_only' AS side, pk FROM (SELECT pk FROM ka EXCEPT SELECT pk FROM kb)
UNION ALL SELECT 'test_only' AS side, pk FROM (SELECT pk FROM kb EXCEPT SELECT pk FROM ka)""")
def except_keys(spark, sf):
    """Key difference in both directions."""
    tr, te = _split(spark, sf)
    a, b = tr.select(key("price", 1).alias("pk")), te.select(key("price", 1).alias("pk"))
    return (L.except_keys(a, b, ["pk"]).select(F.lit("train_only").alias("side"), "pk")
            .unionByName(L.except_keys(b, a, ["pk"]).select(F.lit("test_only").alias("side"), "pk")))


# J15 -------------------------------------------------------------------------
@register("join_predictions", with_views("v_preds") + f"""
SELECT a.id, {S.rf('a.p1')} AS p1, {S.rf('b.p2')} AS p2 FROM (SELECT id, p1 FROM v_preds) a
JOIN (SELECT id, p2 FROM v_preds WHERE {h01()} < 0.9) b ON a.id = b.id""")
def join_predictions(spark, sf):
    """Align prediction tables from different sources by ID (inner join, not by position)."""
    p = v_preds(spark, sf)
    a, b = p.select("id", "p1"), p.filter(hash01("id") < 0.9).select("id", "p2")
    return join_on_id(a, b, "id").select("id", rndf("p1").alias("p1"), rndf("p2").alias("p2"))
