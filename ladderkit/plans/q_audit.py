"""Step 10 queries: prediction contract, leakage audit, drift scores, report tables, sink round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import hash01, key, rnd, rndf
from ..operators import audit as Au
from ..operators import link as L
from ..sources import scan as Sc
from ..session import ensure_checkpoint_dir
from . import sqlgen as S
from .fixtures import v_preds, v_ticks, with_views
from .q_lookup import K
from .q_windows import h01
from .registry import register


# V1 --------------------------------------------------------------------------
@register("prediction_contract", with_views("v_ticks", extra=[
    f"lk AS (SELECT {K('price', 4)} AS pk, AVG(target) AS m FROM v_ticks WHERE is_test = 0 AND target IS NOT NULL GROUP BY 1)",
    f"pr AS (SELECT t.id AS ID, lk.m AS TARGET FROM v_ticks t LEFT JOIN lk ON lk.pk = {K('t.price', 4)} "
    f"WHERE t.is_test = 1 AND {h01('t.id')} < 0.97)",
    "ex AS (SELECT DISTINCT id AS ID FROM v_ticks WHERE is_test = 1)",
    """c AS (SELECT CAST((SELECT COUNT(*) FROM pr) AS BIGINT) AS n_rows,
       CAST((SELECT COUNT(*) - COUNT(DISTINCT ID) FROM pr) AS BIGINT) AS n_dup_ids,
       CAST((SELECT COUNT(*) FROM pr WHERE TARGET IS NULL OR isnan(TARGET)) AS BIGINT) AS n_null,
       CAST((SELECT COUNT(*) FROM ex) AS BIGINT) AS n_expected,
       CAST((SELECT COUNT(*) FROM ex WHERE ID NOT IN (SELECT ID FROM pr)) AS BIGINT) AS n_missing,
       CAST((SELECT COUNT(*) FROM pr WHERE ID NOT IN (SELECT ID FROM ex)) AS BIGINT) AS n_extra)"""]) + """
SELECT *, CAST(CASE WHEN n_missing = 0 AND n_extra = 0 AND n_null = 0 AND n_dup_ids = 0 AND n_rows = n_expected
                    THEN 1 ELSE 0 END AS INTEGER) AS ok FROM c""")
def prediction_contract(spark, sf):
    """V1: row count, exact ID set (anti joins both ways), duplicate IDs and NULL predictions."""
    t = v_ticks(spark, sf)
    tr, te = t.filter("is_test = 0"), t.filter("is_test = 1")
    j = L.lookup_join(te.withColumn("pk", key("price", 4)), tr.withColumn("pk", key("price", 4)), ["pk"], "target")
    preds = j.filter(hash01("id") < 0.97).select(F.col("id").alias("ID"), F.col("target_mean").alias("TARGET"))
    return Au.check_predictions(preds, te.select(F.col("id").alias("ID")))


# V2 --------------------------------------------------------------------------
@register("leakage_audit", with_views("v_ticks", extra=[
    f"tr AS (SELECT id, date_trunc('minute', t) AS tk, {K('price', 2)} AS pk, price, s2, target FROM v_ticks WHERE is_test = 0)",
    f"te AS (SELECT id, date_trunc('minute', t) AS tk, {K('price', 2)} AS pk, price, s2 FROM v_ticks WHERE is_test = 1)"]) + f"""
SELECT check_name, {S.rf('value')} AS value FROM (
SELECT 'id_overlap' AS check_name, CAST(COUNT(*) FILTER (WHERE id IN (SELECT id FROM tr)) AS DOUBLE) / COUNT(*) AS value FROM te
UNION ALL SELECT 'time_overlap', CAST(COUNT(*) FILTER (WHERE tk IN (SELECT tk FROM tr)) AS DOUBLE) / COUNT(*) FROM te
UNION ALL SELECT 'feature_duplicate', CAST(COUNT(*) FILTER (WHERE (price, s2) IN (SELECT (price, s2) FROM tr)) AS DOUBLE) / COUNT(*) FROM te
UNION ALL SELECT 'price_overlap', CAST(COUNT(*) FILTER (WHERE pk IN (SELECT pk FROM tr)) AS DOUBLE) / COUNT(*) FROM te
UNION ALL SELECT 'id_target_corr', {S.corr('CAST(id AS DOUBLE)', 'target')} FROM tr)""")
def leakage_audit(spark, sf):
    """V2: id / time / feature-vector / price overlap between train and test, and the ID-target correlation."""
    t = v_ticks(spark, sf)
    a = Au.leakage_audit(t.filter("is_test = 0"), t.filter("is_test = 1"), "id", F.date_trunc("minute", "t"),
                         ["price", "s2"], key("price", 2), "target")
    return a.select("check_name", rndf("value").alias("value"))


# M14 (KS / PSI) --------------------------------------------------------------
_DRIFT_F = ["price", "s2", "price_l1"]


def _drift_sql():
    lng = "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, is_test AS side FROM v_ticks WHERE {f} IS NOT NULL"
                               for f in _DRIFT_F)
    return with_views("v_ticks", extra=[
        f"u AS ({lng})",
        "per AS (SELECT feature, x, CAST(COUNT(*) FILTER (WHERE side = 0) AS DOUBLE) AS a, "
        "CAST(COUNT(*) FILTER (WHERE side = 1) AS DOUBLE) AS b FROM u GROUP BY feature, x)",
        "cum AS (SELECT feature, SUM(a) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS ca, "
        "SUM(b) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS cb, "
        "SUM(a) OVER (PARTITION BY feature) AS na, SUM(b) OVER (PARTITION BY feature) AS nb FROM per)",
        "ks AS (SELECT feature, MAX(ABS(ca / na - cb / nb)) AS ks FROM cum GROUP BY feature)",
        "rng AS (SELECT feature, MIN(x) AS lo, MAX(x) AS hi FROM u GROUP BY feature)",
        "tot AS (SELECT feature, SUM(a) AS na, SUM(b) AS nb FROM per GROUP BY feature)",
        "bn AS (SELECT u.feature, u.side, CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / (hi - lo) * 10.0), 9) AS INTEGER) "
        "ELSE 0 END AS bin FROM u JOIN rng ON rng.feature = u.feature)",
        "cnt AS (SELECT feature, bin, COUNT(*) FILTER (WHERE side = 0) AS ca, COUNT(*) FILTER (WHERE side = 1) AS cb FROM bn GROUP BY 1, 2)",
        "psi AS (SELECT c.feature, SUM((c.ca / t.na + 1e-6 - (c.cb / t.nb + 1e-6)) * ln((c.ca / t.na + 1e-6) / (c.cb / t.nb + 1e-6))) AS psi "
        "FROM cnt c JOIN tot t ON t.feature = c.feature GROUP BY c.feature)"]) + f"""
SELECT ks.feature, {S.rf('ks.ks')} AS ks, {S.rf('psi.psi')} AS psi FROM ks JOIN psi ON psi.feature = ks.feature"""


@register("drift_score", _drift_sql())
def drift_score(spark, sf):
    """M14 (SQL-checkable part): exact two-sample KS and 10-bin PSI per feature, train vs test."""
    t = v_ticks(spark, sf)
    d = Au.drift_scores(t.filter("is_test = 0"), t.filter("is_test = 1"), _DRIFT_F)
    return d.select("feature", rndf("ks").alias("ks"), rndf("psi").alias("psi"))


# V5 --------------------------------------------------------------------------
@register("report_kpis", with_views("v_preds") + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n, {S.rf('1.0 - SUM(pow(y - p1, 2)) / (var_pop(y) * COUNT(*))')} AS r2,
       {S.rf('sqrt(AVG(pow(y - p1, 2)))')} AS rmse, {S.rf('AVG(ABS(y - p1))')} AS mae,
       {S.rf('AVG(y)')} AS y_mean, {S.rf('stddev_pop(y)')} AS y_std, {S.rf('AVG(p1)')} AS p_mean,
       {S.rf('stddev_pop(p1)')} AS p_std FROM v_preds""")
def report_kpis(spark, sf):
    """V5: KPI table."""
    k = Au.report_kpis(v_preds(spark, sf), "y", "p1")
    return k.select("n", *[rndf(x).alias(x) for x in ["r2", "rmse", "mae", "y_mean", "y_std", "p_mean", "p_std"]])


def _hist_sql(name, expr):
    return f"""SELECT '{name}' AS series, bins.bin, ROUND(lo + bins.bin * ((hi - lo) / 20), 6) AS "left",
  ROUND(lo + (bins.bin + 1) * ((hi - lo) / 20), 6) AS "right", CAST(COUNT(b.bin) AS BIGINT) AS n
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) bins
  CROSS JOIN (SELECT MIN({expr}) AS lo, MAX({expr}) AS hi FROM v_preds) mm
  LEFT JOIN (SELECT CAST(least(floor(({expr} - lo) / (hi - lo) * 20.0), 19) AS INTEGER) AS bin FROM v_preds,
             (SELECT MIN({expr}) AS lo, MAX({expr}) AS hi FROM v_preds) m2) b ON b.bin = bins.bin
  GROUP BY bins.bin, lo, hi"""


@register("report_histograms", with_views("v_preds") + "\nUNION ALL\n".join(
    _hist_sql(n, e) for n, e in [("actual", "y"), ("pred", "p1"), ("residual", "(y - p1)")]))
def report_histograms(spark, sf):
    """V5: 20-bin histograms of actual, prediction and residual in one long table."""
    p = v_preds(spark, sf)
    h = Au.report_histograms(p, {"actual": F.col("y"), "pred": F.col("p1"), "residual": F.col("y") - F.col("p1")})
    return h.select("series", "bin", rnd("left").alias("left"), rnd("right").alias("right"), "n")


@register("report_scatter", with_views("v_preds") + f"""
SELECT id, {S.rf('y')} AS y, {S.rf('p1')} AS p1 FROM v_preds ORDER BY {h01()}, id LIMIT 50""")
def report_scatter(spark, sf):
    """V5: deterministic 50-point scatter sample."""
    s = Au.report_scatter(v_preds(spark, sf), ["y", "p1"], 50)
    return s.select("id", rndf("y").alias("y"), rndf("p1").alias("p1"))


# S6-S11 ----------------------------------------------------------------------
@register("sink_roundtrip", with_views("v_preds") + f"""
SELECT 'predictions_csv' AS artefact, CAST(COUNT(*) AS BIGINT) AS n_rows, {S.rf('SUM(p1)')} AS total FROM v_preds
UNION ALL SELECT 'variants_csv', CAST(3 * COUNT(*) AS BIGINT), {S.rf('SUM(p1) + SUM(p2) + SUM(p3)')} FROM v_preds
UNION ALL SELECT 'metrics_json', CAST(1 AS BIGINT), {S.rf('CAST(COUNT(*) AS DOUBLE)')} FROM v_preds""")
def sink_roundtrip(spark, sf):
    """Write predictions CSV, per-variant CSV fan-out and a JSON artefact into the shared
    checkpoint folder, then read them back (CSV with fixed schema, recursive glob scan, JSON)."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/ladderkit-sink-{uuid.uuid4().hex}"
    p = v_preds(spark, sf)
    Sc.write_predictions(p, f"{base}/predictions", id_col="id", value_col="p1")
    long = p.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("variant"), F.col(c).alias("TARGET"))
                                                 for c in ["p1", "p2", "p3"]])).alias("e")).select(
        F.col("id").alias("ID"), "e.variant", "e.TARGET")
    Sc.write_variants(long, f"{base}/variants", "variant")
    Sc.write_json(Au.report_kpis(p, "y", "p1"), f"{base}/metrics")
    pr = Sc.scan_predictions(spark, f"{base}/predictions")
    var = Sc.scan_recursive(spark, f"{base}/variants", glob="*.csv", fmt="csv", schema=Sc.PREDICTION_SCHEMA,
                            header=True)
    js = Sc.read_json(spark, f"{base}/metrics", multiline=False)
    return (pr.agg(F.lit("predictions_csv").alias("artefact"), F.count(F.lit(1)).alias("n_rows"),
                   rndf(F.sum("TARGET")).alias("total"))
            .unionByName(var.agg(F.lit("variants_csv").alias("artefact"), F.count(F.lit(1)).alias("n_rows"),
                                 rndf(F.sum("TARGET")).alias("total")))
            .unionByName(js.agg(F.lit("metrics_json").alias("artefact"), F.count(F.lit(1)).alias("n_rows"),
                                rndf(F.sum(F.col("n").cast("double"))).alias("total"))))
