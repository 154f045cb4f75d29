"""Step 9 queries: blending, scaling and calibration on the prediction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash01, lit_d, rnd, rndf
from ..operators import blend as Bl
from ..operators import windows as W
from . import sqlgen as S
from .fixtures import PRED_COLS, v_preds, with_views
from .q_windows import h01
from .registry import register

_R2 = "1.0 - SUM(pow(y - ({p}), 2)) / (var_pop(y) * COUNT(*))"


def r2sql(p: str) -> str:
    return _R2.format(p=p)


# B1, B15 ---------------------------------------------------------------------
@register("blend_fixed", with_views("v_preds") + f"""
SELECT id, {S.rf('p1 * 0.5 + p2 * 0.3 + p3 * 0.2')} AS blend, {S.rf('(p1 + p2 + p3) / 3.0')} AS mean3 FROM v_preds""")
def blend_fixed(spark, sf):
    """B1 fixed normalised weights (5:3:2) and B15 plain column mean."""
    p = v_preds(spark, sf)
    return p.select("id", rndf(Bl.blend(PRED_COLS, [5, 3, 2])).alias("blend"),
                    rndf(Bl.mean_columns(PRED_COLS)).alias("mean3"))


# B2 --------------------------------------------------------------------------
@register("blend_pairs", with_views("v_preds", extra=["g AS (SELECT range / 10.0 AS alpha FROM range(1, 10))"]) + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(alpha, 6) AS alpha, {S.rf(r2sql(f'alpha * {a} + (1.0 - alpha) * {b}'))} AS r2 "
    f"FROM v_preds CROSS JOIN g GROUP BY alpha" for a, b in [("p1", "p2"), ("p1", "p3"), ("p2", "p3")]))
def blend_pairs(spark, sf):
    """B2: pairwise alpha grid 0.1..0.9 over all model pairs, from one moment aggregate."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    g = Bl.blend_pairs(spark, mom)
    return g.select("a", "b", rnd("alpha").alias("alpha"), rndf("r2").alias("r2"))


# B3 --------------------------------------------------------------------------
@register("blend_simplex", with_views("v_preds", extra=[
    "g AS (SELECT i.range / 10.0 AS w1, j.range / 10.0 AS w2, (10 - i.range - j.range) / 10.0 AS w3 "
    "FROM range(0, 11) i JOIN range(0, 11) j ON i.range + j.range <= 10)"]) + f"""
SELECT ROUND(w1, 6) AS w1, ROUND(w2, 6) AS w2, ROUND(w3, 6) AS w3, {S.rf(r2sql('w1 * p1 + w2 * p2 + w3 * p3'))} AS r2
FROM v_preds CROSS JOIN g GROUP BY w1, w2, w3""")
def blend_simplex(spark, sf):
    """3-weight simplex grid (step 0.1) from the same single aggregate."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    g = Bl.blend_simplex(spark, mom, 0.1)
    return g.select(rnd("w1").alias("w1"), rnd("w2").alias("w2"), rnd("w3").alias("w3"), rndf("r2").alias("r2"))


# B4 --------------------------------------------------------------------------
@register("scale_grid", with_views("v_preds", extra=["g AS (SELECT 0.5 + range * 0.05 AS scale FROM range(0, 50))"]) + f"""
SELECT ROUND(scale, 6) AS scale, {S.rf(r2sql('scale * p1'))} AS r2 FROM v_preds CROSS JOIN g GROUP BY scale""")
def scale_grid(spark, sf):
    """Scale grid 0.5..2.95 on a prediction (closed-form optimum available via best_scale)."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    g = Bl.scale_grid(spark, mom, [1.0, 0.0, 0.0], hi=3.0)
    return g.select(rnd("scale").alias("scale"), rndf("r2").alias("r2"))


@register("best_scale", with_views("v_preds") + f"""
SELECT {S.rf('SUM(y * p1) / SUM(p1 * p1)')} AS best_scale FROM v_preds""")
def best_scale(spark, sf):
    """B4 closed form: least-squares scale sum(y p) / sum(p^2) from the moments."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    return spark.createDataFrame([(Bl.best_scale(mom, [1.0, 0.0, 0.0]),)], "best_scale double").select(
        rndf("best_scale").alias("best_scale"))


# B5 --------------------------------------------------------------------------
@register("shrink_guard", with_views("v_preds", extra=[
    "g AS (SELECT range / 100.0 AS alpha FROM range(0, 101))",
    f"s AS (SELECT alpha, {r2sql('alpha * p3')} AS r2 FROM v_preds CROSS JOIN g GROUP BY alpha)",
    f"z AS (SELECT {r2sql('0.0')} AS zero_r2, {r2sql('p3')} AS blend_r2 FROM v_preds)",
    "b AS (SELECT alpha, r2 FROM s ORDER BY r2 DESC, alpha LIMIT 1)"]) + f"""
SELECT {S.rf('zero_r2')} AS zero_r2, {S.rf('blend_r2')} AS blend_r2,
       ROUND(CASE WHEN blend_r2 < zero_r2 THEN alpha ELSE 1.0 END, 6) AS alpha,
       {S.rf('CASE WHEN blend_r2 < zero_r2 THEN r2 ELSE blend_r2 END')} AS r2 FROM z CROSS JOIN b""")
def shrink_guard(spark, sf):
    """The poor model p3 is worse than predicting 0 -> best shrink factor in [0, 1]."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    g = Bl.shrink_guard(spark, mom, [0.0, 0.0, 1.0])
    return g.select(rndf("zero_r2").alias("zero_r2"), rndf("blend_r2").alias("blend_r2"), rnd("alpha").alias("alpha"),
                    rndf("r2").alias("r2"))


# B6, B7 ----------------------------------------------------------------------
_SOLO = "solo AS (" + "\nUNION ALL\n".join(f"SELECT '{p}' AS model, {r2sql(p)} AS r2 FROM v_preds" for p in PRED_COLS) + ")"


@register("r2_weights", with_views("v_preds", extra=[_SOLO]) + f"""
SELECT model, {S.rf('r2')} AS r2, {S.rf('CASE WHEN (SELECT SUM(greatest(r2, 0.0)) FROM solo) > 0 '
                                        'THEN greatest(r2, 0.0) / (SELECT SUM(greatest(r2, 0.0)) FROM solo) '
                                        'ELSE 1.0 / 3 END')} AS weight FROM solo""")
def r2_weights(spark, sf):
    """Weights proportional to max(0, R^2), equal if none positive."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    w = Bl.r2_weights(spark, mom)
    return w.select("model", rndf("r2").alias("r2"), rndf("weight").alias("weight"))


@register("best_solo", with_views("v_preds", extra=[_SOLO,
                                                    f"bl AS (SELECT {r2sql('(p1 + p2 + p3) / 3.0')} AS b FROM v_preds)",
                                                    "top AS (SELECT model, r2 FROM solo ORDER BY r2 DESC, model LIMIT 1)"]) + f"""
SELECT CASE WHEN top.r2 > bl.b THEN top.model ELSE 'blend' END AS choice,
       {S.rf('CASE WHEN top.r2 > bl.b THEN top.r2 ELSE bl.b END')} AS r2, {S.rf('bl.b')} AS blend_r2 FROM top CROSS JOIN bl""")
def best_solo(spark, sf):
    """Keep the best single model when it beats the equal-weight blend."""
    mom = Bl.Moments(v_preds(spark, sf), "y", PRED_COLS)
    b = Bl.best_solo_guard(spark, mom, [1 / 3, 1 / 3, 1 / 3])
    return b.select("choice", rndf("r2").alias("r2"), rndf("blend_r2").alias("blend_r2"))


# B8-B10 ----------------------------------------------------------------------
@register("std_scale", with_views("v_preds", extra=[
    "st AS (SELECT stddev_pop(y) AS sy, stddev_pop(p1) AS sp, MIN(y) AS lo, MAX(y) AS hi FROM v_preds)",
    "sc AS (SELECT least(greatest(p1 * (sy / sp), lo), hi) AS v, p1 * (sy / sp) AS u FROM v_preds CROSS JOIN st)"]) + f"""
SELECT {S.rf('stddev_pop(u)')} AS std_scaled, {S.rf('AVG(v)')} AS mean_clipped, {S.rf('MAX(v)')} AS max_clipped,
       {S.rf('(SELECT sy FROM st)')} AS std_target FROM sc""")
def std_scale(spark, sf):
    """Std-ratio scaling (output std equals the target std) and its target-range clip."""
    p = v_preds(spark, sf)
    u = Bl.std_scale(p, "p1", "y", out="u")
    v = Bl.std_scale(u, "p1", "y", clip_to_target=True, out="v")
    return v.agg(rndf(F.stddev_pop("u")).alias("std_scaled"), rndf(F.avg("v")).alias("mean_clipped"),
                 rndf(F.max("v")).alias("max_clipped"), rndf(F.stddev_pop("y")).alias("std_target"))


_QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _ql_sql(pred: str) -> str:
    xs = [f"quantile_cont({pred}, {q!r})" for q in _QS]
    ys = [f"quantile_cont(y, {q!r})" for q in _QS]
    return (f"ql AS (SELECT {', '.join(f'{x} AS x{i}' for i, x in enumerate(xs))}, "
            f"{', '.join(f'{v} AS y{i}' for i, v in enumerate(ys))} FROM v_preds), "
            f"fit AS (SELECT ({'+'.join(f'x{i}' for i in range(7))}) AS sx, ({'+'.join(f'y{i}' for i in range(7))}) AS sy, "
            f"({'+'.join(f'x{i} * y{i}' for i in range(7))}) AS sxy, ({'+'.join(f'x{i} * x{i}' for i in range(7))}) AS sxx FROM ql), "
            "line AS (SELECT (7 * sxy - sx * sy) / (7 * sxx - sx * sx + 1e-10) AS m, sx, sy FROM fit)")


@register("quantile_linear", with_views("v_preds", extra=[_ql_sql("p2")]) + f"""
SELECT {S.rf('m')} AS slope, {S.rf('(sy - m * sx) / 7')} AS intercept FROM line""")
def quantile_linear(spark, sf):
    """Least-squares line of 7 target quantiles on 7 prediction quantiles."""
    m, b = Bl.quantile_linear_fit(v_preds(spark, sf), "p2", "y", _QS)
    return spark.createDataFrame([(m, b)], "slope double, intercept double").select(
        rndf("slope").alias("slope"), rndf("intercept").alias("intercept"))


@register("fixed_scale", with_views("v_preds", extra=[
    "b AS (SELECT MIN(y) AS lo, MAX(y) AS hi FROM v_preds)",
    "k AS (SELECT * FROM (VALUES (10.0), (1.25), (1.15), (1.10), (1.05)) t(k))"]) + f"""
SELECT ROUND(k, 6) AS k, {S.rf('AVG(least(greatest(p2 * k, lo), hi))')} AS mean,
       {S.rf('MAX(least(greatest(p2 * k, lo), hi))')} AS max FROM v_preds CROSS JOIN b CROSS JOIN k GROUP BY k""")
def fixed_scale(spark, sf):
    """Constant scales with a clip to the target bounds."""
    p = v_preds(spark, sf)
    r = p.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    ks = [10.0, 1.25, 1.15, 1.10, 1.05]
    long = p.select(F.explode(F.array(*[F.struct(lit_d(k).alias("k"),
                                                 Bl.fixed_scale("p2", k, r["lo"], r["hi"]).alias("v")) for k in ks])).alias("e"))
    return long.groupBy(F.col("e.k").alias("k")).agg(rndf(F.avg("e.v")).alias("mean"), rndf(F.max("e.v")).alias("max")).select(
        rnd("k").alias("k"), "mean", "max")


# B11, B12 --------------------------------------------------------------------
def _variants(spark, sf):
    # the prediction table feeds five passes (moments, two sorts, a join): materialise it once
    p = v_preds(spark, sf).checkpoint()
    st = p.agg(F.stddev_pop("y").alias("sy"), F.stddev_pop("p2").alias("sp"), F.min("y").alias("lo"),
               F.max("y").alias("hi")).first()
    m, b = Bl.quantile_linear_fit(p, "p2", "y", _QS)
    rq = W.rank_map_quantile(p.select("id", "p2"), "p2", "id", p, "y", out="v3").select("id", "v3")
    out = p.join(rq, "id").select(
        "id", "y", (F.col("p2") * lit_d(st["sy"] / st["sp"])).alias("v1"),
        F.least(F.greatest(F.col("p2") * lit_d(m) + lit_d(b), lit_d(st["lo"])), lit_d(st["hi"])).alias("v2"), "v3",
        F.least(F.greatest(F.col("p2") * 10.0, lit_d(st["lo"])), lit_d(st["hi"])).alias("v4"))
    return out.withColumn("ens", Bl.mean_columns(["v1", "v2", "v3", "v4"]))


_VAR_SQL = [_ql_sql("p2"),
            "st AS (SELECT stddev_pop(y) AS sy, stddev_pop(p2) AS sp, MIN(y) AS lo, MAX(y) AS hi FROM v_preds)",
            "r AS (SELECT id, (row_number() OVER (ORDER BY p2, id) - 1) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) AS p FROM v_preds)",
            "sy AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM v_preds)",
            "q AS (SELECT r.id, r.p * ((SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) - 1.0) AS h FROM r)",
            "rq AS (SELECT q.id, lo.y + (q.h - floor(q.h)) * (hi.y - lo.y) AS v3 FROM q JOIN sy lo ON lo.i = CAST(floor(q.h) AS BIGINT) "
            "JOIN sy hi ON hi.i = CAST(ceil(q.h) AS BIGINT))",
            "var AS (SELECT v.id, v.y, v.p2 * (st.sy / st.sp) AS v1, "
            "least(greatest(v.p2 * line.m + (line.sy - line.m * line.sx) / 7, st.lo), st.hi) AS v2, rq.v3, "
            "least(greatest(v.p2 * 10.0, st.lo), st.hi) AS v4 FROM v_preds v JOIN rq ON rq.id = v.id CROSS JOIN st CROSS JOIN line)"]


@register("strategy_ensemble", with_views("v_preds", extra=_VAR_SQL) + f"""
SELECT id, {S.rf('v1')} AS v1, {S.rf('v2')} AS v2, {S.rf('v3')} AS v3, {S.rf('v4')} AS v4,
       {S.rf('v1 * 0.25 + v2 * 0.25 + v3 * 0.25 + v4 * 0.25')} AS ens FROM var""")
def strategy_ensemble(spark, sf):
    """Four calibration strategies (std-ratio, quantile-linear, rank map, x10 clip) and their mean."""
    v = _variants(spark, sf)
    return v.select("id", *[rndf(x).alias(x) for x in ["v1", "v2", "v3", "v4", "ens"]])


@register("strategy_select", with_views("v_preds", extra=_VAR_SQL + [
    "sc AS (" + "\nUNION ALL\n".join(f"SELECT '{x}' AS variant, {r2sql(x)} AS r2 FROM var" for x in ["v1", "v2", "v3", "v4"]) + ")"]) + f"""
SELECT variant, {S.rf('r2')} AS r2, CASE WHEN variant = (SELECT variant FROM sc ORDER BY r2 DESC, variant LIMIT 1)
       THEN 1 ELSE 0 END AS is_best FROM sc""")
def strategy_select(spark, sf):
    """Score every strategy (R^2) and flag the best."""
    v = _variants(spark, sf)
    sc = Bl.variant_scores(v, "y", ["v1", "v2", "v3", "v4"])
    best = sc.orderBy(F.col("r2").desc(), "variant").limit(1).select(F.col("variant").alias("_b"), F.lit(1).alias("_f"))
    return sc.join(F.broadcast(best), F.col("variant") == F.col("_b"), "left").select(
        "variant", rndf("r2").alias("r2"), F.coalesce("_f", F.lit(0)).alias("is_best"))


# B13 -------------------------------------------------------------------------
@register("blend_files", with_views("v_preds") + f"""
SELECT a.id, {S.rf('0.5 * a.p1 + 0.5 * b.p3')} AS TARGET FROM (SELECT id, p1 FROM v_preds) a
JOIN (SELECT id, p3 FROM v_preds WHERE {h01()} < 0.9) b ON a.id = b.id""")
def blend_files(spark, sf):
    """50/50 blend of two prediction tables joined on ID."""
    p = v_preds(spark, sf)
    a, b = p.select("id", "p1"), p.filter(hash01("id") < 0.9).select("id", "p3")
    return a.join(b, "id").select("id", rndf(Bl.blend(["p1", "p3"], [1, 1])).alias("TARGET"))
