"""Step 2 queries: order-book feature expressions (E1-E29) over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from ..functions import book as B
from ..functions.expr import rnd, rndf
from ..operators import profile as P
from . import sqlgen as S
from .fixtures import BOOK_A, BOOK_V, WIDE_FEATURES, v_book, v_book_lags, v_ticks, v_wide, with_views
from .registry import register

PAIRS = {str(i): (f"v{i}", f"a{i}") for i in (1, 2, 3)}


def _round_all(df, keep=("id",), d=6, fn=rnd):
    return df.select(*[F.col(k) for k in keep], *[fn(c, d).alias(c) for c in df.columns if c not in keep])


def _sql_select(view: str, exprs: list[tuple[str, str]], keep=("id",), where: str = "", d: int = 6,
                rounder=S.r) -> str:
    cols = list(keep) + [f"{rounder(e, d)} AS {n}" for n, e in exprs]
    return f"SELECT {', '.join(cols)} FROM {view}{(' WHERE ' + where) if where else ''}"


# E1-E5 -----------------------------------------------------------------------
_SIDE_SQL = []
for sfx, (a, b) in PAIRS.items():
    _SIDE_SQL += [(f"spread_{sfx}", f"{a} - {b}"), (f"mid_{sfx}", f"({a} + {b}) / 2.0"),
                  (f"imbalance_{sfx}", S.imb(a, b)), (f"share_{sfx}", S.nz(a, f"{a} + {b} + 1e-10")),
                  (f"logratio_{sfx}", f"ln((ABS({a}) + 1e-10) / (ABS({b}) + 1e-10))")]


@register("side_features", with_views("v_book") + _sql_select("v_book", _SIDE_SQL))
def side_features(spark, sf):
    """Spread, mid, imbalance, share and log ratio of two sides."""
    b = v_book(spark, sf)
    return _round_all(b.select("id", *B.side_features(PAIRS)))


# E6, E7 ----------------------------------------------------------------------
_LAG_SQL = []
for lag in ("_LagT1", "_LagT2", "_LagT3"):
    for sfx, (a, b) in PAIRS.items():
        _LAG_SQL += [(f"spread_{sfx}{lag}", f"{a}{lag} - {b}{lag}"), (f"imbalance_{sfx}{lag}", S.imb(a + lag, b + lag))]
_LAG_SQL += [(f"spread_change_{sfx}", f"({a} - {b}) - ({a}_LagT1 - {b}_LagT1)") for sfx, (a, b) in PAIRS.items()]


@register("side_lag_features", with_views("v_book_l") + _sql_select("v_book_l", _LAG_SQL))
def side_lag_features(spark, sf):
    """spread/imbalance of the lag columns and spread change."""
    b = v_book_lags(spark, sf)
    cols = B.side_lag_features(PAIRS, ["_LagT1", "_LagT2", "_LagT3"])
    cols += [B.spread_change(a, b_).alias(f"spread_change_{sfx}") for sfx, (a, b_) in PAIRS.items()]
    return _round_all(b.select("id", *cols))


# E8-E12 ----------------------------------------------------------------------
_BOOK_SQL = [("book_total_a", S.plus(BOOK_A)), ("book_total_v", S.plus(BOOK_V)),
             ("book_imbalance", S.nz(f"{S.plus(BOOK_V)} - {S.plus(BOOK_A)}", f"{S.plus(BOOK_V)} + {S.plus(BOOK_A)} + 1e-10")),
             ("book_imbalance_sq", "pow(" + S.nz(f"{S.plus(BOOK_V)} - {S.plus(BOOK_A)}",
                                                 f"{S.plus(BOOK_V)} + {S.plus(BOOK_A)} + 1e-10") + ", 2.0)"),
             ("book_imbalance_weighted", S.nz(f"{S.wsum(BOOK_V)} - {S.wsum(BOOK_A)}",
                                              f"{S.wsum(BOOK_V)} + {S.wsum(BOOK_A)} + 1e-10"))]
_BOOK_SQL += [(f"level_{i}_imbalance", S.imb(BOOK_V[i], BOOK_A[i])) for i in range(len(BOOK_A))]
_BOOK_SQL += [("a_depth_gradient", f"{BOOK_A[-1]} - {BOOK_A[0]}"), ("v_depth_gradient", f"{BOOK_V[-1]} - {BOOK_V[0]}")]


@register("book_features", with_views("v_book") + _sql_select("v_book", _BOOK_SQL))
def book_features(spark, sf):
    """Ladder totals, (weighted) book imbalance, per-level imbalance, depth gradient."""
    b = v_book(spark, sf)
    cols = [B.book_total(BOOK_A).alias("book_total_a"), B.book_total(BOOK_V).alias("book_total_v"),
            B.book_imbalance(BOOK_V, BOOK_A).alias("book_imbalance"),
            B.book_imbalance_sq(BOOK_V, BOOK_A).alias("book_imbalance_sq"),
            B.book_imbalance_weighted(BOOK_V, BOOK_A).alias("book_imbalance_weighted"),
            *B.level_imbalance(BOOK_V, BOOK_A),
            B.depth_gradient(BOOK_A).alias("a_depth_gradient"), B.depth_gradient(BOOK_V).alias("v_depth_gradient")]
    return _round_all(b.select("id", *cols))


@register("level_imbalance", with_views("v_book") + _sql_select(
    "v_book", [(f"level_{i}_imbalance", S.imb(BOOK_V[i], BOOK_A[i])) for i in range(3)]))
def level_imbalance(spark, sf):
    """E11 (k-level variant): imbalance of the top 3 levels."""
    return _round_all(v_book(spark, sf).select("id", *B.level_imbalance(BOOK_V, BOOK_A, k=3)))


# E13 -------------------------------------------------------------------------
_OFI_SQL = []
for lag in ("_LagT1", "_LagT2", "_LagT3"):
    v, a = S.plus([x + lag for x in BOOK_V]), S.plus([x + lag for x in BOOK_A])
    _OFI_SQL += [(f"ofi{lag}", f"{v} - {a}"), (f"ofi_norm{lag}", S.nz(f"{v} - {a}", f"ABS({v}) + ABS({a}) + 1e-10"))]


@register("order_flow", with_views("v_book_l") + _sql_select("v_book_l", _OFI_SQL))
def order_flow(spark, sf):
    """Order-flow imbalance per lag and its normalised form."""
    b = v_book_lags(spark, sf)
    cols = []
    for lag in ("_LagT1", "_LagT2", "_LagT3"):
        o, on = B.ofi(BOOK_V, BOOK_A, lag)
        cols += [o.alias(f"ofi{lag}"), on.alias(f"ofi_norm{lag}")]
    return _round_all(b.select("id", *cols))


# E14-E17 ---------------------------------------------------------------------
_PRICE_SQL = [(f"return_lag{k}", S.nz(f"price_l{k}", "price + 1e-10")) for k in (1, 2, 3)]
_PRICE_SQL += [("return_abs_lag1", S.nz("price_l1", "ABS(price) + 1e-10")),
               ("momentum_12", "price_l1 + price_l2"), ("momentum_123", "price_l1 + price_l2 + price_l3"),
               ("acceleration", "price_l1 - price_l2"), ("jerk", "(price_l1 - price_l2) - (price_l2 - price_l3)"),
               ("vol_proxy", "ABS(price_l1) + ABS(price_l2) + ABS(price_l3)")]


@register("price_lag_features", with_views("v_ticks") + _sql_select("v_ticks", _PRICE_SQL))
def price_lag_features(spark, sf):
    """Lag returns, momentum, acceleration, jerk, volatility proxy."""
    t = v_ticks(spark, sf)
    L = ["price_l1", "price_l2", "price_l3"]
    cols = [B.lag_return(f"price_l{k}", "price").alias(f"return_lag{k}") for k in (1, 2, 3)]
    cols += [B.lag_return("price_l1", "price", use_abs=True).alias("return_abs_lag1"),
             B.momentum(L[:2]).alias("momentum_12"), B.momentum(L).alias("momentum_123"),
             B.acceleration(*L[:2]).alias("acceleration"), B.jerk(*L).alias("jerk"),
             B.vol_proxy(L).alias("vol_proxy")]
    return _round_all(t.select("id", *cols))


# E18 -------------------------------------------------------------------------
@register("self_change", with_views("v_book_l") + _sql_select(
    "v_book_l", [(f"{x}_change", f"{x} - {x}_LagT1") for x in BOOK_A + BOOK_V]))
def self_change(spark, sf):
    """``x - x_LagT1`` over a grid of columns."""
    b = v_book_lags(spark, sf)
    return _round_all(b.select("id", *[B.self_change(x).alias(f"{x}_change") for x in BOOK_A + BOOK_V]))


# E19-E21 ---------------------------------------------------------------------
_BI = S.nz(f"{S.plus(BOOK_V)} - {S.plus(BOOK_A)}", f"{S.plus(BOOK_V)} + {S.plus(BOOK_A)} + 1e-10")
_OFI1 = f"{S.plus([x + '_LagT1' for x in BOOK_V])} - {S.plus([x + '_LagT1' for x in BOOK_A])}"
_INTER_SQL = [("price_x_imbalance", f"v1 * ({_BI})"), ("imbalance_x_momentum", f"({_BI}) * (v1_LagT1 + v1_LagT2)"),
              ("ofi1_x_price", f"({_OFI1}) * v1"), ("spread_x_imbalance", f"(v1 - a1) * ({_BI})"),
              ("v1_x_a1", "v1 * a1"), ("v1_ratio_a1", S.nz("v1", "ABS(a1) + 1e-10")),
              ("v1_diff_a1", "v1 - a1"), ("v1_sum_a1", "v1 + a1"),
              ("v2_sq", "pow(v2, 2.0)"), ("v2_inv", S.nz("1.0", "v2 + 1e-10"))]


@register("interactions", with_views("v_book_l") + _sql_select("v_book_l", _INTER_SQL))
def interactions(spark, sf):
    """Cross interactions, pair product/ratio/diff/sum, square and inverse."""
    b = v_book_lags(spark, sf)
    bi = B.book_imbalance(BOOK_V, BOOK_A)
    o1, _ = B.ofi(BOOK_V, BOOK_A, "_LagT1")
    cols = [B.interaction("v1", bi).alias("price_x_imbalance"),
            B.interaction(bi, B.momentum(["v1_LagT1", "v1_LagT2"])).alias("imbalance_x_momentum"),
            B.interaction(o1, "v1").alias("ofi1_x_price"),
            B.interaction(B.side_spread("v1", "a1"), bi).alias("spread_x_imbalance"),
            *B.pair_features("v1", "a1"), *B.poly_inv("v2")]
    return _round_all(b.select("id", *cols))


# E22 -------------------------------------------------------------------------
_FAM = ["price_l1", "price_l2", "price_l3", "s2_l1"]
_n = " + ".join(f"(CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN 1 ELSE 0 END)" for x in _FAM)
_s = " + ".join(f"COALESCE({x}, 0.0)" for x in _FAM)
_ROWSTATS_SQL = with_views("v_ticks", extra=[
    f"rs AS (SELECT id, ({_n}) AS n_, ({_s}) AS s_, {', '.join(_FAM)} FROM v_ticks)"]) + f"""
SELECT id, ROUND(CASE WHEN n_ = 0 THEN NULL ELSE s_ / n_ END, 6) AS row_mean,
       ROUND(CASE WHEN n_ = 0 THEN NULL ELSE sqrt(({' + '.join(f"COALESCE(pow({x} - s_ / n_, 2), 0.0)" for x in _FAM)}) / n_) END, 6) AS row_std
FROM rs"""


@register("row_stats", _ROWSTATS_SQL)
def row_stats(spark, sf):
    """NULL/NaN-skipping row mean and population std over a column family."""
    t = v_ticks(spark, sf)
    m, s = B.row_stats(_FAM)
    return t.select("id", rnd(m).alias("row_mean"), rnd(s).alias("row_std"))


# E23, E24 --------------------------------------------------------------------
def _fam_sql(lag: str, L: int):
    cols = [x + lag for x in BOOK_A]
    s, sq = S.plus(cols), "(" + " + ".join(f"{c} * {c}" for c in cols) + ")"
    m = f"({s} / {float(L)!r})"
    return m, f"sqrt(greatest({sq} / {float(L)!r} - {m} * {m}, 0.0))"


_FAM_L = len(BOOK_A) + 1  # one family member absent: the mean still divides by the full list length
_m = {k: _fam_sql(f"_LagT{k}", _FAM_L) for k in (1, 2, 3)}
_LAGFAM_SQL = [(f"lag_t{k}_mean", _m[k][0]) for k in (1, 2, 3)] + [(f"lag_t{k}_std", _m[k][1]) for k in (1, 2, 3)]
_LAGFAM_SQL += [("lag_accel", f"{_m[1][0]} - {_m[2][0]}"),
                ("lag_jerk", f"({_m[1][0]} - {_m[2][0]}) - ({_m[2][0]} - {_m[3][0]})"),
                ("lag_t1_t2_ratio", S.nz(_m[1][0], f"ABS({_m[2][0]}) + 1e-10")),
                ("lag_momentum_consistency", S.nz(_m[1][1], f"{_m[2][1]} + 1e-10"))]


@register("lag_family", with_views("v_book_l") + _sql_select("v_book_l", _LAGFAM_SQL, rounder=S.rf))
def lag_family(spark, sf):
    """Lag-family two-moment mean/std (full-length divisor) and their dynamics."""
    b = v_book_lags(spark, sf)
    fams = {k: P.cols_like(b, suffix=f"_LagT{k}", prefix="a") for k in (1, 2, 3)}  # P2: select by name pattern
    stats = {k: B.lag_family_stats(fams[k], n_total=_FAM_L) for k in (1, 2, 3)}
    cols = [stats[k][0].alias(f"lag_t{k}_mean") for k in (1, 2, 3)]
    cols += [stats[k][1].alias(f"lag_t{k}_std") for k in (1, 2, 3)]
    cols += B.lag_family_dynamics(stats[1][0], stats[2][0], stats[3][0], stats[1][1], stats[2][1])
    return _round_all(b.select("id", *cols), fn=rndf)


# E25 -------------------------------------------------------------------------
@register("prior_levels", with_views("v_ticks") + _sql_select(
    "v_ticks", [(f"price_prev{k}", f"price - price_l{k}") for k in (1, 2, 3)]))
def prior_levels(spark, sf):
    """Reconstruct prior price levels from lag differences."""
    t = v_ticks(spark, sf)
    return _round_all(t.select("id", *[B.prior_level("price", f"price_l{k}").alias(f"price_prev{k}") for k in (1, 2, 3)]))


# E26 -------------------------------------------------------------------------
_OSC_SQL = [(f"osc_{i}", f"least(greatest(({WIDE_FEATURES[2 * i]}) / ({WIDE_FEATURES[2 * i + 1]} + 1e-8), -100.0), 100.0)")
            for i in range(4)]


@register("oscillators", with_views("v_wide") + _sql_select("v_wide", _OSC_SQL))
def oscillators(spark, sf):
    """Adjacent-pair ratio oscillators clipped to +-100."""
    w = v_wide(spark, sf)
    return _round_all(w.select("id", *B.oscillators(WIDE_FEATURES, 4)))


# E27 -------------------------------------------------------------------------
_K, _REACH = 6, 4
_TOPK_SQL = with_views("v_wide", extra=[
    "corr_t AS (" + "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, {S.corr(f, 'target')} AS corr FROM v_wide"
                                         for f in WIDE_FEATURES) + ")",
    f"top AS (SELECT feature, row_number() OVER (ORDER BY ABS(corr) ASC, feature DESC) - 1 AS pos FROM "
    f"(SELECT * FROM corr_t ORDER BY ABS(corr) DESC, feature ASC LIMIT {_K}))",
    f"pairs AS (SELECT a.feature AS fa, b.feature AS fb FROM top a JOIN top b ON b.pos > a.pos AND b.pos <= a.pos + {_REACH})",
    "long AS (UNPIVOT (SELECT id, target, " + ", ".join(WIDE_FEATURES) + " FROM v_wide) ON "
    + ", ".join(WIDE_FEATURES) + " INTO NAME feature VALUE x)",
    "prod AS (SELECT p.fa || '_x_' || p.fb AS feature, la.target AS y, la.x * lb.x AS x FROM pairs p "
    "JOIN long la ON la.feature = p.fa JOIN long lb ON lb.feature = p.fb AND lb.id = la.id)"]) + f"""
SELECT feature, ROUND({S.corr('x', 'y')}, 6) AS corr, {S.rf('SUM(x)')} AS sum_x FROM prod GROUP BY feature"""


@register("top_k_interactions", _TOPK_SQL)
def top_k_interactions(spark, sf):
    """Products of the top-k correlated features, each with the next ``reach`` (ascending |corr|)."""
    w = v_wide(spark, sf)
    top = P.top_features(P.target_corr(w, "target", WIDE_FEATURES), _K)
    # k names (bounded by the schema width) come to the driver to generate columns
    names = [r["feature"] for r in top.collect()][::-1]
    pairs = B.top_k_pairs(names, _REACH)
    cols = [B.interaction(a, b).alias(f"{a}_x_{b}") for a, b in pairs]
    feats = w.select("target", *cols)
    names_out = [f"{a}_x_{b}" for a, b in pairs]
    corr = P.target_corr(feats, "target", names_out)
    sums = P.to_long(feats, names_out).groupBy("feature").agg(rndf(F.sum("x")).alias("sum_x"))
    return corr.join(sums, "feature").select("feature", rnd("corr").alias("corr"), "sum_x")


# E28 -------------------------------------------------------------------------
@register("assemble", with_views("v_wide") + _sql_select(
    "v_wide", [("vec_sum", S.plus(WIDE_FEATURES[:8])), ("vec_first", "f1"), ("vec_last", "f8")],
    keep=("id", "CAST(8 AS INTEGER) AS vec_size")))
def assemble(spark, sf):
    """Assemble named features into an ML vector with a stable order (VectorAssembler)."""
    w = v_wide(spark, sf)
    va = VectorAssembler(inputCols=WIDE_FEATURES[:8], outputCol="features", handleInvalid="keep")
    out = va.transform(w).select("id", vector_to_array("features").alias("a"))
    return out.select("id", F.size("a").alias("vec_size"),
                      rnd(F.aggregate("a", F.lit(0.0), lambda acc, v: acc + v)).alias("vec_sum"),
                      rnd(F.element_at("a", 1)).alias("vec_first"), rnd(F.element_at("a", -1)).alias("vec_last"))


# E29 -------------------------------------------------------------------------
_GA, _GB = ["f1", "f2", "f3"], ["f5", "f6", "f7"]


@register("diff_grid", with_views("v_wide", extra=[
    "g AS (" + "\nUNION ALL\n".join(f"SELECT '{a}_minus_{b}' AS feature, {S.corr(f'{a} - {b}', 'target')} AS corr FROM v_wide"
                                    for a in _GA for b in _GB) + ")"]) + """
SELECT feature, ROUND(corr, 6) AS corr FROM g WHERE ABS(corr) > 0.05""")
def diff_grid(spark, sf):
    """Every a-b difference, correlation with the target, keep |corr| > 0.05."""
    w = v_wide(spark, sf)
    grid = w.select("target", *B.diff_grid(_GA, _GB))
    corr = P.target_corr(grid, "target", [f"{a}_minus_{b}" for a in _GA for b in _GB])
    return corr.filter(F.abs("corr") > 0.05).select("feature", rnd("corr").alias("corr"))
