"""Step 5 queries: shifts, sweeps, smoothing, fills, ranks and rank mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash01, rnd, rndf, safe_corr
from ..operators import windows as W
from ..operators.sequence import shift
from . import sqlgen as S
from .fixtures import v_preds, v_ticks, with_views
from .registry import register

HASH01_SQL = "(CAST(('0x' || substr(md5('42:' || CAST({id} AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0)"


def h01(idcol: str = "id") -> str:
    return HASH01_SQL.format(id=idcol)


# W1 --------------------------------------------------------------------------
@register("shift", with_views("v_ticks") + """
SELECT id, lag(price, 1) OVER w AS prev_price, lead(price, 1) OVER w AS next_price,
       CAST(lead(id, 1) OVER w AS DOUBLE) AS next_id, lag(price_l1, 2) OVER w AS prev2_l1
FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id)""")
def shift_q(spark, sf):
    """Group lag/lead of price, id and a lag column (skew-checked plan)."""
    t = v_ticks(spark, sf)
    s = shift(t, ["grp"], ["t", "id"], lags={"price": [1], "price_l1": [2]}, leads={"price": [1], "id": [1]})
    return s.select("id", F.col("price_lag1").alias("prev_price"), F.col("price_lead1").alias("next_price"),
                    F.col("id_lead1").cast("double").alias("next_id"), F.col("price_l1_lag2").alias("prev2_l1"))


# W2 --------------------------------------------------------------------------
_HS = list(range(1, 25))


def _sweep_sql():
    parts = []
    for h in _HS:
        parts.append(f"SELECT {h} AS h, target AS y, 100.0 * COALESCE((lead(price, {h}) OVER w - price) / NULLIF(ABS(price) + 1e-10, 0), 0.0) AS ret, "
                     f"lead(price, {h}) OVER w - price AS diff, is_test FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id)")
    return "sw AS (" + "\nUNION ALL\n".join(parts) + ")"


@register("horizon_sweep", with_views("v_ticks", extra=[_sweep_sql()]) + f"""
SELECT CAST(h AS INTEGER) AS h, CAST(COUNT(*) AS BIGINT) AS n,
       {S.rf('1.0 - SUM(pow(y - ret, 2)) / (var_pop(y) * COUNT(*))')} AS r2_return,
       {S.rf('1.0 - SUM(pow(y - diff, 2)) / (var_pop(y) * COUNT(*))')} AS r2_diff,
       {S.rf(S.corr('ret', 'y'))} AS corr_return
FROM sw WHERE is_test = 0 AND y IS NOT NULL AND diff IS NOT NULL GROUP BY h""")
def horizon_sweep(spark, sf):
    """Forward-return sweep over horizons 1..24 in one window pass, scored on train rows."""
    t = v_ticks(spark, sf)
    sw = W.horizon_sweep(t, "price", "target", ["grp"], ["t", "id"], _HS, scale=100.0, mask=F.col("is_test") == 0)
    return sw.select("h", "n", *[rndf(x).alias(x) for x in ["r2_return", "r2_diff", "corr_return"]])


@register("best_horizon", with_views("v_ticks", extra=[_sweep_sql()]) + f"""
SELECT CAST(h AS INTEGER) AS h, {S.rf('r2')} AS r2_return FROM (
  SELECT h, 1.0 - SUM(pow(y - ret, 2)) / (var_pop(y) * COUNT(*)) AS r2 FROM sw
  WHERE is_test = 0 AND y IS NOT NULL AND diff IS NOT NULL GROUP BY h) ORDER BY r2 DESC, h LIMIT 1""")
def best_horizon(spark, sf):
    """W2 + O6: the best horizon by R^2."""
    t = v_ticks(spark, sf)
    sw = W.horizon_sweep(t, "price", "target", ["grp"], ["t", "id"], _HS, scale=100.0, mask=F.col("is_test") == 0)
    return W.best_horizon(sw).select("h", rndf("r2_return").alias("r2_return"))


# W3 --------------------------------------------------------------------------
@register("forward_block", with_views("v_ticks") + "SELECT id, " + ", ".join(
    f"{S.rf(S.nz(f'lead(price, {i}) OVER w - price', 'ABS(price) + 1e-8'))} AS fwd_{i}" for i in range(1, 20))
    + " FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id)")
def forward_block(spark, sf):
    """The next 19 prices as ratios to the current one."""
    fb = W.forward_block(v_ticks(spark, sf), "price", ["grp"], ["t", "id"], 19)
    return fb.select("id", *[rndf(f"fwd_{i}").alias(f"fwd_{i}") for i in range(1, 20)])


# W4 --------------------------------------------------------------------------
@register("gap_stats", with_views("v_ticks") + """
, g AS (SELECT lead(id, 1) OVER (PARTITION BY grp ORDER BY id) - id AS gap FROM v_ticks)
SELECT CAST(MIN(gap) AS BIGINT) AS min_gap, CAST(MAX(gap) AS BIGINT) AS max_gap, ROUND(AVG(gap), 6) AS mean_gap,
       ROUND(quantile_cont(gap, 0.5), 6) AS median_gap,
       ROUND(AVG(CASE WHEN gap = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_eq1,
       ROUND(AVG(CASE WHEN gap > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_gt1, CAST(COUNT(*) AS BIGINT) AS n
FROM g WHERE gap IS NOT NULL""")
def gap_stats(spark, sf):
    """ID gap to the next row within the group."""
    g = W.gap_stats(v_ticks(spark, sf), "id", ["grp"])
    return g.select("min_gap", "max_gap", rnd("mean_gap").alias("mean_gap"), rnd("median_gap").alias("median_gap"),
                    rnd("share_eq1").alias("share_eq1"), rnd("share_gt1").alias("share_gt1"), "n")


# W5 --------------------------------------------------------------------------
@register("chain_check", with_views("v_ticks") + """
, c AS (SELECT price, (lead(price, 1) OVER w) - (lead(price_l1, 1) OVER w) AS prior, lead(price_l1, 1) OVER w AS raw
        FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id))
SELECT CAST(COUNT(prior) AS BIGINT) AS n,
       ROUND(AVG(CASE WHEN prior IS NULL THEN NULL WHEN ABS(price - prior) < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS rate_prior_0p0001,
       ROUND(AVG(CASE WHEN prior IS NULL THEN NULL WHEN ABS(price - raw) < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS rate_raw_0p0001,
       ROUND(AVG(CASE WHEN prior IS NULL THEN NULL WHEN ABS(price - prior) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS rate_prior_1em06,
       ROUND(AVG(CASE WHEN prior IS NULL THEN NULL WHEN ABS(price - raw) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS rate_raw_1em06
FROM c""")
def chain_check(spark, sf):
    """Price vs the next row's reconstructed prior level and raw lag column."""
    c = W.chain_check(v_ticks(spark, sf), "price", "price_l1", ["grp"], ["t", "id"])
    return c.select("n", *[rnd(x).alias(x) for x in c.columns if x != "n"])


# A22 -------------------------------------------------------------------------
def _ac_sql(part: str, order: str):
    parts = [f"SELECT {k} AS k, target AS x, lead(target, {k}) OVER (PARTITION BY {part} ORDER BY {order}) AS v FROM v_ticks"
             if part else
             f"SELECT {k} AS k, target AS x, lead(target, {k}) OVER (ORDER BY {order}) AS v FROM v_ticks" for k in range(1, 10)]
    return "ac AS (" + "\nUNION ALL\n".join(parts) + ")"


_AC_SELECT = f"""
SELECT CAST(k AS INTEGER) AS k, CAST(COUNT(*) AS BIGINT) AS n, {S.rf('pow(' + S.corr('x', 'v') + ', 2)')} AS corr2
FROM ac WHERE x IS NOT NULL AND v IS NOT NULL GROUP BY k"""


@register("autocorr", with_views("v_ticks", extra=[_ac_sql("grp", "t, id")]) + _AC_SELECT)
def autocorr(spark, sf):
    """Squared serial correlation of the target at shifts 1..9 inside each group."""
    a = W.autocorr(v_ticks(spark, sf), "target", ["grp"], ["t", "id"], range(1, 10))
    return a.select("k", "n", rndf("corr2").alias("corr2"))


@register("autocorr_by_id", with_views("v_ticks", extra=[_ac_sql("", "id")]) + _AC_SELECT)
def autocorr_by_id(spark, sf):
    """A22 (cross-group): serial correlation along the global ID order (blocked plan, no single task)."""
    a = W.autocorr(v_ticks(spark, sf), "target", None, ["id"], range(1, 10))
    return a.select("k", "n", rndf("corr2").alias("corr2"))


# W6-W8 -----------------------------------------------------------------------
@register("smooth3_group", with_views("v_ticks") + f"""
SELECT id, {S.r('price * 0.85 + COALESCE(lag(price, 1) OVER w, price) * 0.075 + COALESCE(lead(price, 1) OVER w, price) * 0.075')} AS price_smooth
FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id)""")
def smooth3_group(spark, sf):
    """3-tap .85/.075/.075 smoothing per group, edges fall back to self."""
    s = W.smooth(v_ticks(spark, sf), "price", W.SMOOTH3_GROUP, group=["grp"], order=["t", "id"])
    return s.select("id", rnd("price_smooth").alias("price_smooth"))


def _smooth_global_sql(weights: dict, col: str = "p1"):
    terms = []
    for k, w in sorted(weights.items()):
        if k == 0:
            terms.append(f"{col} * {w!r}")
        elif k < 0:
            terms.append(f"COALESCE(lag({col}, {-k}) OVER w, {col}) * {w!r}")
        else:
            terms.append(f"COALESCE(lead({col}, {k}) OVER w, {col}) * {w!r}")
    return (f"SELECT id, {S.r(' + '.join(terms))} AS {col}_smooth FROM v_preds WINDOW w AS (ORDER BY id)")


@register("smooth3_global", with_views("v_preds") + _smooth_global_sql(W.SMOOTH3_GLOBAL))
def smooth3_global(spark, sf):
    """3-tap .90/.05/.05 smoothing along the whole table (blocked dense index, halo of 1)."""
    s = W.smooth(v_preds(spark, sf), "p1", W.SMOOTH3_GLOBAL, group=None, order=["id"])
    return s.select("id", rnd("p1_smooth").alias("p1_smooth"))


@register("smooth5", with_views("v_preds") + _smooth_global_sql(W.SMOOTH5))
def smooth5(spark, sf):
    """5-tap .90/.04/.04/.01/.01 smoothing along the whole table."""
    s = W.smooth(v_preds(spark, sf), "p1", W.SMOOTH5, group=None, order=["id"])
    return s.select("id", rnd("p1_smooth").alias("p1_smooth"))


# W9, W10 ---------------------------------------------------------------------
_FILL_CTE = """h AS (SELECT id, grp, t, CASE WHEN is_test = 1 THEN NULL ELSE target END AS y FROM v_ticks),
f AS (SELECT id, last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_ffill,
             first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y_bfill
      FROM h)"""


@register("fill_interp", with_views("v_ticks", extra=[_FILL_CTE]) + f"""
SELECT id, {S.r('y_ffill')} AS y_ffill, {S.r('y_bfill')} AS y_bfill, {S.r('(y_ffill + y_bfill) / 2.0')} AS y_interp FROM f""")
def fill_interp(spark, sf):
    """forward/backward fill of the target (test rows hidden) and their midpoint."""
    t = v_ticks(spark, sf).withColumn("y", F.when(F.col("is_test") == 1, F.lit(None).cast("double")).otherwise(F.col("target")))
    f = W.fill_interp(t, "y", ["grp"], ["t", "id"])
    return f.select("id", rnd("y_ffill").alias("y_ffill"), rnd("y_bfill").alias("y_bfill"), rnd("y_interp").alias("y_interp"))


@register("interp_backtest", with_views("v_ticks", extra=[
    f"""h AS (SELECT id, grp, t, target, CASE WHEN is_test = 0 AND {h01()} < 0.2 THEN 1 ELSE 0 END AS hidden,
                  CASE WHEN is_test = 1 OR (is_test = 0 AND {h01()} < 0.2) THEN NULL ELSE target END AS y FROM v_ticks)""",
    """f AS (SELECT target, hidden, (last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  + first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 2.0 AS interp
             FROM h)"""]) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n, {S.rf('pow(' + S.corr('target', 'interp') + ', 2)')} AS r2
FROM f WHERE hidden = 1 AND interp IS NOT NULL AND target IS NOT NULL""")
def interp_backtest(spark, sf):
    """Hide 20 % of train targets (partition-independent hash), fill, squared correlation."""
    t = v_ticks(spark, sf)
    hidden = (F.col("is_test") == 0) & (hash01("id") < 0.2)
    t = t.withColumn("hidden", hidden).withColumn(
        "y", F.when((F.col("is_test") == 1) | hidden, F.lit(None).cast("double")).otherwise(F.col("target")))
    f = W.fill_interp(t, "y", ["grp"], ["t", "id"])
    ev = f.filter(F.col("hidden") & F.col("y_interp").isNotNull() & F.col("target").isNotNull())
    return ev.agg(F.count(F.lit(1)).alias("n"), rndf(F.pow(safe_corr("target", "y_interp"), 2)).alias("r2"))


# W11-W13 ---------------------------------------------------------------------
@register("rank_avg", with_views("v_ticks") + """
SELECT id, CAST(rank() OVER (ORDER BY s2) + (COUNT(*) OVER (PARTITION BY s2) - 1) / 2.0 AS DOUBLE) AS rank_avg
FROM v_ticks WHERE s2 IS NOT NULL""")
def rank_avg(spark, sf):
    """Average-tie rank over the whole table (no single-task window)."""
    t = v_ticks(spark, sf).filter(F.col("s2").isNotNull()).select("id", "s2")
    return W.rank_avg(t, "s2").select("id", "rank_avg")


_RANK_N = "n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM v_preds)"
_SORTED_Y = "sy AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM v_preds)"


@register("rank_map_index", with_views("v_preds", extra=[
    "r AS (SELECT id, rank() OVER (ORDER BY p2) + (COUNT(*) OVER (PARTITION BY p2) - 1) / 2.0 AS ra FROM v_preds)",
    _RANK_N, _SORTED_Y]) + f"""
SELECT r.id, {S.rf('sy.y')} AS mapped FROM r CROSS JOIN n
JOIN sy ON sy.i = least(greatest(CAST(floor((r.ra - 1.0) / (n.n - 1.0) * (n.n - 1.0)) AS BIGINT), 0), CAST(n.n AS BIGINT) - 1)""")
def rank_map_index(spark, sf):
    """W13 (index mode): average rank of the prediction -> value of the sorted target at that index."""
    p = v_preds(spark, sf)
    m = W.rank_map_index(p.select("id", "p2"), "p2", p, "y")
    return m.select("id", rndf("mapped").alias("mapped"))


@register("rank_map_quantile", with_views("v_preds", extra=[
    "r AS (SELECT id, (row_number() OVER (ORDER BY p2, id) - 1) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) AS p FROM v_preds)",
    _RANK_N, _SORTED_Y]) + f"""
, q AS (SELECT r.id, r.p * (n.n - 1.0) AS h FROM r CROSS JOIN n)
SELECT q.id, {S.rf('lo.y + (q.h - floor(q.h)) * (hi.y - lo.y)')} AS mapped
FROM q JOIN sy lo ON lo.i = CAST(floor(q.h) AS BIGINT) JOIN sy hi ON hi.i = CAST(ceil(q.h) AS BIGINT)""")
def rank_map_quantile(spark, sf):
    """W12 + W13 (quantile mode): ordinal rank / n -> interpolated quantile of the target."""
    p = v_preds(spark, sf)
    m = W.rank_map_quantile(p.select("id", "p2"), "p2", "id", p, "y")
    return m.select("id", rndf("mapped").alias("mapped"))


_KP = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _knots_sql():
    kq = ", ".join(f"quantile_cont(y, {p!r}) AS k{i}" for i, p in enumerate(_KP))
    e = f"CASE WHEN p <= {_KP[0]!r} THEN lo + p * ((k0 - lo) / {_KP[0]!r}) "
    e += f"WHEN p >= {_KP[-1]!r} THEN k{len(_KP) - 1} + (p - {_KP[-1]!r}) * ((hi - k{len(_KP) - 1}) / {1.0 - _KP[-1]!r}) "
    for j in range(len(_KP) - 1):
        a, b = _KP[j], _KP[j + 1]
        e += f"WHEN p >= {a!r} AND p <= {b!r} THEN k{j} + (p - {a!r}) / {b - a!r} * (k{j + 1} - k{j}) "
    e += "END"
    return (with_views("v_preds", extra=[
        f"kn AS (SELECT {kq}, MIN(y) AS lo, MAX(y) AS hi FROM v_preds)",
        "r AS (SELECT id, (row_number() OVER (ORDER BY p2, id) - 1) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) AS p FROM v_preds)"])
        + f"SELECT id, {S.rf(e)} AS mapped FROM r CROSS JOIN kn")


@register("rank_map_knots", _knots_sql())
def rank_map_knots(spark, sf):
    """W13 (knots mode): rank -> 7 quantile knots of the target, tails to min/max."""
    p = v_preds(spark, sf)
    m = W.rank_map_knots(p.select("id", "p2"), "p2", "id", p, "y", _KP)
    return m.select("id", rndf("mapped").alias("mapped"))


# W2 (two-sided shift sweep) --------------------------------------------------
_SW_COLS = ["price", "price_l1", "price_l2", "price_l3"]
_SW_SHIFTS = [s for s in range(-3, 4)]


def _sw_specs():
    """(column, shift, kind) triples: raw shifted value; for price also diff and ratio to |price|."""
    out = []
    for c_ in _SW_COLS:
        for s in _SW_SHIFTS:
            if s == 0 and c_ == "price":
                continue
            out.append((c_, s, "raw"))
            if c_ == "price":
                out += [(c_, s, "diff"), (c_, s, "ratio")]
    return out


def _sw_sql():
    parts = []
    for c_, s, kind in _sw_specs():
        v = c_ if s == 0 else (f"lead({c_}, {s}) OVER w" if s > 0 else f"lag({c_}, {-s}) OVER w")
        e = {"raw": v, "diff": f"({v}) - price",
             "ratio": f"CASE WHEN price = 0 THEN NULL ELSE (({v}) - price) / ABS(price) END"}[kind]
        parts.append(f"SELECT '{c_}' AS col, {s} AS shift, '{kind}' AS kind, target AS y, ({v}) AS sv, {e} AS v, is_test "
                     f"FROM v_ticks WINDOW w AS (PARTITION BY grp ORDER BY t, id)")
    return "sw2 AS (" + "\nUNION ALL\n".join(parts) + ")"


@register("shift_sweep", with_views("v_ticks", extra=[_sw_sql()]) + f"""
SELECT col, CAST(shift AS INTEGER) AS shift, kind, CAST(COUNT(*) AS BIGINT) AS n, {S.rf(S.corr('v', 'y'))} AS corr
FROM sw2 WHERE is_test = 0 AND y IS NOT NULL AND sv IS NOT NULL AND v IS NOT NULL GROUP BY col, shift, kind""")
def shift_sweep(spark, sf):
    """W2 (two-sided): four price columns shifted by -3..3 within the group (one skew-checked pass),
    each raw / difference / ratio series correlated with the target on train rows."""
    t = v_ticks(spark, sf)
    s = shift(t, ["grp"], ["t", "id"], lags={c_: [1, 2, 3] for c_ in _SW_COLS}, leads={c_: [1, 2, 3] for c_ in _SW_COLS})
    p = F.col("price")
    structs = []
    for c_, sh, kind in _sw_specs():
        sv = F.col(c_) if sh == 0 else F.col(f"{c_}_lead{sh}" if sh > 0 else f"{c_}_lag{-sh}")
        v = {"raw": sv, "diff": sv - p, "ratio": F.try_divide(sv - p, F.abs(p))}[kind]
        structs.append(F.struct(F.lit(c_).alias("col"), F.lit(sh).alias("shift"), F.lit(kind).alias("kind"),
                                sv.alias("sv"), v.alias("v")))
    long = s.filter("is_test = 0").select(F.col("target").alias("y"), F.explode(F.array(*structs)).alias("e")).select(
        "y", "e.col", "e.shift", "e.kind", "e.sv", "e.v")
    ok = F.col("y").isNotNull() & F.col("sv").isNotNull() & F.col("v").isNotNull()
    return long.filter(ok).groupBy("col", "shift", "kind").agg(
        F.count(F.lit(1)).alias("n"), rndf(safe_corr("v", "y")).alias("corr"))


def _sweep_global_sql(hs):
    parts = [f"SELECT {h} AS h, target AS y, 100.0 * COALESCE((lead(price, {h}) OVER w - price) / NULLIF(ABS(price) + 1e-10, 0), 0.0) AS ret, "
             f"lead(price, {h}) OVER w - price AS diff, is_test FROM v_ticks WINDOW w AS (ORDER BY id)" for h in hs]
    return "swg AS (" + "\nUNION ALL\n".join(parts) + ")"


@register("horizon_sweep_global", with_views("v_ticks", extra=[_sweep_global_sql(range(1, 20))]) + f"""
SELECT CAST(h AS INTEGER) AS h, CAST(COUNT(*) AS BIGINT) AS n,
       {S.rf('1.0 - SUM(pow(y - ret, 2)) / (var_pop(y) * COUNT(*))')} AS r2_return,
       {S.rf('1.0 - SUM(pow(y - diff, 2)) / (var_pop(y) * COUNT(*))')} AS r2_diff,
       {S.rf(S.corr('ret', 'y'))} AS corr_return
FROM swg WHERE is_test = 0 AND y IS NOT NULL AND diff IS NOT NULL GROUP BY h""")
def horizon_sweep_global(spark, sf):
    """W2 (ungrouped): horizons 1..19 along the global ID order - the blocked dense-index plan, never one task."""
    t = v_ticks(spark, sf)
    sw = W.horizon_sweep(t, "price", "target", None, ["id"], range(1, 20), scale=100.0, mask=F.col("is_test") == 0)
    return sw.select("h", "n", *[rndf(x).alias(x) for x in ["r2_return", "r2_diff", "corr_return"]])
