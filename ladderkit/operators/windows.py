"""Window operators (W1-W13, A22): shifts, sweeps, smoothing, fills, ranks, rank mapping.

Every grouped operator goes through :mod:`ladderkit.operators.sequence`, which
checks the heaviest group and switches from a partitioned window to a blocked
dense-index plan when one group is too large for one task. Global
(unpartitioned) orders always use the blocked plan.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import c, lit_d, nz, safe_corr
from .metrics import r2_col
from .quantiles import quantile_values
from .sequence import _cols, block_size, choose_strategy, dense_index, running_sum, shift


# W6-W8 -------------------------------------------------------------------------
def smooth(df: DataFrame, col: str, weights: dict[int, float], group=None, order=("id",),
           out: str | None = None, strategy: str = "auto") -> DataFrame:
    """Centred k-tap smoothing: ``sum w_k * x[t+k]``; a missing neighbour falls back to ``x[t]``.

    ``weights`` maps offsets (0, -1, +1, -2, +2, ...) to weights; ``group=None``
    smooths along the whole table (blocked plan, never one task).
    """
    lags = sorted(-k for k in weights if k < 0)
    leads = sorted(k for k in weights if k > 0)
    s = shift(df, _cols(group), _cols(order), lags={col: lags} if lags else None,
              leads={col: leads} if leads else None, strategy=strategy)
    terms = []
    for k, w in sorted(weights.items()):
        v = F.col(col) if k == 0 else F.coalesce(F.col(f"{col}_lag{-k}" if k < 0 else f"{col}_lead{k}"), F.col(col))
        terms.append(v * lit_d(w))
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    helper = [f"{col}_lag{k}" for k in lags] + [f"{col}_lead{k}" for k in leads]
    return s.withColumn(out or f"{col}_smooth", expr).drop(*helper)


SMOOTH3_GROUP = {0: 0.85, -1: 0.075, 1: 0.075}
SMOOTH3_GLOBAL = {0: 0.90, -1: 0.05, 1: 0.05}
SMOOTH5 = {0: 0.90, -1: 0.04, 1: 0.04, -2: 0.01, 2: 0.01}


# W9 ----------------------------------------------------------------------------
def fill(df: DataFrame, col: str, group, order, direction: str = "forward", out: str | None = None,
         strategy: str = "auto") -> DataFrame:
    """Forward (``last`` non-null so far) or backward (``first`` non-null ahead) fill within a group."""
    group, order = _cols(group), _cols(order)
    out = out or f"{col}_{'ffill' if direction == 'forward' else 'bfill'}"
    strategy = choose_strategy(df, group, strategy)
    if strategy == "window":
        w = Window.partitionBy(*group).orderBy(*order)
        if direction == "forward":
            e = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        else:
            e = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return df.withColumn(out, e)
    return _blocked_fill(df, col, group, order, direction, out)


def _blocked_fill(df, col, group, order, direction, out):
    """Fill across fixed-size blocks of a dense index: in-block window + a carry per block.

    Groups are contiguous in the index, so the nearest non-null before (after)
    a block belongs to the row's group exactly when the group had one there;
    the carry is therefore valid iff its group equals the row's group.
    """
    spark = df.sparkSession
    cols = df.columns
    ix, total = dense_index(df, group + order)
    size = block_size(spark, total)
    ix = ix.withColumn("_blk", F.floor(F.col("_idx") / F.lit(size)).cast("long"))
    gkey = F.struct(*[F.col(g) for g in group]) if group else F.lit(0)
    nn = ix.filter(F.col(col).isNotNull())
    pick = F.max_by if direction == "forward" else F.min_by
    edge = nn.groupBy("_blk").agg(pick(F.struct(gkey.alias("g"), F.col(col).alias("v")), F.col("_idx")).alias("e"))
    edges = sorted(((r["_blk"], r["e"]) for r in edge.collect()), key=lambda t: t[0])  # one row per block
    carries, last = [], None
    blocks = sorted({b for b, _ in edges} | set(range(0, (total + size - 1) // size)))
    by_blk = dict(edges)
    for b in (blocks if direction == "forward" else list(reversed(blocks))):
        carries.append((b, last))
        if b in by_blk:
            last = by_blk[b]
    gtype = ix.select(gkey.alias("g")).schema["g"].dataType.simpleString()
    vtype = ix.schema[col].dataType.simpleString()
    carry_df = spark.createDataFrame(
        [(b, (e["g"] if e else None), (e["v"] if e else None)) for b, e in carries],
        f"_blk long, _cg {gtype}, _cv {vtype}")
    w = Window.partitionBy("_blk", *group).orderBy("_idx")
    inblock = (F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
               if direction == "forward" else
               F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    res = (ix.join(F.broadcast(carry_df), "_blk")
           .withColumn(out, F.coalesce(inblock, F.when(F.col("_cg").eqNullSafe(gkey), F.col("_cv")))))
    return res.select(*cols, out)


def fill_interp(df: DataFrame, col: str, group, order, strategy: str = "auto") -> DataFrame:
    """Forward fill, backward fill and their midpoint (the plan is chosen once for both fills)."""
    strategy = choose_strategy(df, _cols(group), strategy)
    f = fill(df, col, group, order, "forward", strategy=strategy)
    b = fill(f, col, group, order, "backward", strategy=strategy)
    return b.withColumn(f"{col}_interp", (F.col(f"{col}_ffill") + F.col(f"{col}_bfill")) / lit_d(2.0))


# W2, W3 ------------------------------------------------------------------------
def horizon_sweep(df: DataFrame, price: str, target: str, group, order, horizons: Sequence[int],
                  scale: float = 1.0, eps: float = 1e-10, mask: Column | None = None) -> DataFrame:
    """Forward returns over many horizons in one window pass, each scored against the target.

    Returns ``(h, n, r2_return, r2_diff, corr_return)`` - R^2 of the standard
    return ``scale * (p[t+h] - p[t]) / (|p[t]| + eps)`` and of the plain
    difference; ``best_horizon`` picks the winner.
    """
    hs = list(horizons)
    s = shift(df, group, order, leads={price: hs})
    if mask is not None:
        s = s.filter(mask)
    p = F.col(price)
    ret_cols, diff_cols = [], []
    for h in hs:
        fp = F.col(f"{price}_lead{h}")
        ret_cols.append(lit_d(scale) * nz(fp - p, F.abs(p) + lit_d(eps)))
        diff_cols.append(fp - p)
    long = s.select(F.col(target).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), r.alias("ret"), d.alias("diff"))
        for h, r, d in zip(hs, ret_cols, diff_cols)])).alias("e")).select("_y", "e.h", "e.ret", "e.diff")
    ok = F.col("_y").isNotNull() & F.col("diff").isNotNull()  # a future price exists
    lv = long.filter(ok)
    return lv.groupBy("h").agg(F.count(F.lit(1)).alias("n"), r2_col("_y", "ret").alias("r2_return"),
                               r2_col("_y", "diff").alias("r2_diff"), safe_corr("ret", "_y").alias("corr_return"))


def best_horizon(sweep: DataFrame, score: str = "r2_return") -> DataFrame:
    """O6 over a sweep: the horizon with the best score (ties -> smallest h)."""
    return sweep.orderBy(F.col(score).desc(), F.col("h").asc()).limit(1)


def forward_block(df: DataFrame, price: str, group, order, n: int, eps: float = 1e-8) -> DataFrame:
    """The next ``n`` prices as ratios ``(p[t+i] - p[t]) / (|p[t]| + eps)`` (one sort)."""
    s = shift(df, group, order, leads={price: list(range(1, n + 1))})
    p = F.col(price)
    out = s
    for i in range(1, n + 1):
        out = out.withColumn(f"fwd_{i}", nz(F.col(f"{price}_lead{i}") - p, F.abs(p) + lit_d(eps)))
    return out.drop(*[f"{price}_lead{i}" for i in range(1, n + 1)])


# W4, W5 ------------------------------------------------------------------------
def gap_stats(df: DataFrame, id_col: str, group) -> DataFrame:
    """Gap to the next ID within the group: min/max/mean/median and shares ==1 / >1."""
    s = shift(df.select(*_cols(group), id_col), group, [id_col], leads={id_col: [1]})
    g = s.select((F.col(f"{id_col}_lead1") - F.col(id_col)).alias("gap")).filter(F.col("gap").isNotNull())
    med = quantile_values(g, "gap", [0.5])[0]
    return g.agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"),
                 F.lit(med).cast("double").alias("median_gap"),
                 F.avg(F.when(F.col("gap") == 1, lit_d(1.0)).otherwise(lit_d(0.0))).alias("share_eq1"),
                 F.avg(F.when(F.col("gap") > 1, lit_d(1.0)).otherwise(lit_d(0.0))).alias("share_gt1"),
                 F.count(F.lit(1)).alias("n"))


def chain_check(df: DataFrame, price: str, lag1: str, group, order, tols=(1e-4, 1e-6)) -> DataFrame:
    """Does the current price equal the next row's prior level (``p' - lag1'``) / raw lag column?"""
    s = shift(df, group, order, leads={price: [1], lag1: [1]})
    prior = F.col(f"{price}_lead1") - F.col(f"{lag1}_lead1")
    raw = F.col(f"{lag1}_lead1")
    ok = prior.isNotNull()
    aggs = [F.count(F.when(ok, 1)).alias("n")]
    for t in tols:
        tag = f"{t:g}".replace("-", "m").replace(".", "p")
        aggs.append(F.avg(F.when(ok, F.when(F.abs(F.col(price) - prior) < t, 1.0).otherwise(0.0))).alias(f"rate_prior_{tag}"))
        aggs.append(F.avg(F.when(ok, F.when(F.abs(F.col(price) - raw) < t, 1.0).otherwise(0.0))).alias(f"rate_raw_{tag}"))
    return s.agg(*aggs)


# A22 ---------------------------------------------------------------------------
def autocorr(df: DataFrame, col: str, group, order, lags: Sequence[int]) -> DataFrame:
    """Squared correlation of ``x[t]`` with ``x[t+k]`` (pairs inside the group, or the table)."""
    ks = list(lags)
    s = shift(df, group, order, leads={col: ks})
    long = s.select(F.col(col).alias("_x"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"{col}_lead{k}").alias("v")) for k in ks])).alias("e")).select("_x", "e.k", "e.v")
    lv = long.filter(F.col("_x").isNotNull() & F.col("v").isNotNull())
    return lv.groupBy("k").agg(F.count(F.lit(1)).alias("n"), safe_corr("_x", "v").alias("corr")).withColumn(
        "corr2", F.col("corr") * F.col("corr"))


# W11-W13 -----------------------------------------------------------------------
def rank_avg(df: DataFrame, col: str, out: str = "rank_avg") -> DataFrame:
    """1-based average-tie rank (scipy ``rankdata``) without a single-task window.

    Equal values are counted first; the running sum of the counts gives each distinct value
    its positions and so the tie average; joined back on the value (AQE splits a hot value
    on the big side).
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    ties = running_sum(counts, [col], ["_n"]).select(
        col, (F.col("_n_cum") - (F.col("_n") - 1) / lit_d(2.0)).alias(out))
    return df.join(ties, col, "left")


def rank_ordinal(df: DataFrame, col: str, id_col: str, out: str = "rank_frac") -> DataFrame:
    """Ordinal rank 0..n-1 (ties by id) divided by n."""
    ix, total = dense_index(df, [col, id_col])
    return ix.withColumn(out, F.col("_idx") / F.lit(float(total))).withColumnRenamed("_idx", "rank0")


def rank_map_index(df: DataFrame, col: str, ref: DataFrame, ref_col: str, out: str = "mapped") -> DataFrame:
    """W13 (index mode): average rank -> index ``int((r-1)/(n-1)*(m-1))`` into the sorted reference."""
    r = rank_avg(df, col, "_r")
    n = df.filter(F.col(col).isNotNull()).count()
    sref, m = dense_index(ref.select(ref_col).filter(F.col(ref_col).isNotNull()), [ref_col])
    idx = F.floor((F.col("_r") - 1.0) / F.lit(float(max(n - 1, 1))) * F.lit(float(m - 1))).cast("long")
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(m - 1))
    j = r.withColumn("_ri", idx).join(sref.select(F.col("_idx").alias("_ri"), F.col(ref_col).alias(out)), "_ri", "left")
    return j.drop("_r", "_ri")


def rank_map_quantile(df: DataFrame, col: str, id_col: str, ref: DataFrame, ref_col: str,
                      out: str = "mapped") -> DataFrame:
    """W13 (quantile mode): ordinal rank / n -> linear-interpolated quantile of the reference."""
    r = rank_ordinal(df, col, id_col, "_p")
    sref, m = dense_index(ref.select(ref_col).filter(F.col(ref_col).isNotNull()), [ref_col])
    h = F.col("_p") * F.lit(float(m - 1))
    r = r.withColumn("_lo", F.floor(h).cast("long")).withColumn("_hi", F.ceil(h).cast("long")).withColumn(
        "_fr", h - F.floor(h))
    lo = sref.select(F.col("_idx").alias("_lo"), F.col(ref_col).alias("_xl"))
    hi = sref.select(F.col("_idx").alias("_hi"), F.col(ref_col).alias("_xh"))
    j = r.join(lo, "_lo", "left").join(hi, "_hi", "left")
    return j.withColumn(out, F.col("_xl") + F.col("_fr") * (F.col("_xh") - F.col("_xl"))).drop(
        "_p", "_lo", "_hi", "_fr", "_xl", "_xh", "rank0")


def knot_map_expr(rank: Column, knots_p: Sequence[float], knots_v: Sequence[float], vmin: float, vmax: float) -> Column:
    """W13 (knots mode): piecewise-linear map of a rank in [0,1] through quantile knots, tails to min/max."""
    p0, pl = knots_p[0], knots_p[-1]
    e = F.when(rank <= p0, lit_d(vmin) + rank * lit_d((knots_v[0] - vmin) / p0))
    e = e.when(rank >= pl, lit_d(knots_v[-1]) + (rank - lit_d(pl)) * lit_d((vmax - knots_v[-1]) / (1.0 - pl)))
    for j in range(len(knots_p) - 1):
        a, b = knots_p[j], knots_p[j + 1]
        e = e.when((rank >= a) & (rank <= b),
                   lit_d(knots_v[j]) + (rank - lit_d(a)) / lit_d(b - a) * lit_d(knots_v[j + 1] - knots_v[j]))
    return e


def rank_map_knots(df: DataFrame, col: str, id_col: str, ref: DataFrame, ref_col: str,
                   knots_p: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), out: str = "mapped") -> DataFrame:
    """W13 (knots mode) with knots computed from the reference (exact quantiles, literals)."""
    kv = quantile_values(ref, ref_col, knots_p)
    mm = ref.agg(F.min(ref_col).alias("lo"), F.max(ref_col).alias("hi")).first()
    r = rank_ordinal(df, col, id_col, "_p")
    return r.withColumn(out, knot_map_expr(F.col("_p"), knots_p, kv, mm["lo"], mm["hi"])).drop("_p", "rank0")
