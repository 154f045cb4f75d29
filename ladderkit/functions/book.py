"""Order-book feature expressions (E1-E29) as Column builders.

All of these are narrow projections: one ``select`` evaluates hundreds of them
inside whole-stage codegen, with no shuffle. Column families are passed by
name so the same code serves any ladder width or naming scheme.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import EPS, c, clean, clip, lit_d, nz, row_sum

# ------------------------------------------------------------ two-sided


def side_spread(s1, s2) -> Column:
    """``s1 - s2``."""
    return c(s1) - c(s2)


def side_mid(s1, s2) -> Column:
    """``(s1 + s2) / 2``."""
    return (c(s1) + c(s2)) / lit_d(2.0)


def side_imbalance(s1, s2, eps: float = EPS) -> Column:
    """``(s1 - s2) / (|s1| + |s2| + eps)``."""
    return nz(c(s1) - c(s2), F.abs(c(s1)) + F.abs(c(s2)) + lit_d(eps))


def side_share(s1, s2, eps: float = EPS) -> Column:
    """``s1 / (s1 + s2 + eps)``; 0 where the denominator is exactly 0."""
    return nz(c(s1), c(s1) + c(s2) + lit_d(eps))


def side_logratio(s1, s2, eps: float = EPS) -> Column:
    """E5: ``ln((|s1| + eps) / (|s2| + eps))``."""
    return F.ln((F.abs(c(s1)) + lit_d(eps)) / (F.abs(c(s2)) + lit_d(eps)))


def side_features(pairs: dict[str, tuple[str, str]]) -> list[Column]:
    """E1-E5 for each ``suffix -> (side1_col, side2_col)``."""
    out = []
    for sfx, (a, b) in pairs.items():
        out += [side_spread(a, b).alias(f"spread_{sfx}"), side_mid(a, b).alias(f"mid_{sfx}"),
                side_imbalance(a, b).alias(f"imbalance_{sfx}"), side_share(a, b).alias(f"share_{sfx}"),
                side_logratio(a, b).alias(f"logratio_{sfx}")]
    return out


def side_lag_features(pairs: dict[str, tuple[str, str]], lags: Sequence[str]) -> list[Column]:
    """Spread and imbalance of each lag column pair ``(s1+lag, s2+lag)``."""
    out = []
    for lag in lags:
        for sfx, (a, b) in pairs.items():
            out += [side_spread(a + lag, b + lag).alias(f"spread_{sfx}{lag}"),
                    side_imbalance(a + lag, b + lag).alias(f"imbalance_{sfx}{lag}")]
    return out


def spread_change(s1, s2, lag: str = "_LagT1") -> Column:
    """``spread - spread_lag`` with ``spread_lag = s1_lag - s2_lag``."""
    return side_spread(s1, s2) - side_spread(s1 + lag, s2 + lag)


# ------------------------------------------------------------ ladder


def book_total(levels: Sequence[str]) -> Column:
    """Total depth over the ladder levels of one side."""
    return row_sum(levels)


def book_imbalance(bid_levels: Sequence[str], ask_levels: Sequence[str], eps: float = EPS) -> Column:
    """``(V - A) / (V + A + eps)`` of the side totals."""
    v, a = book_total(bid_levels), book_total(ask_levels)
    return nz(v - a, v + a + lit_d(eps))


def book_imbalance_sq(bid_levels, ask_levels, eps: float = EPS) -> Column:
    """E9 squared variant."""
    return F.pow(book_imbalance(bid_levels, ask_levels, eps), lit_d(2.0))


def proximity_weights(n: int) -> list[float]:
    """Level weights ``(n - i) / sum`` for i = 0..n-1 (nearest level heaviest)."""
    raw = [float(n - i) for i in range(n)]
    s = sum(raw)
    return [r / s for r in raw]


def weighted_total(levels: Sequence[str]) -> Column:
    w = proximity_weights(len(levels))
    return row_sum([c(x) * lit_d(wi) for x, wi in zip(levels, w)])


def book_imbalance_weighted(bid_levels, ask_levels, eps: float = EPS) -> Column:
    """Proximity-weighted imbalance."""
    n = min(len(bid_levels), len(ask_levels))
    v, a = weighted_total(bid_levels[:n]), weighted_total(ask_levels[:n])
    return nz(v - a, v + a + lit_d(eps))


def level_imbalance(bid_levels, ask_levels, k: int | None = None, eps: float = EPS) -> list[Column]:
    """Per-level ``(v_i - a_i) / (|v_i| + |a_i| + eps)`` for the first ``k`` levels."""
    n = min(len(bid_levels), len(ask_levels)) if k is None else k
    return [side_imbalance(bid_levels[i], ask_levels[i], eps).alias(f"level_{i}_imbalance") for i in range(n)]


def depth_gradient(levels: Sequence[str]) -> Column:
    """Last level minus first level."""
    return c(levels[-1]) - c(levels[0])


def ofi(bid_levels, ask_levels, lag: str, eps: float = EPS) -> tuple[Column, Column]:
    """Order-flow imbalance ``sum(v_lag) - sum(a_lag)`` and its normalised form."""
    v = row_sum([x + lag for x in bid_levels])
    a = row_sum([x + lag for x in ask_levels])
    return v - a, nz(v - a, F.abs(v) + F.abs(a) + lit_d(eps))


# ------------------------------------------------------------ price


def lag_return(lag_col, price_col, eps: float = EPS, use_abs: bool = False) -> Column:
    """``lag / (price + eps)`` (or over ``|price| + eps``)."""
    den = (F.abs(c(price_col)) if use_abs else c(price_col)) + lit_d(eps)
    return nz(c(lag_col), den)


def momentum(lags: Sequence[str]) -> Column:
    """Sum of lag differences."""
    return row_sum(lags)


def acceleration(l1, l2) -> Column:
    """``l1 - l2``."""
    return c(l1) - c(l2)


def jerk(l1, l2, l3) -> Column:
    """``(l1 - l2) - (l2 - l3)``."""
    return (c(l1) - c(l2)) - (c(l2) - c(l3))


def vol_proxy(lags: Sequence[str]) -> Column:
    """``sum |lag|``."""
    return row_sum([F.abs(c(x)) for x in lags])


def self_change(col: str, lag: str = "_LagT1") -> Column:
    """``x - x_lag``."""
    return c(col) - c(col + lag)


def interaction(a, b) -> Column:
    """Product of two covariates."""
    return c(a) * c(b)


def pair_features(a: str, b: str, eps: float = EPS) -> list[Column]:
    """Product, ratio over ``|b| + eps``, difference and sum of a pair."""
    return [(c(a) * c(b)).alias(f"{a}_x_{b}"), nz(c(a), F.abs(c(b)) + lit_d(eps)).alias(f"{a}_ratio_{b}"),
            (c(a) - c(b)).alias(f"{a}_diff_{b}"), (c(a) + c(b)).alias(f"{a}_sum_{b}")]


def poly_inv(col: str, eps: float = EPS) -> list[Column]:
    """Square and inverse ``1 / (x + eps)``."""
    return [F.pow(c(col), lit_d(2.0)).alias(f"{col}_sq"), nz(lit_d(1.0), c(col) + lit_d(eps)).alias(f"{col}_inv")]


def row_stats(cols: Sequence[str]) -> tuple[Column, Column]:
    """Row-wise NaN/NULL-skipping mean and population std over a column family."""
    arr = F.filter(F.array(*[c(x).cast("double") for x in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(arr).cast("double")
    s = F.aggregate(arr, lit_d(0.0), lambda acc, v: acc + v)
    mean = F.try_divide(s, n)
    ss = F.aggregate(arr, lit_d(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return mean, F.sqrt(F.try_divide(ss, n))


def lag_family_stats(cols: Sequence[str], n_total: int | None = None) -> tuple[Column, Column]:
    """Two-moment mean/std dividing by the full list length even if columns are absent.

    ``mean = sum / L``, ``std = sqrt(max(sumsq / L - mean^2, 0))`` with L = ``n_total`` or len(cols).
    """
    L = float(max(n_total or len(cols), 1))
    if not cols:
        return lit_d(0.0), lit_d(0.0)
    s = row_sum(cols)
    sq = row_sum([c(x) * c(x) for x in cols])
    m = s / lit_d(L)
    return m, F.sqrt(F.greatest(sq / lit_d(L) - m * m, lit_d(0.0)))


def lag_family_dynamics(m1, m2, m3, s1, s2, eps: float = EPS) -> list[Column]:
    """Acceleration, jerk, ``t1 / (|t2| + eps)`` and the std ratio of lag-family stats."""
    accel = c(m1) - c(m2)
    return [accel.alias("lag_accel"), (accel - (c(m2) - c(m3))).alias("lag_jerk"),
            nz(c(m1), F.abs(c(m2)) + lit_d(eps)).alias("lag_t1_t2_ratio"),
            nz(c(s1), c(s2) + lit_d(eps)).alias("lag_momentum_consistency")]


def prior_level(col: str, lag_col: str) -> Column:
    """Reconstruct a prior level ``x - x_LagTk``."""
    return c(col) - c(lag_col)


def oscillators(cols: Sequence[str], n: int, eps: float = 1e-8, bound: float = 100.0) -> list[Column]:
    """``c[2i] / (c[2i+1] + eps)`` for i < n; NaN -> 0, +-inf -> +-bound, clipped to +-bound."""
    out = []
    for i in range(n):
        a, b = cols[2 * i], cols[2 * i + 1]
        ratio = F.try_divide(c(a), c(b) + lit_d(eps))
        # a zero denominator gives +-inf (or NaN for 0/0) in the reference
        inf_like = F.when(c(a) > 0, lit_d(bound)).when(c(a) < 0, lit_d(-bound)).otherwise(lit_d(0.0))
        v = F.when(ratio.isNull() & c(a).isNotNull() & c(b).isNotNull(), inf_like).otherwise(
            clean(ratio, nan=0.0, pos=bound, neg=-bound))
        out.append(clip(v, -bound, bound).alias(f"osc_{i}"))
    return out


def top_k_pairs(names_ascending: Sequence[str], reach: int = 4) -> list[tuple[str, str]]:
    """E27 pair plan: each feature with the next ``reach`` in ascending-|corr| order."""
    n = len(names_ascending)
    return [(names_ascending[i], names_ascending[j])
            for i in range(n) for j in range(i + 1, min(i + reach + 1, n))]


def diff_grid(a_cols: Sequence[str], b_cols: Sequence[str]) -> list[Column]:
    """Every ``a - b`` difference column."""
    return [(c(a) - c(b)).alias(f"{a}_minus_{b}") for a in a_cols for b in b_cols]
