"""Scalar Column helpers shared by every operator (all JVM-side, codegen friendly).

ANSI mode stays on: division goes through ``try_divide`` so a zero denominator
yields NULL (then 0 where the reference maps non-finite values to 0) instead of
raising.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guard constant the reference adds to denominators and logs.
EPS = 1e-10


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_d(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def sdiv(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(c(a), c(b))


def nz(a, b) -> Column:
    """a / b with 0.0 for a zero/NULL denominator: ``coalesce(try_divide(a, b), 0)``."""
    return F.coalesce(F.try_divide(c(a), c(b)), lit_d(0.0))


def is_finite(x) -> Column:
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(x) -> Column:
    x = c(x)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def clean(x, nan: float = 0.0, pos: float = 0.0, neg: float = 0.0, null: float | None = None) -> Column:
    """Replace NaN / +inf / -inf (and optionally NULL) by constants."""
    x = c(x).cast("double")
    out = (F.when(F.isnan(x), lit_d(nan))
           .when(x == F.lit(float("inf")), lit_d(pos))
           .when(x == F.lit(float("-inf")), lit_d(neg))
           .otherwise(x))
    if null is not None:
        out = F.coalesce(out, lit_d(null))
    return out


def clip(x, lo=None, hi=None) -> Column:
    out = c(x)
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else lit_d(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else lit_d(hi))
    return out


def safe_den(x, mode: str = "abs", eps: float = EPS) -> Column:
    """Denominator guards: ``abs`` -> |x|+eps, ``zero`` -> eps where x==0, ``floor`` -> max(x, eps)."""
    x = c(x)
    if mode == "abs":
        return F.abs(x) + lit_d(eps)
    if mode == "zero":
        return F.when(x == 0, lit_d(eps)).otherwise(x)
    if mode == "floor":
        return F.greatest(x, lit_d(eps))
    raise ValueError(mode)


def key(x, decimals: int) -> Column:
    """Rounded long join key: half-even ``rint(x * 10^d)``; NULL for NaN/inf/NULL."""
    x = c(x)
    scaled = F.rint(x * F.lit(float(10 ** decimals)))
    return F.when(is_finite(x), scaled.cast("long"))


def where(cond, a, b) -> Column:
    return F.when(cond, a).otherwise(b)


def hash01(id_col, seed: int = 42) -> Column:
    """Partition-independent uniform [0,1) from md5(seed:id); same value in DuckDB.

    DuckDB: ``CAST(('0x' || substr(md5('42:' || id), 1, 8)) AS UBIGINT) / 4294967296.0``.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c(id_col).cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def hash_u32(id_col, seed: int = 42) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c(id_col).cast("string"))), 1, 8), 16, 10)
    return h.cast("long")


def rnd(x, d: int = 6) -> Column:
    """Round for result comparison (``+ 0.0`` turns -0.0 into 0.0)."""
    return F.round(c(x).cast("double"), d) + lit_d(0.0)


def rndf(x, d: int = 6) -> Column:
    """Round through float32 first: 7 significant digits, robust for values of any magnitude."""
    return F.round(c(x).cast("float").cast("double"), d) + lit_d(0.0)


def safe_corr(x, y) -> Column:
    """Population Pearson correlation as an aggregate; 0.0 for a constant column."""
    x, y = c(x), c(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), lit_d(0.0))


def row_sum(cols: Iterable) -> Column:
    return reduce(lambda a, b: a + b, [c(x) for x in cols])


def row_mean(cols: Iterable) -> Column:
    cols = list(cols)
    return row_sum(cols) / F.lit(float(len(cols)))
