"""Tiny helpers that spell the oracle SQL for expression families (DuckDB dialect).

These only build SQL text for the oracle side; they mirror the Column
builders formula by formula so both engines evaluate the same arithmetic.
"""

from __future__ import annotations

from typing import Sequence

EPS = "1e-10"


def nz(a: str, b: str) -> str:
    return f"COALESCE(({a}) / NULLIF({b}, 0), 0.0)"


def plus(cols: Sequence[str]) -> str:
    return "(" + " + ".join(cols) + ")"


def imb(a: str, b: str, eps: str = EPS) -> str:
    return nz(f"{a} - {b}", f"ABS({a}) + ABS({b}) + {eps}")


def r(expr: str, d: int = 6) -> str:
    return f"(ROUND(CAST({expr} AS DOUBLE), {d}) + 0.0)"


def rf(expr: str, d: int = 6) -> str:
    """Round through float32 (7 significant digits), then to ``d`` decimals."""
    return f"(ROUND(CAST(CAST({expr} AS FLOAT) AS DOUBLE), {d}) + 0.0)"


def weights(n: int) -> list[float]:
    raw = [float(n - i) for i in range(n)]
    s = sum(raw)
    return [x / s for x in raw]


def wsum(cols: Sequence[str]) -> str:
    w = weights(len(cols))
    return "(" + " + ".join(f"{c} * {wi!r}" for c, wi in zip(cols, w)) + ")"


def corr(x: str, y: str) -> str:
    return f"COALESCE(covar_pop({x}, {y}) / NULLIF(stddev_pop({x}) * stddev_pop({y}), 0), 0.0)"


def solve_step(m: str, k: str) -> str:
    """Step ``k`` (from 1) of Gauss-Jordan elimination on ``m``, a list of rows with the right side as last column."""
    return (f"list_transform({m}, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) "
            f"ELSE list_transform(r, lambda v, j: v - r[{k}] / {m}[{k}][{k}] * {m}[{k}][j]) END)")


def normal_equations(feats: Sequence[str], y: str) -> str:
    """Rows of the normal equations of standardised ``feats`` and centred ``y``, from pair covariances."""
    sd = {f: pop_std(f) for f in feats}
    rows = [[f"COUNT(*) * COVAR_POP({a}, {b}) / ({sd[a]} * {sd[b]})" for b in feats] + [f"COUNT(*) * COVAR_POP({a}, {y}) / {sd[a]}"]
            for a in feats]
    return "[" + ", ".join("[" + ", ".join(row) + "]" for row in rows) + "]"


def add_ridge(m: str, ridge: str) -> str:
    return f"list_transform({m}, lambda r, i: list_transform(r, lambda v, j: v + CASE WHEN i = j THEN {ridge} ELSE 0 END))"


def pop_std(f: str) -> str:
    return f"COALESCE(NULLIF(STDDEV_POP({f}), 0), 1)"
