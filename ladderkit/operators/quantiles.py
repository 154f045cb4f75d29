"""Exact percentiles that scale (A1 median, A3, A19, P11, A20, B9).

``percentile()`` keeps a value->count map per group in one buffer, which grows with the number of
distinct values - unbounded on a 100 TB feature column. Here the wanted order statistics are selected
without sorting the rows:

1. one pass makes a sketch per group (``percentile_approx``), whose values a little below and above
   each wanted rank bracket it;
2. one pass counts: rows outside all brackets add up to one number a gap, rows inside are counted a
   value. Only the brackets' values (about ``4 / ACCURACY`` of the rows a rank; a value that most
   rows share is one row) go on;
3. running sums of these counts give every value its sorted positions, and the neighbours of a rank
   are the values that hold them.

A rank that falls into a gap shows that the sketch missed it; then the rows are sorted by value
(``_sorted_quantiles``), as they are where a whole table has no more than ``SMALL_GROUP`` rows. Groups of at most ``SMALL_GROUP`` rows need no brackets: their buffers are
bounded, so ``percentile()`` takes them, and a join on the keys of the larger ones parts the two.

``exact=False`` switches to the ``percentile_approx`` sketch (bounded memory, one pass, approximate).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lit_d, nan_to_null
from ..session import ensure_checkpoint_dir
from .sequence import running_sum

ACCURACY = 10_000           # of the sketch: ranks are off by at most 1 / ACCURACY of the rows
SMALL_GROUP = 20_000        # rows whose values a buffer may hold
WINDOW_ROWS = 1_000_000     # counted values of a group that one task may order


def quantiles(df: DataFrame, value, ps: Sequence[float], group: Sequence[str] = (),
              exact: bool = True, accuracy: int = 10000, few_groups: bool = False) -> DataFrame:
    """Return ``(group..., p, q)``: quantile ``q`` of ``value`` at each ``p`` (NULL/NaN skipped).

    ``few_groups`` says that the groups are few (columns of a table, say): all are bracketed, without
    the pass that finds the small ones. It changes the plan, not the rows.

    Linear interpolation between order statistics ``floor(h)`` and ``ceil(h)``
    with ``h = (n - 1) * p`` (NumPy's default / SQL ``quantile_cont``).
    """
    group = list(group)
    x = nan_to_null(F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(*group, x.alias("_x")).filter(F.col("_x").isNotNull())
    p_arr = F.array(*[F.lit(float(p)) for p in ps])
    if not exact:
        agg = d.groupBy(*group).agg(F.percentile_approx("_x", p_arr, accuracy).alias("_q"))
        return agg.select(*group, F.posexplode("_q").alias("_i", "q")).select(
            *group, F.element_at(p_arr, F.col("_i") + 1).alias("p"), "q")
    ensure_checkpoint_dir(df.sparkSession)
    if not group or few_groups:
        return _selected(d, group, ps)
    sizes = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    least, most = sizes.agg(F.min("_n"), F.max("_n")).first()
    if (most or 0) <= SMALL_GROUP:
        return _small(d, group, ps)
    if least > SMALL_GROUP:
        return _selected(d, group, ps)
    hot = _renamed(sizes.filter(F.col("_n") > SMALL_GROUP), group)
    return (_small(d.join(hot, _same(group), "left_anti"), group, ps)
            .unionByName(_selected(d.join(hot, _same(group), "left_semi"), group, ps)))


def _renamed(df: DataFrame, group: Sequence[str], *others: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *others)


def _same(group: Sequence[str]) -> Column:
    """Null-safe match with renamed keys: rows whose group is null form a group."""
    return reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])


def _small(d: DataFrame, group: list[str], ps: Sequence[float]) -> DataFrame:
    p_arr = F.array(*[F.lit(float(p)) for p in ps])
    agg = d.groupBy(*group).agg(F.percentile("_x", p_arr).alias("_q"))
    return (agg.select(*group, F.posexplode("_q").alias("_i", "q"))
            .select(*group, F.element_at(p_arr, F.col("_i") + 1).alias("p"), "q"))


def _selected(d: DataFrame, group: list[str], ps: Sequence[float]) -> DataFrame:
    """Bracket, count, keep the brackets' values; eager up to those values."""
    margin = 2.0 / ACCURACY
    points = [v for p in ps for v in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.percentile_approx("_x", F.array(*map(F.lit, points)), ACCURACY).alias("_s")
    if group:
        found = _renamed(d.groupBy(*group).agg(sketch), group, "_s").checkpoint()   # a row for each large group
        rows, low = d.join(found, _same(group)), lambda i: F.col("_s")[i]
    else:
        total, found = d.agg(F.count(F.lit(1)), sketch).first()
        if found is None:
            return d.sparkSession.createDataFrame([], "p double, q double")
        if total <= SMALL_GROUP:   # few values: sorted at once, without brackets
            return _sorted_quantiles(d, group, ps)
        rows, low = d, lambda i: lit_d(found[i])
    x, n = F.col("_x"), len(ps)
    inside = reduce(lambda u, v: u | v, [x.between(low(2 * i), low(2 * i + 1)) for i in range(n)])
    gap = reduce(lambda u, v: u + v, [(low(2 * i + 1) < x).cast("int") for i in range(n)])
    counted = (rows.select(*group, "_x", inside.alias("_in"), gap.alias("_gap"))
               .groupBy(*group, F.when(F.col("_in"), x).alias("_value"), F.when(~F.col("_in"), F.col("_gap")).alias("_of"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_at")).drop("_of").checkpoint())
    largest = counted.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        runs = counted.withColumn("_n_cum", F.sum("_n").over(w.orderBy("_at"))).withColumn("_t", F.sum("_n").over(w))
        runs = runs.withColumn("_before", F.col("_n_cum") - F.col("_n")).withColumn("_s", F.lit(0))
    else:
        runs = _positions(running_sum(counted, group + ["_at"], ["_n"]), group)
    out = _pick(runs.withColumnRenamed("_value", "_picked"), group, ps, F.col("_picked").isNull()).checkpoint()
    if out.filter("_missed").head(1):
        return _sorted_quantiles(d, group, ps)
    return out.drop("_missed")


def _sorted_quantiles(d: DataFrame, group: list[str], ps: Sequence[float]) -> DataFrame:
    """By sorting: one row per distinct value, its rows covering the positions [_before, _n_cum)."""
    runs = running_sum(d.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n")), group + ["_x"], ["_n"])
    return _pick(_positions(runs, group).withColumnRenamed("_x", "_picked"), group, ps, F.lit(False)).drop("_missed")


def _positions(runs: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``_before``, the group's first position ``_s`` and its number of rows ``_t``."""
    runs = runs.withColumn("_before", F.col("_n_cum") - F.col("_n"))
    if not group:
        total = runs.agg(F.sum("_n")).first()[0] or 0
        return runs.withColumn("_s", lit_d(0.0)).withColumn("_t", F.lit(total))
    g = runs.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(
        F.min("_before").alias("_s"), F.sum("_n").alias("_t"))
    return runs.join(g, _same(group))


def _pick(runs: DataFrame, group: list[str], ps: Sequence[float], missing: Column) -> DataFrame:
    """(group..., p, q, _missed) from the rows whose positions hold a wanted rank."""
    p_arr = F.array(*[F.lit(float(p)) for p in ps])

    def place(p):
        h = (F.col("_t") - 1).cast("double") * p
        lo, hi = F.col("_s") + F.floor(h), F.col("_s") + F.ceil(h)
        return F.struct(p.alias("p"), (h - F.floor(h)).alias("_fr"),
                        ((F.col("_before") <= lo) & (lo < F.col("_n_cum"))).alias("_is_lo"),
                        ((F.col("_before") <= hi) & (hi < F.col("_n_cum"))).alias("_is_hi"))

    picked = (runs.select(*group, "_picked", missing.alias("_gone"),
                          F.explode(F.filter(F.transform(p_arr, place), lambda e: e["_is_lo"] | e["_is_hi"])).alias("_e"))
              .select(*group, "_picked", "_gone", "_e.*"))
    out = picked.groupBy(*group, "p").agg(
        F.max(F.when(F.col("_is_lo"), F.col("_picked"))).alias("_xl"),
        F.max(F.when(F.col("_is_hi"), F.col("_picked"))).alias("_xh"),
        F.first("_fr").alias("_fr"), F.max("_gone").alias("_missed"))
    between = F.col("_xl") + F.col("_fr") * (F.col("_xh") - F.col("_xl"))
    return out.select(*group, "p", F.when(F.col("_fr") == 0, F.col("_xl")).otherwise(between).alias("q"), "_missed")


def quantile_values(df: DataFrame, value, ps: Sequence[float], exact: bool = True) -> list[float]:
    """Ungrouped quantiles as driver literals (``len(ps)`` numbers)."""
    rows = {float(r["p"]): r["q"] for r in quantiles(df, value, ps, exact=exact).collect()}
    return [rows.get(float(p)) for p in ps]


def winsorize(df: DataFrame, col: str, lo_p: float, hi_p: float, out: str | None = None,
              exact: bool = True) -> DataFrame:
    """Clip ``col`` to its ``[lo_p, hi_p]`` percentiles (cut values become literals)."""
    lo, hi = quantile_values(df, col, [lo_p, hi_p], exact=exact)
    return df.withColumn(out or col, F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi)))
