"""Step 1 queries: scan, column selection, profiling, top-k, schema alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import profile as P
from ..sources.scan import align, union_tagged
from .fixtures import WIDE_FEATURES, v_ticks, v_wide, with_views
from .registry import register


def _corr_union_sql(view: str, y: str, feats: list[str]) -> str:
    parts = [f"SELECT '{f}' AS feature, COALESCE(covar_pop({f}, {y}) / NULLIF(stddev_pop({f}) * stddev_pop({y}), 0), 0.0) AS corr FROM {view}"
             for f in feats]
    return "\nUNION ALL\n".join(parts)


CORR_SQL = "corr_t AS (" + _corr_union_sql("v_wide", "target", WIDE_FEATURES) + ")"


@register("target_corr_topk", with_views("v_wide", extra=[CORR_SQL]) + """
SELECT feature, ROUND(corr, 6) AS corr, ROUND(ABS(corr), 6) AS abs_corr FROM corr_t
ORDER BY ABS(corr) DESC, feature LIMIT 5""")
def target_corr_topk(spark, sf):
    """S1 -> P1 -> A9 -> O2: which features correlate most with the target?"""
    wide = v_wide(spark, sf)
    feats = P.feature_cols(wide, drop=("id", "grp", "target"))
    top = P.top_features(P.target_corr(wide, "target", feats), 5)
    return top.select("feature", rnd("corr").alias("corr"), rnd(F.abs("corr")).alias("abs_corr"))


@register("select_by_threshold", with_views("v_wide", extra=[CORR_SQL]) + """
SELECT feature, ROUND(corr, 6) AS corr FROM corr_t WHERE ABS(corr) > 0.05
ORDER BY ABS(corr) DESC, feature LIMIT 4""")
def select_by_threshold(spark, sf):
    """O3: |corr| > threshold, capped to the strongest k."""
    wide = v_wide(spark, sf)
    sel = P.select_features(P.target_corr(wide, "target", WIDE_FEATURES), 0.05, cap=4)
    return sel.select("feature", rnd("corr").alias("corr"))


@register("corr_distribution", with_views("v_wide", extra=[CORR_SQL]) + """
SELECT CAST(COUNT(*) AS BIGINT) AS n_features, ROUND(MAX(ABS(corr)), 6) AS max_abs_corr,
       ROUND(AVG(ABS(corr)), 6) AS mean_abs_corr,
       CAST(SUM(CASE WHEN ABS(corr) > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_0p5,
       CAST(SUM(CASE WHEN ABS(corr) > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_0p1,
       CAST(SUM(CASE WHEN ABS(corr) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_0p01
FROM corr_t""")
def corr_distribution(spark, sf):
    """Shape of the |corr| distribution."""
    corr = P.target_corr(v_wide(spark, sf), "target", WIDE_FEATURES)
    d = P.corr_distribution(corr, (0.5, 0.1, 0.01))
    return d.select("n_features", rnd("max_abs_corr").alias("max_abs_corr"),
                    rnd("mean_abs_corr").alias("mean_abs_corr"), "n_above_0p5", "n_above_0p1", "n_above_0p01")


@register("quality_profile", with_views("v_wide") + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature,
       CAST(SUM(CASE WHEN {f} IS NULL OR isnan({f}) THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       CAST(SUM(CASE WHEN isinf({f}) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf,
       ROUND(stddev_samp(CASE WHEN isfinite({f}) THEN {f} END), 4) AS std,
       CASE WHEN stddev_samp(CASE WHEN isfinite({f}) THEN {f} END) = 0 THEN 1 ELSE 0 END AS is_constant
FROM v_wide""" for f in WIDE_FEATURES))
def quality_profile(spark, sf):
    """NaN/inf counts, std and constant flag per feature."""
    q = P.quality_profile(v_wide(spark, sf), WIDE_FEATURES)
    return q.select("feature", "n_missing", "n_inf", rnd("std", 4).alias("std"), "is_constant")


@register("schema_align_union", with_views("v_ticks") + """
SELECT CAST(is_test AS INTEGER) AS is_test, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(COUNT(target) AS BIGINT) AS n_target,
       ROUND(SUM(price), 4) AS sum_price, ROUND(SUM(COALESCE(price_l1, 0.0)), 4) AS sum_l1,
       ROUND(SUM(COALESCE(s2_l1, 0.0)), 4) AS sum_s2_l1, ROUND(SUM(0.0), 4) AS sum_absent
FROM (SELECT id, price, price_l1, s2_l1, target, 0 AS is_test FROM v_ticks WHERE is_test = 0
      UNION ALL
      SELECT id, price, price_l1, s2_l1, NULL AS target, 1 AS is_test FROM v_ticks WHERE is_test = 1) u
GROUP BY is_test""")
def schema_align_union(spark, sf):
    """S12 + U1: align the test side to the train feature list (absent -> 0), tagged union."""
    t = v_ticks(spark, sf)
    feats = ["price", "price_l1", "s2_l1", "absent_feature"]
    train = align(t.filter("is_test = 0"), feats, keep=["id", "target"])
    test = align(t.filter("is_test = 1"), feats, keep=["id"])
    u = union_tagged(train, test)
    return u.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("n_target"),
        F.round(F.sum("price"), 4).alias("sum_price"),
        F.round(F.sum(F.coalesce("price_l1", F.lit(0.0))), 4).alias("sum_l1"),
        F.round(F.sum(F.coalesce("s2_l1", F.lit(0.0))), 4).alias("sum_s2_l1"),
        F.round(F.sum("absent_feature"), 4).alias("sum_absent"))


# S4, S5, S13, P2-P8, P14, A10 ------------------------------------------------------
@register("row_count", """SELECT CAST((SELECT COUNT(*) FROM lineitem) AS BIGINT) AS n_lineitem,
       CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS n_orders, CAST((SELECT COUNT(*) FROM events) AS BIGINT) AS n_events""")
def row_count(spark, sf):
    """Row counts (answered from Parquet metadata, no column read)."""
    from ..operators.aggregates import combine_scalars
    from ..sources.scan import scan
    parts = [(f"n_{t}", scan(spark, sf, t).agg(F.count(F.lit(1)).alias("v"))) for t in ("lineitem", "orders", "events")]
    out = combine_scalars(parts)
    return out.select(*[F.col(n).cast("long").alias(n) for n, _ in parts])


@register("head_rows", with_views("v_ticks") + "SELECT id, price FROM v_ticks ORDER BY t, id LIMIT 10")
def head_rows(spark, sf):
    """First 10 rows under an explicit order (top-n, no global sort)."""
    from ..sources.scan import head
    return head(v_ticks(spark, sf), 10, ["t", "id"]).select("id", "price")


def _schema_side(view: str, where: str, drop: str, side: str) -> list[str]:
    """CTEs of one side: its types under Spark's names, and its non-null counts (none for ``t``)."""
    types = f"SELECT any_value(typeof(COLUMNS('(.*)'))) AS '\\1' FROM {side}_rows"
    counts = f"SELECT COUNT(COLUMNS('(.*)')) AS '\\1' FROM (SELECT * EXCLUDE (t) FROM {side}_rows)"
    return [f"{side}_rows AS (SELECT * EXCLUDE ({drop}) FROM {view} WHERE {where})",
            f"{side}_types AS (UNPIVOT ({types}) ON COLUMNS(*) INTO NAME name VALUE type)",
            f"{side}_counts AS (UNPIVOT ({counts}) ON COLUMNS(*) INTO NAME name VALUE n)"]


def _spark_type(side: str) -> str:
    return (f"CASE {side}_types.type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
            f"ELSE lower({side}_types.type) END AS {side}_type")


@register("schema_diff", with_views("v_ticks", extra=[
    *_schema_side("v_ticks", "is_test = 0", "is_test", "left"),
    *_schema_side("v_ticks", "is_test = 1", "target, is_test, s2_l1", "right")]) + f"""
SELECT coalesce(left_types.name, right_types.name) AS "column",
       CASE WHEN right_types.name IS NULL THEN 'left_only' WHEN left_types.name IS NULL THEN 'right_only' ELSE 'both' END AS status,
       {_spark_type("left")}, {_spark_type("right")}, left_counts.n AS left_non_null, right_counts.n AS right_non_null
FROM left_types FULL JOIN right_types ON left_types.name = right_types.name
LEFT JOIN left_counts ON left_counts.name = left_types.name LEFT JOIN right_counts ON right_counts.name = right_types.name""")
def schema_diff(spark, sf):
    """S13 + U4: column-set comparison of the train and test sides, with each side's non-null count per
    column (one unpivoted aggregate per side, so the work grows with the tables)."""
    from ..sources.scan import schema_diff as sd
    t = v_ticks(spark, sf)
    a, b = t.filter("is_test = 0").drop("is_test"), t.filter("is_test = 1").drop("target", "is_test", "s2_l1")

    def nonnull(df, name):
        cols = [c for c in df.columns if c != "t"]
        long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
        return long.groupBy("column").agg(F.count("v").alias(name))

    d = sd(spark, a, b)
    return (d.join(nonnull(a, "left_non_null"), "column", "left").join(nonnull(b, "right_non_null"), "column", "left")
            .select("column", "status", "left_type", "right_type", "left_non_null", "right_non_null"))


_PLANT = ("CASE WHEN s2 = 0 THEN CAST('inf' AS DOUBLE) WHEN s2 = 1 THEN CAST('-inf' AS DOUBLE) "
          "WHEN s2 = 2 THEN CAST('nan' AS DOUBLE) ELSE price_l1 END")


@register("clean_values", with_views("v_ticks", extra=[f"c AS (SELECT id, {_PLANT} AS x, price FROM v_ticks)"]) + """
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(COUNT(*) FILTER (WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AS BIGINT) AS n_finite,
       CAST(COUNT(*) FILTER (WHERE x IS NOT NULL) AS BIGINT) AS n_not_null,
       ROUND(SUM(CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE COALESCE(x, 0.0) END), 4) AS sum_clean0,
       ROUND(SUM(CASE WHEN isnan(x) THEN 0.0 WHEN x = CAST('inf' AS DOUBLE) THEN 100.0
                      WHEN x = CAST('-inf' AS DOUBLE) THEN -100.0 ELSE COALESCE(x, 0.0) END), 4) AS sum_clean100,
       ROUND(SUM(ABS(price) + 1e-10), 4) AS sum_safe_den,
       CAST(COUNT(*) FILTER (WHERE price > 100.0) AS BIGINT) AS n_masked FROM c""")
def clean_values(spark, sf):
    """P4 cleaning variants, P6 finite-only, P7 not-null, P8 boolean mask, P14 safe denominators."""
    from ..functions.expr import clean, is_finite, safe_den
    t = v_ticks(spark, sf)
    x = (F.when(F.col("s2") == 0, F.lit(float("inf"))).when(F.col("s2") == 1, F.lit(float("-inf")))
         .when(F.col("s2") == 2, F.lit(float("nan"))).otherwise(F.col("price_l1")))
    c = t.select("id", x.alias("x"), "price")
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_finite("x")).alias("n_finite"),
                 F.count("x").alias("n_not_null"),
                 F.round(F.sum(clean("x", null=0.0)), 4).alias("sum_clean0"),
                 F.round(F.sum(clean("x", pos=100.0, neg=-100.0, null=0.0)), 4).alias("sum_clean100"),
                 F.round(F.sum(safe_den("price")), 4).alias("sum_safe_den"),
                 F.count_if(F.col("price") > 100.0).alias("n_masked"))


_PC = "COALESCE(covar_pop(price_l1, target) / NULLIF(stddev_pop(price_l1) * stddev_pop(target), 0), 0.0)"


@register("pair_corr", with_views("v_ticks") + f"""
SELECT ROUND({_PC}, 6) + 0.0 AS corr, ROUND(pow({_PC}, 2), 6) + 0.0 AS corr_sq
FROM v_ticks WHERE price_l1 IS NOT NULL AND target IS NOT NULL""")
def pair_corr(spark, sf):
    """A10: ad-hoc safe Pearson correlation and its square."""
    from ..operators.aggregates import pair_corr as pc
    t = v_ticks(spark, sf).filter(F.col("price_l1").isNotNull() & F.col("target").isNotNull())
    return pc(t, "price_l1", "target").select(rnd("corr").alias("corr"), rnd("corr_sq").alias("corr_sq"))
