"""Step 8 queries: deterministic sampling, holdout, k-fold, stratified and group folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as Fo
from .fixtures import v_wide, with_views
from .q_windows import h01
from .registry import register

U32_SQL = "CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS UBIGINT)"


@register("holdout", with_views("v_wide") + f"""
SELECT id, CASE WHEN {h01()} < 0.2 THEN 1 ELSE 0 END AS is_holdout FROM v_wide""")
def holdout(spark, sf):
    """R2: 20 % Bernoulli holdout from a partition-independent hash."""
    return Fo.holdout(v_wide(spark, sf), "id", 0.2).select("id", "is_holdout")


@register("sample_n", with_views("v_wide") + f"SELECT id FROM v_wide ORDER BY {h01()}, id LIMIT 500")
def sample_n(spark, sf):
    """Fixed-size sample without replacement (the 500 smallest hashes)."""
    return Fo.sample_n(v_wide(spark, sf).select("id"), 500)


@register("kfold", with_views("v_wide") + f"""
SELECT id, CAST((row_number() OVER (ORDER BY {h01()}, id) - 1) % 5 AS INTEGER) AS fold FROM v_wide""")
def kfold(spark, sf):
    """R5 balanced: rank by hash (dense index, no single-task window), fold = rank % 5."""
    return Fo.kfold(v_wide(spark, sf).select("id"), 5)


@register("kfold_hash", with_views("v_wide") + f"SELECT id, CAST({U32_SQL} % 5 AS INTEGER) AS fold FROM v_wide")
def kfold_hash(spark, sf):
    """R5 scalable: fold = hash % 5 (one narrow projection)."""
    return Fo.kfold(v_wide(spark, sf).select("id"), 5, balanced=False)


@register("stratified_split", with_views("v_wide") + f"""
, l AS (SELECT id, CASE WHEN f5 >= 4 THEN 1 ELSE 0 END AS label FROM v_wide),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {h01()}, id) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY label) AS n FROM l)
SELECT id, label, CASE WHEN pos < floor(0.2 * n + 0.5) THEN 1 ELSE 0 END AS is_test FROM r""".replace("\n, l AS", ", l AS", 1))
def stratified_split(spark, sf):
    """Stratified 80/20 split by label (per-label offsets from the dense index)."""
    w = v_wide(spark, sf).select("id", F.when(F.col("f5") >= 4, 1).otherwise(0).alias("label"))
    return Fo.stratified_split(w, "label", 0.2).select("id", "label", "is_test")


@register("group_kfold", with_views("v_wide") + """
, s AS (SELECT grp, COUNT(*) AS n FROM v_wide GROUP BY grp)
SELECT grp, CAST((row_number() OVER (ORDER BY n DESC, grp) - 1) % 5 AS INTEGER) AS fold, CAST(n AS BIGINT) AS n_rows
FROM s""".replace("\n, s AS", ", s AS", 1))
def group_kfold(spark, sf):
    """R6 (round robin): whole groups to folds by size rank; no group in two folds."""
    g = Fo.group_kfold(v_wide(spark, sf), "grp", 5, method="round_robin")
    return g.groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


#: Greedy folds of the groups of v_wide, as s (grp, n, r) and g (r, loads, grp, fold).
GREEDY_CTES = with_views("v_wide").replace("WITH ", "WITH RECURSIVE ", 1) + """
, s AS (SELECT grp, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, grp) AS r FROM v_wide GROUP BY grp),
g(r, loads, grp, fold) AS (
  SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[], CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
  UNION ALL
  SELECT s.r,
         list_transform(range(5), lambda i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) - 1
                                            THEN g.loads[i + 1] + s.n ELSE g.loads[i + 1] END),
         s.grp, CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INTEGER)
  FROM g JOIN s ON s.r = g.r + 1)
"""
_GREEDY_SQL = GREEDY_CTES + """SELECT g.fold, CAST(SUM(s.n) AS BIGINT) AS n_rows, CAST(COUNT(*) AS BIGINT) AS n_groups
FROM g JOIN s ON s.grp = g.grp GROUP BY g.fold"""


@register("group_kfold_greedy", _GREEDY_SQL)
def group_kfold_greedy(spark, sf):
    """R6 (greedy): largest group to the lightest fold; fold sizes and group counts."""
    g = Fo.group_kfold(v_wide(spark, sf), "grp", 5, method="greedy")
    return Fo.fold_sizes(g, "fold", "grp")
