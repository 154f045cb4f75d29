"""Step 11 queries: exact kNN join, kNN back-test, approximate (home-partition) kNN."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash01, rndf, safe_corr
from ..operators import knn as Kn
from ..operators.metrics import r2_col
from ..sources.scan import scan
from . import sqlgen as S
from .q_windows import h01
from .registry import register

_KS = [1, 3, 5, 10, 20, 50]


def _split(spark, sf):
    e = scan(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    probe = hash01("vec_id") < 0.2
    return e.filter(probe), e.filter(~probe)


_KNN_CTE = f"""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE {h01('vec_id')} < 0.2),
b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE {h01('vec_id')} >= 0.2),
d AS (SELECT p.vec_id AS probe_id, p.label AS y, b.vec_id AS base_id, b.label AS lb, list_distance(p.e, b.e) AS dist FROM p, b),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY dist, base_id) AS rank FROM d)
"""


@register("knn_exact", _KNN_CTE + f"""
SELECT probe_id, CAST(rank AS INTEGER) AS rank, base_id, {S.rf('dist')} AS dist FROM r WHERE rank <= 5""")
def knn_exact(spark, sf):
    """Exact 5-NN of every probe vector (pivot partitions + triangle-inequality pruning, no cross join)."""
    probe, base = _split(spark, sf)
    nn = Kn.knn(probe, base, 5)
    return nn.select("probe_id", "rank", "base_id", rndf("dist").alias("dist"))


@register("knn_backtest", _KNN_CTE + ", pr AS (" + "\nUNION ALL\n".join(
    f"SELECT {K} AS k, probe_id, MAX(y) AS y, SUM(lb / (dist + 1e-8)) / SUM(1.0 / (dist + 1e-8)) AS p FROM r "
    f"WHERE rank <= {K} GROUP BY probe_id" for K in _KS) + f""")
SELECT CAST(k AS INTEGER) AS k, CAST(COUNT(*) AS BIGINT) AS n,
       {S.rf('1.0 - SUM(pow(y - p, 2)) / (var_pop(y) * COUNT(*))')} AS r2, {S.rf(S.corr('p', 'y'))} AS corr
FROM pr GROUP BY k""")
def knn_backtest(spark, sf):
    """Distance-weighted kNN label prediction on held-out vectors - R^2 and corr per K."""
    probe, base = _split(spark, sf)
    nn = Kn.knn(probe, base, max(_KS))
    pred = Kn.knn_predict(nn, base, _KS).join(
        probe.select(F.col("vec_id").alias("probe_id"), F.col("label").cast("double").alias("y")), "probe_id")
    long = pred.select("y", F.explode(F.array(*[F.struct(F.lit(K).alias("k"), F.col(f"pred_k{K}").alias("p"))
                                                  for K in _KS])).alias("e")).select("y", "e.k", "e.p")
    return long.groupBy("k").agg(F.count(F.lit(1)).alias("n"), rndf(r2_col("y", "p")).alias("r2"),
                                 rndf(safe_corr("p", "y")).alias("corr"))


_H7 = "(CAST(('0x' || substr(md5('7:' || CAST({c} AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0)"

_APPROX_SQL = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {h01('vec_id')} < 0.2 AS is_probe FROM embeddings),
piv AS (SELECT k, pv FROM (SELECT row_number() OVER (ORDER BY {_H7.format(c='vec_id')}, vec_id) - 1 AS k, v AS pv
                           FROM e WHERE NOT is_probe) WHERE k < 16),
hd AS (SELECT e.vec_id, e.is_probe, piv.k, list_distance(e.v, piv.pv) AS d FROM e CROSS JOIN piv),
home AS (SELECT vec_id, is_probe, k AS home FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS rn FROM hd)
         WHERE rn = 1),
pairs AS (SELECT p.vec_id AS probe_id, b.vec_id AS base_id, list_distance(ep.v, eb.v) AS dist
          FROM home p JOIN home b ON b.home = p.home AND p.is_probe AND NOT b.is_probe
          JOIN e ep ON ep.vec_id = p.vec_id JOIN e eb ON eb.vec_id = b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY dist, base_id) AS rank FROM pairs)
SELECT probe_id, CAST(rank AS INTEGER) AS rank, base_id, {S.rf('dist')} AS dist FROM r WHERE rank <= 5"""


@register("knn_approx", _APPROX_SQL)
def knn_approx(spark, sf):
    """J13 (approximate): home-partition-only search - bounded work; recall vs exact is checked in the tests."""
    probe, base = _split(spark, sf)
    nn = Kn.knn(probe, base, 5, n_pivots=16, exact=False)
    return nn.select("probe_id", "rank", "base_id", rndf("dist").alias("dist"))


def _knn_pca(spark, sf, components):
    from ..operators import ml as M
    probe, base = _split(spark, sf)
    model = M.pca_fit_array(base, "embedding", components)
    nn = Kn.knn(M.pca_apply(model, probe, "embedding"), M.pca_apply(model, base, "embedding"), max(_KS), vec="pcs")
    return nn.select("probe_id", "rank", "base_id", rndf("dist").alias("dist"))


@register("knn_pca")
def knn_pca(spark, sf):
    """J13 + M2: exact 50-NN in a 15-component PCA space fitted on the base vectors only."""
    return _knn_pca(spark, sf, 15)


@register("knn_pca30")
def knn_pca30(spark, sf):
    """J13 + M2: exact 50-NN in a 30-component PCA space fitted on the base vectors only."""
    return _knn_pca(spark, sf, 30)
