"""Boosted trees grown for several settings at once against Spark ML's own, one setting at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ladderkit.operators import gbt as G
from ladderkit.operators import ml as M

FEATS = ["a", "b", "c", "d"]


def _frame(spark, n, parts):
    """``d`` has zeros and neighbouring numbers, whose means are equal edges; ``b`` has few values."""
    rng = np.random.default_rng(n)
    near = np.nextafter([0.06, 0.06, 0.06], [1, 0.06, 0])
    pdf = pd.DataFrame({"a": rng.normal(size=n).round(3), "b": rng.integers(0, 5, n), "c": rng.normal(size=n),
                        "d": np.where(rng.random(n) < 0.3, 0.0, np.where(rng.random(n) < 0.5, rng.choice(near, n), rng.normal(size=n)))})
    pdf["y"] = np.sin(pdf.a) + pdf.b * 0.2 + (pdf.c > 0) * (pdf.d > 0.06) + rng.normal(size=n) * 0.2
    pdf["fold"], pdf["id"] = rng.integers(0, 3, n), np.arange(n)
    return spark.createDataFrame(pdf).repartition(parts, "id").checkpoint()


@pytest.mark.parametrize("n, parts", [(200, 1), (21_000, 3), (40_000, 2)])   # edges from all, from 5/7 and from 3/8 of the rows
def test_trees_are_those_of_spark_ml(spark, n, parts, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 6_000)
    df = _frame(spark, n, parts)
    learners = {0: M.gbt(depth=2, step=0.2, max_iter=3), 2: M.gbt(depth=5, step=0.3, max_iter=4)}
    assert G.fits(list(learners.values()))
    got = G.FoldBlocks(df, FEATS, "y", "fold").score(1, learners).toPandas().sort_values("y")
    with M.FoldRows(df, FEATS, "y", "fold") as rows:
        for t, learner in learners.items():
            oof, _, _ = M.cv_oof(rows, FEATS, "y", "fold", lambda: learner.copy(), only=[1])
            want = oof.toPandas().sort_values("y")
            assert np.array_equal(got.y, want.y) and np.allclose(got[f"p{t}"], want.pred, rtol=1e-12, atol=1e-12)


def test_sums_of_many_tasks_and_partitions_are_merged_before_the_driver(spark, monkeypatch):
    df = _frame(spark, 500, 6)
    blocks = G.FoldBlocks(df, FEATS, "y", "fold")
    want = blocks.score(0, {0: M.gbt(depth=3, max_iter=2)}).toPandas().sort_values("y")
    for apart, merge in ((False, 64), (False, 0), (True, 0)):
        blocks.apart = apart
        monkeypatch.setattr(G, "MERGE", merge)
        got = blocks.score(0, {0: M.gbt(depth=3, max_iter=2)}).toPandas().sort_values("y")
        assert np.allclose(got.to_numpy(), want.to_numpy())


def test_what_the_driver_gets_does_not_grow_with_the_partitions(spark, monkeypatch):
    blocks = G.FoldBlocks(_frame(spark, 600, 40), FEATS, "y", "fold")
    got, whole = [], type(blocks.blocks).collect
    monkeypatch.setattr(type(blocks.blocks), "collect", lambda self: got.append(len(rows := whole(self))) or rows)
    assert blocks.score(0, {0: M.gbt(depth=2, max_iter=2)}).count() > 0
    assert got and max(got) < 20   # a row a task, not one a partition


def test_numbers_from_any_place_are_those_of_the_stream():
    whole = G.uniforms([42, 43], 0, 1000)
    assert np.array_equal(G.uniforms([42, 43], 317, 500), whole[:, 317:817])
    assert np.array_equal(whole, np.concatenate([G.uniforms([s], 0, 1000) for s in (42, 43)]))
    assert 0.45 < whole.mean() < 0.55 and len(np.unique(whole)) == 2000


def test_search_of_settings_grows_its_trees_in_shared_passes(spark, monkeypatch):
    df = _frame(spark, 300, 2)
    settings = [(2, 0.1), (3, 0.3), (1, 0.05)]

    def draw(rng, seen=[]):
        seen.append(1)
        depth, step = settings[len(seen) - 1]
        return depth, step, lambda: M.gbt(depth=depth, step=step, max_iter=3)

    calls, one = [], M.cv_oof
    monkeypatch.setattr(M, "cv_oof", lambda *a, **kw: calls.append(1) or one(*a, **kw))
    got = M.tune_pruned(df, FEATS, "y", "fold", n_trials=3, startup=3, draw=draw).collect()
    assert not calls and [(r.max_depth, r.folds_scored) for r in got] == [(2, 3), (3, 3), (1, 3)]
    for r in got:
        oof, _, _ = one(df, FEATS, "y", "fold", lambda: M.gbt(depth=r.max_depth, step=r.step_size, max_iter=3))
        p = oof.toPandas()
        assert abs(r.r2 - (1 - ((p.y - p.pred) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum())) < 1e-9


def test_other_learners_and_limits_go_to_spark_ml():
    assert not G.fits([]) and not G.fits([LinearRegression()])
    assert not G.fits([M.gbt(), M.gbt(seed=1)]) and not G.fits([M.gbt(loss="absolute")]) and not G.fits([M.gbt(validation="v")])
    assert not G.fits([M.gbt().setMinInstancesPerNode(2)]) and G.fits([M.gbt(), M.gbt(depth=2, step=0.3, max_iter=3)])


def test_rows_that_spark_ml_refuses_are_refused_and_empty_tables_have_no_folds(spark):
    df = _frame(spark, 60, 1)
    assert G.FoldBlocks(df.limit(0), FEATS, "y", "fold").folds == []
    for bad in (df.withColumn("y", F.when(F.col("id") != 7, F.col("y"))), df.withColumn("a", F.when(F.col("id") != 7, F.col("a")))):
        with pytest.raises(Exception, match="finite"):
            G.FoldBlocks(bad, FEATS, "y", "fold")
    with pytest.raises(ValueError, match="outside the fold"):
        G.FoldBlocks(df.withColumn("fold", F.lit(0)), FEATS, "y", "fold").score(0, {0: M.gbt()})
