"""Skew-safe ordered primitives: the blocked plan must equal the partitioned-window plan."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ladderkit.operators import sequence as Sq
from ladderkit.operators import windows as W


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # one hot group holds a third of the rows; the rest spread over 40 groups
    grp = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 41, n))
    pdf = pd.DataFrame({"id": np.arange(n), "grp": grp, "t": rng.permutation(n),
                        "x": rng.normal(size=n)})
    pdf.loc[rng.choice(n, n // 5, replace=False), "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    return df.repartition(7)


def _rows(df, cols):
    return sorted(tuple(None if v is None else round(v, 12) if isinstance(v, float) else v for v in r)
                  for r in df.select(*cols).collect())


def test_dense_index_is_dense_and_ordered(spark):
    df = _skewed(spark)
    ix, total = Sq.dense_index(df, ["grp", "t", "id"])
    pdf = ix.select("grp", "t", "id", "_idx").toPandas().sort_values("_idx")
    assert total == 3000
    assert list(pdf["_idx"]) == list(range(3000))
    assert list(pdf[["grp", "t", "id"]].itertuples(index=False)) == sorted(pdf[["grp", "t", "id"]].itertuples(index=False))


def test_blocked_shift_equals_window(spark):
    df = _skewed(spark)
    spec = dict(lags={"x": [1, 3]}, leads={"x": [1, 2], "id": [1]})
    a = Sq.shift(df, ["grp"], ["t", "id"], strategy="window", **spec)
    b = Sq.shift(df, ["grp"], ["t", "id"], strategy="blocked", **spec)
    cols = ["id", "x_lag1", "x_lag3", "x_lead1", "x_lead2", "id_lead1"]
    assert _rows(a, cols) == _rows(b, cols)


def test_auto_strategy_switches_on_hot_group(spark):
    df = _skewed(spark)
    spark.conf.set(Sq.MAX_GROUP_ROWS_CONF, "500")
    try:
        assert Sq.choose_strategy(df, ["grp"]) == "blocked"
    finally:
        spark.conf.unset(Sq.MAX_GROUP_ROWS_CONF)
    assert Sq.choose_strategy(df, ["grp"]) == "window"
    assert Sq.choose_strategy(df, []) == "blocked"


def test_blocked_fill_equals_window(spark):
    df = _skewed(spark)
    for direction in ("forward", "backward"):
        a = W.fill(df, "x", ["grp"], ["t", "id"], direction, out="f", strategy="window")
        b = W.fill(df, "x", ["grp"], ["t", "id"], direction, out="f", strategy="blocked")
        assert _rows(a, ["id", "f"]) == _rows(b, ["id", "f"])


def test_global_smoothing_matches_pandas(spark):
    df = _skewed(spark).fillna({"x": 0.0})
    out = W.smooth(df, "x", W.SMOOTH3_GLOBAL, group=None, order=["id"]).toPandas().sort_values("id")
    x = out["x"].to_numpy()
    prev = np.r_[x[0], x[:-1]]
    nxt = np.r_[x[1:], x[-1]]
    np.testing.assert_allclose(out["x_smooth"].to_numpy(), 0.9 * x + 0.05 * prev + 0.05 * nxt, rtol=1e-12)


def test_running_sum(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(500)[::-1], "v": np.ones(500)}))
    r = Sq.running_sum(df, ["k"], ["v"]).toPandas().sort_values("k")
    assert list(r["v_cum"]) == list(np.arange(1, 501, dtype=float))


def test_rank_avg_ties(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(7), "p": [3.0, 1.0, 3.0, 2.0, 3.0, 1.0, 5.0]}))
    r = W.rank_avg(df, "p").toPandas().sort_values("id")
    # scipy rankdata: [5, 1.5, 5, 3, 5, 1.5, 7]
    assert list(r["rank_avg"]) == [5.0, 1.5, 5.0, 3.0, 5.0, 1.5, 7.0]


def test_tiny_blocks_cross_many_boundaries(spark):
    """With 50-row blocks every hot-group lag/lead/fill crosses dozens of block edges."""
    df = _skewed(spark)
    spark.conf.set(Sq.MAX_BLOCK_ROWS_CONF, "50")
    try:
        spec = dict(lags={"x": [1, 3]}, leads={"x": [2]})
        a = Sq.shift(df, ["grp"], ["t", "id"], strategy="window", **spec)
        b = Sq.shift(df, ["grp"], ["t", "id"], strategy="blocked", **spec)
        assert _rows(a, ["id", "x_lag1", "x_lag3", "x_lead2"]) == _rows(b, ["id", "x_lag1", "x_lag3", "x_lead2"])
        for direction in ("forward", "backward"):
            fa = W.fill(df, "x", ["grp"], ["t", "id"], direction, out="f", strategy="window")
            fb = W.fill(df, "x", ["grp"], ["t", "id"], direction, out="f", strategy="blocked")
            assert _rows(fa, ["id", "f"]) == _rows(fb, ["id", "f"])
    finally:
        spark.conf.unset(Sq.MAX_BLOCK_ROWS_CONF)
