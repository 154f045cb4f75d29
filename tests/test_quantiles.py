"""Exact quantiles by bracketed selection against NumPy: ties, null groups, wide ranges, missed brackets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ladderkit.operators import quantiles as Q

PS = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    parts = {"wide": np.exp(rng.normal(0, 8, 40_000)), "ties": np.where(rng.random(30_000) < 0.9, 5.0, rng.normal(size=30_000)),
             "few": rng.integers(0, 3, 25_000).astype(float), None: -rng.random(22_000), "small": rng.normal(size=101),
             "one": np.array([7.0]), "inf": np.array([np.inf, -np.inf, 0.0, 1.0])}
    pdf = pd.concat([pd.DataFrame({"g": [g] * len(x), "v": x}) for g, x in parts.items()])
    df = spark.createDataFrame(pdf, "g string, v double")
    df = df.unionByName(spark.createDataFrame([("small", None), ("small", float("nan")), ("none", None)], "g string, v double"))
    return df.repartition(7), parts


def check(got, parts, ps=PS):
    rows = {(r["g"], r["p"]): r["q"] for r in got.collect()}
    assert len(rows) == len(parts) * len(ps)
    for g, x in parts.items():
        for p in ps:
            if g == "inf":      # only the ends are defined
                assert p not in (0.0, 1.0) or rows[g, p] == (2 * p - 1) * np.inf
                continue
            assert rows[g, p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-15), (g, p)


@pytest.mark.parametrize("small,window", [(20_000, 1_000_000), (0, 1_000_000), (50, 5)])
def test_grouped(data, monkeypatch, small, window):
    """All paths: buffers and brackets together, brackets alone, and counted values in several tasks."""
    monkeypatch.setattr(Q, "SMALL_GROUP", small)
    monkeypatch.setattr(Q, "WINDOW_ROWS", window)
    check(Q.quantiles(data[0], "v", PS, group=["g"]), data[1])


def test_missed_brackets_are_sorted(data, monkeypatch):
    """A sketch of two values brackets little; the ranks it misses come from the sort."""
    monkeypatch.setattr(Q, "SMALL_GROUP", 0)
    called = []
    real = Q._sorted_quantiles
    monkeypatch.setattr(Q, "_sorted_quantiles", lambda *a: called.append(1) or real(*a))
    real_approx = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.max(c) * 0 + i for i in range(2 * len(PS))]))
    wide = {"wide": data[1]["wide"]}
    check(Q.quantiles(data[0].filter("g = 'wide'"), "v", PS, group=["g"]), wide)
    assert called and real_approx is not F.percentile_approx


def test_only_bracket_values_leave_the_scan(spark, monkeypatch):
    """Of many distinct values only about 4 / ACCURACY a rank are kept."""
    monkeypatch.setattr(Q, "ACCURACY", 1000)
    kept = []
    real = Q._pick
    monkeypatch.setattr(Q, "_pick", lambda runs, *a: kept.append(runs.count()) or real(runs, *a))
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("v"))
    got = Q.quantile_values(df, "v", [0.1, 0.5])
    x = df.toPandas().v
    assert got == pytest.approx([np.quantile(x, 0.1), np.quantile(x, 0.5)])
    assert kept and max(kept) < 2 * 200_000 * 5 / 1000


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.quantiles(df, "v", [0.5], group=["g"]).count() == 0
    assert Q.quantile_values(df, "v", [0.5]) == [None]
