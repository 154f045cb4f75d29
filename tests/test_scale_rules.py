"""Planted cases for behaviour that must not depend on sizes, null keys or tolerances."""

import random

import numpy as np
import pandas as pd
import pytest

from ladderkit.operators.folds import group_kfold, greedy_runs, stratified_split
from ladderkit.operators import quantiles as Q
from ladderkit.operators import windows as W
from ladderkit.operators.link import assemble_chains, link_tolerance


def greedy(groups, k):
    load, out = [0] * k, {}
    for n, g in sorted((-n, g) for g, n in groups.items()):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] -= n
        out[g] = f
    return out


@pytest.mark.parametrize("seed", range(20))
def test_greedy_runs_equal_one_by_one_assignment(seed):
    rnd = random.Random(seed)
    groups = {g: rnd.choice([1, 1, 2, 3, 5, 40, rnd.randint(1, 200)]) for g in range(rnd.randint(1, 300))}
    k = rnd.randint(1, 7)
    sizes = sorted({n for n in groups.values()}, reverse=True)
    runs = greedy_runs([(n, sum(v == n for v in groups.values())) for n in sizes], k)
    ranked = [g for _, g in sorted((-n, g) for g, n in groups.items())]
    got = {}
    for size, a, b, order in runs:
        for r in range(a, b):
            assert groups[ranked[r]] == size
            got[ranked[r]] = order[(r - a) % len(order)]
    assert got == greedy(groups, k)


def test_group_kfold_keeps_rows_without_a_group(spark):
    rows = [(i, g) for i, g in enumerate([1, 1, 1, 2, 2, 3, None, None, None, None, 4])]
    got = group_kfold(spark.createDataFrame(rows, "id long, g long"), "g", 3).collect()
    assert sorted(r["id"] for r in got) == list(range(len(rows)))
    folds = {r["g"]: r["fold"] for r in got}
    assert folds == {None: 0, 1: 1, 2: 2, 3: 2, 4: 1} or len({r["fold"] for r in got if r["g"] is None}) == 1


def test_stratified_split_keeps_rows_without_a_label(spark):
    rows = [(i, [None, "a", "b"][i % 3]) for i in range(30)]
    got = stratified_split(spark.createDataFrame(rows, "id long, y string"), "y", 0.2).collect()
    assert len(got) == 30
    assert [sum(r["is_test"] for r in got if r["y"] == y) for y in (None, "a", "b")] == [2, 2, 2]


@pytest.mark.parametrize("tol", [5e-4, 1e-4, 0.3])
def test_exact_tolerance_finds_every_pair(spark, tol):
    rnd = random.Random(7)
    rows = [(i, round(rnd.uniform(0, 60 * tol), 7), round(rnd.uniform(0, 60 * tol), 7)) for i in range(120)]
    got = {(r["a_id"], r["b_id"]) for r in link_tolerance(
        spark.createDataFrame(rows, "id long, a double, b double"), ["a"], ["b"], tol=tol, exact=True).collect()}
    want = set()
    for i, a, _ in rows:
        near = [j for j, _, b in rows if abs(b - a) < tol]
        if near:
            want.add((i, min(near)))
    assert got == want


def test_flat_prices_do_not_multiply(spark):
    df = spark.range(5000).selectExpr("id", "1.0D as a", "1.0D as b")
    got = link_tolerance(df, ["a"], ["b"])
    assert got.count() == 5000 and {r["b_id"] for r in got.select("b_id").distinct().collect()} == {0}


def test_chains_with_cycles_and_singles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "id long")
    got = assemble_chains(nodes, spark.createDataFrame(edges, "src long, dst long"), min_len=2).collect()
    assert sorted((r["chain_id"], r["pos"], r["id"]) for r in got) == [(0, i, i) for i in range(41)]


def test_scratch_folder_only_for_a_local_master():
    from ladderkit import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def _tied(spark, n=4000):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), 0.0 if rnd.random() < 0.9 else rnd.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame(rows + [("c", None), ("d", float("nan"))], "g string, x double"), rows


def test_quantiles_where_most_rows_share_a_value(spark):
    df, rows = _tied(spark)
    ps = [0.0, 0.03, 0.25, 0.5, 0.951, 1.0]
    assert np.allclose(Q.quantile_values(df, "x", ps), np.quantile([x for _, x in rows], ps), atol=1e-12)
    got = {(r["g"], r["p"]): r["q"] for r in Q.quantiles(df, "x", ps, group=["g"]).collect()}
    assert set(got) == {(g, p) for g in ("a", "b", None) for p in ps}  # groups without a number have no row
    for g in ("a", "b", None):
        assert np.allclose([got[g, p] for p in ps], np.quantile([x for k, x in rows if k == g], ps), atol=1e-12)
    assert Q.quantile_values(df.filter("g = 'c'"), "x", [0.5]) == [None]


def test_average_rank_where_most_rows_share_a_value(spark):
    df, rows = _tied(spark)
    got = W.rank_avg(df.filter("g in ('a', 'b') or g is null"), "x", "r").toPandas()
    assert np.allclose(got["r"], pd.Series(got["x"]).rank().to_numpy())


def test_tied_values_are_counted_before_they_are_sorted(spark, monkeypatch):
    """The range sort sees one row a distinct value, so a value of most rows fills no partition."""
    from ladderkit.operators import sequence
    seen, inner = [], sequence.dense_index

    def spy(d, *args, **kw):
        seen.append(d.count())
        return inner(d, *args, **kw)

    monkeypatch.setattr(sequence, "dense_index", spy)
    df, rows = _tied(spark)
    Q.quantile_values(df, "x", [0.5])
    assert seen == [len({x for _, x in rows})]
