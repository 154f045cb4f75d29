"""Boosted trees from gradient histograms (M9): symmetric trees, leaf-wise cuts, dropped rounds.

Features are binned once by approximate quantiles, and the binned rows are packed once, a batch of
rows to a few byte strings. A level of a tree is one pass over the packed rows: each task adds up gradients by (model, leaf, feature, bin), the sums meet on the shuffle, and
Spark keeps the best cut; only the cut and its leaves' sums reach the driver. The models of all
folds grow in the same passes: a row counts for every model but that of its own fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


@dataclass
class Tree:
    """``cuts[d]`` holds, per leaf of level d, the feature and the last bin that goes left."""

    cuts: list = field(default_factory=list)
    values: np.ndarray | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for feature, last in self.cuts:
            if (feature == feature[0]).all() and (last == last[0]).all():
                at = 2 * at + (x[:, feature[0]] > last[0])
            else:
                at = 2 * at + (x[rows, feature[at]] > last[at])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.values[self.leaves(x)]


@dataclass
class Boosted:
    """Mean of the target, trees and their weights."""

    base: float
    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)

    def predict(self, x: np.ndarray, without: Sequence[int] = ()) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t, (tree, w) in enumerate(zip(self.trees, self.weights)):
            if t not in without:
                out += w * tree.predict(x)
        return out


def bin_edges(df: DataFrame, feats: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature, at most ``bins - 1``, from one aggregate."""
    probs = [i / bins for i in range(1, bins)]
    finite = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in feats]
    row = df.agg(*[F.percentile_approx(x, probs, 10_000).alias(f"c{i}") for i, x in enumerate(finite)]).first()
    return [np.unique(np.array(v or [], dtype=float)) for v in row]


def binned(df: DataFrame, feats: Sequence[str], y: str, fold: str, id_col: str, edges: list[np.ndarray]) -> DataFrame:
    """(id, fold, y, b0, b1, ...): bin 0 holds nulls and NaN, bin i + 1 the values with i edges below them."""
    names = [f"b{i}" for i in range(len(feats))]
    rows = df.select(F.col(id_col).alias("id"), F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"),
                     *[F.col(f).cast("double").alias(n) for f, n in zip(feats, names)]).dropna(subset=["fold", "y"])

    def place(batches):
        for b in batches:
            for n, e in zip(names, edges):
                v = b[n].to_numpy(np.float64)
                b[n] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1).astype(np.int16)
            yield b

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(place, f"id {id_type}, fold int, y double, " + ", ".join(f"{n} smallint" for n in names))


def packed(data: DataFrame, n_feats: int) -> DataFrame:
    """Rows of :func:`binned` as (fold, y, bins) byte strings, an Arrow batch each: a pass over them
    turns no row into a Python value. The bins stand feature by feature."""
    names = [f"b{i}" for i in range(n_feats)]

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"fold": [b["fold"].to_numpy(np.int32).tobytes()], "y": [b["y"].to_numpy(np.float64).tobytes()],
                                "bins": [b[names].to_numpy(np.int16).T.tobytes()]})

    return data.mapInPandas(pack, "fold binary, y binary, bins binary")


def _level(blocks: DataFrame, n_feats: int, n_bins: int, models: dict, growing: dict, without: dict, l2: float,
           symmetric: bool) -> dict:
    """``{model: [(leaf, feature, last bin, n and gradient left, n and gradient right)]}`` of the next level."""
    leaves = 1 << len(next(iter(growing.values())).cuts)

    def sums(batches):
        acc = {k: np.zeros((2, leaves, n_feats, n_bins)) for k in models}
        for b in batches:
            for fold, y, bins in zip(b["fold"], b["y"], b["bins"]):
                own, y = np.frombuffer(fold, np.int32), np.frombuffer(y)
                x = np.frombuffer(bins, np.int16).reshape(n_feats, -1)
                for k, m in models.items():
                    use = own != k
                    xk = x[:, use]
                    g = y[use] - m.predict(xk.T, without[k])
                    at = growing[k].leaves(xk.T) * n_bins
                    for j in range(n_feats):
                        cell = at + xk[j]
                        acc[k][0, :, j] += np.bincount(cell, minlength=leaves * n_bins).reshape(leaves, n_bins)
                        acc[k][1, :, j] += np.bincount(cell, weights=g, minlength=leaves * n_bins).reshape(leaves, n_bins)
        leaf, feature, last = (v.ravel() for v in np.indices((leaves, n_feats, n_bins)))
        for k, (n, g) in acc.items():
            yield pd.DataFrame({"model": k, "leaf": leaf, "feature": feature, "last": last, "n": n.ravel(), "g": g.ravel()})

    hist = (blocks.mapInPandas(sums, "model int, leaf int, feature int, last int, n double, g double")
            .groupBy("model", "leaf", "feature", "last").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    along = Window.partitionBy("model", "leaf", "feature")   # n_bins rows each
    run = along.orderBy("last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = hist.select("model", "leaf", "feature", "last", F.sum("n").over(run).alias("nl"), F.sum("g").over(run).alias("gl"),
                        F.sum("n").over(along).alias("n"), F.sum("g").over(along).alias("g"))
    sides = sides.withColumn("nr", F.col("n") - F.col("nl")).withColumn("gr", F.col("g") - F.col("gl"))

    def gain(n: str, g: str):
        return F.coalesce(F.try_divide(F.col(g) * F.col(g), F.col(n) + F.lit(float(l2))), F.lit(0.0))

    key = ["model"] if symmetric else ["model", "leaf"]
    per_cut = sides.groupBy(*dict.fromkeys([*key, "feature", "last"])).agg(
        F.sum(gain("nl", "gl") + gain("nr", "gr")).alias("gain"),
        F.collect_list(F.struct("leaf", "nl", "gl", "nr", "gr")).alias("leaves"))   # one entry a leaf of the level
    # gains that differ by rounding only are ties, which go to the smallest feature and bin
    order = F.struct(F.round("gain", 9), -F.col("feature"), -F.col("last"))
    rows = per_cut.groupBy(*key).agg(F.max_by(F.struct("feature", "last", "leaves"), order).alias("best")).collect()
    out: dict = {k: [] for k in models}
    for r in rows:
        b = r["best"]
        out[r["model"]] += [(v["leaf"], b["feature"], b["last"], v["nl"], v["gl"], v["nr"], v["gr"]) for v in b["leaves"]]
    return {k: sorted(v) for k, v in out.items()}


def boost(data: DataFrame, n_feats: int, n_bins: int, rounds: int, depth: int, step: float = 0.3, l2: float = 1.0,
          symmetric: bool = True, drop: float = 0.0, seed: int = 42) -> dict:
    """``{fold: Boosted}`` of :func:`binned` rows, each fitted to all rows of the other folds.

    ``symmetric`` takes one cut for all leaves of a level, else each leaf has its own. With
    ``drop`` every earlier tree is left out of a round with that probability (seeded); the new
    tree then weighs ``step / (1 + k)`` and the k trees left out are scaled by ``k / (1 + k)``.
    """
    stats = {r["fold"]: (r["n"], r["s"]) for r in
             data.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}   # the k folds
    n, s = (sum(v[i] for v in stats.values()) for i in (0, 1))
    models = {k: Boosted((s - b) / (n - a) if n > a else 0.0) for k, (a, b) in stats.items()}
    if not models:
        return models
    blocks = written(packed(data, n_feats), "packed")
    rng = {k: np.random.default_rng([seed, i]) for i, k in enumerate(sorted(models))}
    for _ in range(rounds):
        without = {k: [t for t in range(len(m.trees)) if rng[k].random() < drop] for k, m in models.items()}
        growing = {k: Tree() for k in models}
        for _ in range(depth):
            found = _level(blocks, n_feats, n_bins, models, growing, without, l2, symmetric)
            for k, cuts in found.items():
                growing[k].cuts.append((np.array([c[1] for c in cuts]), np.array([c[2] for c in cuts])))
                growing[k].values = np.array([g / (m + l2) if m + l2 > 0 else 0.0
                                              for *_, nl, gl, nr, gr in cuts for m, g in ((nl, gl), (nr, gr))])
        for k, m in models.items():
            out = len(without[k])
            for t in without[k]:
                m.weights[t] *= out / (1 + out)
            m.trees.append(growing[k])
            m.weights.append(step / (1 + out))
    return models


def boosted_oof(df: DataFrame, feats: Sequence[str], y: str, fold: str, id_col: str = "id", rounds: int = 8,
                depth: int = 4, bins: int = 32, **how) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions ``(id, fold, y, pred)`` of boosted trees, and the models by fold.

    Each row is predicted by the model that did not see its fold. Rows without a target or fold
    are left out; an empty table gives no rows. ``how`` goes to :func:`boost`.
    """
    edges = bin_edges(df, feats, bins)
    data = written(binned(df, feats, y, fold, id_col, edges), "binned")
    models = boost(data, len(feats), bins + 1, rounds, depth, **how)
    names = [f"b{i}" for i in range(len(feats))]

    def predict(batches):
        for b in batches:
            x, own = b[names].to_numpy(np.int64), b["fold"].to_numpy()
            pred = np.zeros(len(b))
            for k, m in models.items():
                pred[own == k] = m.predict(x[own == k])
            yield b[["id", "fold", "y"]].assign(pred=pred)

    id_type = data.schema["id"].dataType.simpleString()
    oof = data.mapInPandas(predict, f"id {id_type}, fold int, y double, pred double")
    return oof.select(F.col("id").alias(id_col), F.col("fold").alias(fold), F.col("y").alias(y), "pred"), models
