"""Spark ML's boosted regression trees for several settings at once.

``GBTRegressor`` fits one setting at a time: it keeps an object a row and goes over all rows for
every level of every tree. Here the rows of a fold are binned once, packed into byte strings of
``BLOCK`` rows, and one pass a level adds up the histograms of all settings. Only these sums (a
few numbers a node, feature and bin) reach the driver, which chooses the cuts.

The trees are those of Spark ML: the same sample for the bin edges, the same rows left out of
each tree (both are drawn by the position of a row in its partition), the same gains and ties.
Beyond ``APART`` partitions, or where several tasks read one, sums are added in another order, so
values may differ by rounding there, and cuts of equal gain with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

BLOCK = 1 << 15        # rows of a block, which fit a core's cache
MERGE = 64             # tasks whose sums go straight to the driver; beyond it they are added up in between
APART = 16             # partitions whose sums go apart to the driver, which adds them in Spark ML's order
EPSILON = 2.0 ** -52   # a child with less impurity is not cut


# Random numbers of Spark and Java ----------------------------------------------------
def _hash_seed(seed: int) -> int:
    """``XORShiftRandom.hashSeed``: two MurmurHash3 rounds over the eight bytes of the seed."""
    m = 0xFFFFFFFF

    def murmur(h: int) -> int:
        data = (seed & (1 << 64) - 1).to_bytes(8, "big")
        for i in (0, 4):
            k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & m
            h ^= ((k << 15 | k >> 17) & m) * 0x1B873593 & m
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return h ^ h >> 16

    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << np.uint64(21))
    s ^= s >> np.uint64(35)
    return s ^ (s << np.uint64(4))


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Product of a 64 x 64 bit matrix (its columns as integers) and each vector of bits."""
    out = np.zeros_like(v)
    for b in range(64):
        out ^= (v >> np.uint64(b) & np.uint64(1)) * matrix[b]
    return out


@cache
def _jump(j: int) -> np.ndarray:
    """Bit matrix of ``2 ** j`` steps of the generator."""
    if j == 0:
        return _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    return _times(_jump(j - 1), _jump(j - 1))


LANE = 7   # a lane gives 2 ** LANE numbers, one after the other


def uniforms(seeds: Sequence[int], start: int, n: int) -> np.ndarray:
    """``nextDouble`` number ``start`` to ``start + n - 1`` of an ``XORShiftRandom`` of each seed, a row a seed."""
    lanes = np.array([_hash_seed(s) for s in seeds], dtype=np.uint64)[:, None]
    for j in range((2 * start).bit_length()):
        if 2 * start >> j & 1:
            lanes = _times(_jump(j), lanes)
    need = max(1, -(-n >> LANE))
    j = LANE + 1   # two steps a number
    while lanes.shape[1] < need:
        lanes = np.concatenate([lanes, _times(_jump(j), lanes)], axis=1)
        j += 1
    s, out = lanes[:, :need], np.empty((len(seeds), need, 1 << LANE))
    for i in range(1 << LANE):
        high = _step(s)
        s = _step(high)
        out[:, :, i] = ((high & np.uint64((1 << 26) - 1)) << np.uint64(27)) + (s & np.uint64((1 << 27) - 1))
    return out.reshape(len(seeds), -1)[:, :n] * 2.0 ** -53


def _partition_seeds(seed: int, n: int) -> list[int]:
    """Seeds that ``RDD.sample`` gives to ``n`` partitions: ``nextLong`` of ``java.util.Random``."""
    first = (_step(np.array([_hash_seed(seed)], dtype=np.uint64))[0]) & np.uint64(0xFFFFFFFF)
    at = ((int(first) - (int(first) >> 31 << 32)) ^ 0x5DEECE66D) & (1 << 48) - 1
    out = []
    for _ in range(n):
        halves = []
        for _ in range(2):
            at = at * 0x5DEECE66D + 0xB & (1 << 48) - 1
            halves.append((at >> 16) - (at >> 47 << 32))
        out.append((halves[0] << 32) + halves[1] & (1 << 64) - 1)
    return out


def _sampled(sizes: dict[int, int], fraction: float, seed: int) -> dict[int, np.ndarray]:
    """Positions that ``RDD.sample`` takes without replacement from partitions of these sizes."""
    seeds = _partition_seeds(seed, max(sizes, default=-1) + 1)
    out = {}
    for p, n in sizes.items():
        if fraction >= 1:
            out[p] = np.arange(n)
        elif fraction > 0.4:
            out[p] = np.flatnonzero(uniforms([seeds[p]], 0, n)[0] <= fraction)
        else:   # the gaps between rows taken are drawn
            at, begun, many = np.empty(0, np.int64), 0, int(n * fraction * 1.2) + 50
            while not len(at) or at[-1] < n:
                u = np.maximum(uniforms([seeds[p]], begun, many)[0], 5e-11)
                gaps = (np.log(u) / np.log1p(-fraction)).astype(np.int64) + 1
                at = np.concatenate([at, (at[-1] if len(at) else -1) + np.cumsum(gaps)])
                begun += many
            out[p] = at[at < n]
    return out


def _edges(values: np.ndarray, n_bins: int, expected: float) -> np.ndarray:
    """Cuts of a feature by Spark ML's rule, from its sampled values; ``expected`` is the size that the
    sample was to have. Zeros are counted as what is missing from it."""
    v, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(v):
        return np.empty(0)
    counts, given = counts.astype(float), float(counts.sum())
    if expected - given > EPSILON * given * 100:
        at = int(np.searchsorted(v, 0.0))
        v, counts = np.insert(v, at, 0.0), np.insert(counts, at, expected - given)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= n_bins - 1:
        return middle
    stride, out = expected / n_bins, []
    target, run = stride, np.cumsum(counts)
    for i in range(1, len(v)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _places(edges: np.ndarray) -> np.ndarray:
    """Where Java's binary search finds each edge: of equal edges (means of neighbouring numbers) any may be met."""
    out = np.zeros(len(edges), np.int64)
    for i, key in enumerate(edges):
        low, high = 0, len(edges) - 1
        while edges[mid := (low + high) // 2] != key:
            low, high = (mid + 1, high) if edges[mid] < key else (low, mid - 1)
        out[i] = mid
    return out


def _bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value: the first edge not below it, or the equal edge that Java's search meets."""
    if not len(edges):
        return np.zeros(len(values), np.uint8)
    at = np.searchsorted(edges, values, side="left")
    near = np.minimum(at, len(edges) - 1)
    return np.where(edges[near] == values, _places(edges)[near], at).astype(np.uint8)


# Trees ---------------------------------------------------------------------------------
@dataclass
class Tree:
    """``cuts[d]`` holds, per node of level d, the feature (-1: none, all rows go left) and the last bin that goes left:
    the last one of the edge's value, while the cut's sums end with the edge's own bin (equal edges are apart there)."""

    cuts: list = field(default_factory=list)
    values: np.ndarray | None = None
    tables: tuple | None = field(default=None, repr=False)

    def _tables(self) -> tuple[int, dict]:
        """Leaves as bits of a number: those that are met at all and, per feature cut on, those that each bin leaves over."""
        n = 1 << len(self.cuts)
        some, by_feature, below = (1 << n) - 1, {}, n
        for feature, last in self.cuts:
            below >>= 1
            for i, (f, b) in enumerate(zip(feature, last)):
                left = (1 << below) - 1 << 2 * i * below
                if f < 0:
                    some &= ~(left << below)
                else:
                    table = by_feature.setdefault(int(f), np.full(256, (1 << n) - 1, np.uint64))
                    table[:int(b) + 1] &= np.uint64((1 << n) - 1 & ~(left << below))
                    table[int(b) + 1:] &= np.uint64((1 << n) - 1 & ~left)
        kind = np.uint32 if n <= 32 else np.uint64
        return some, {f: t.astype(kind) for f, t in by_feature.items()}

    def leaves(self, x: Sequence[np.ndarray]) -> np.ndarray:
        if len(self.cuts) <= 6:   # every cut strikes out the leaves behind its other side, so one is left
            if self.tables is None:
                self.tables = self._tables()
            some, tables = self.tables
            if not tables:
                return np.zeros(len(x[0]), np.uint8)
            bits = None
            for f, table in tables.items():
                found = table.take(x[f], mode="clip")
                bits = found & found.dtype.type(some) if bits is None else np.bitwise_and(bits, found, out=bits)
            return np.bitwise_count(bits - 1)
        at = np.zeros(len(x[0]), np.uint8)
        for feature, last in self.cuts:
            right = np.zeros(len(at), bool)
            for i, (f, b) in enumerate(zip(feature, last)):
                if f >= 0:
                    right |= (x[f] > b) & (at == i) if len(feature) > 1 else x[f] > b
            at <<= 1
            at |= right.view(np.uint8)
        return at


@dataclass
class Boosted:
    """Trees, the first with weight 1 and the others with weight ``step``."""

    step: float
    trees: list = field(default_factory=list)

    def predict(self, x: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(x[0]))
        for t, tree in enumerate(self.trees):
            out += (tree.values if t == 0 else tree.values * self.step).take(tree.leaves(x), mode="clip")
        return out


class Growing(Tree):
    """A tree of which the nodes of the lowest level wait for their sums (rows, labels, squares)."""

    def __init__(self, depth: int):
        super().__init__([], None)
        self.depth = depth
        self.sums: np.ndarray | None = None    # (3, nodes); of the root when its histogram is there
        self.open = np.ones(1, bool)           # nodes to cut

    @staticmethod
    def _impurity(n, s, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, (q - s * s / n) / n, 0.0)

    def grow(self, hist: np.ndarray, edges: list[np.ndarray]) -> None:
        """One level by Spark ML's rule: the first cut of the greatest gain, if that is above zero."""
        n_splits = np.array([len(e) for e in edges])
        run = hist.cumsum(axis=-1)                         # (3, nodes, features, bins)
        left, right = run, run[..., -1:] - run
        allowed = np.arange(hist.shape[-1]) < n_splits[:, None]
        if self.sums is None:
            f = int(np.argmax(n_splits > 0))
            self.sums = (left + right)[:, :, f, 0] if n_splits[f] else run[:, :, 0, -1]
        (ln, *_), (rn, *_) = left, right
        with np.errstate(divide="ignore", invalid="ignore"):
            both = ln + rn
            gain = (self._impurity(*self.sums)[:, None, None] - ln / both * self._impurity(*left)
                    - rn / both * self._impurity(*right))
        gain = np.where(allowed & (ln >= 1) & (rn >= 1) & (gain > 0), gain, -np.inf).reshape(hist.shape[1], -1)
        best, nodes = gain.argmax(axis=1), np.arange(hist.shape[1])
        cut = self.open & (gain[nodes, best] > 0)
        f, b = np.divmod(best, hist.shape[-1])
        last = [np.searchsorted(edges[i], edges[i][j], side="right") - 1 if c else 0 for i, j, c in zip(f, b, cut)]
        self.cuts.append((np.where(cut, f, -1), np.array(last, np.uint8)))
        self.tables = None
        to_left = np.where(cut, left[:, nodes, f, b], self.sums)
        to_right = np.where(cut, right[:, nodes, f, b], 0.0)
        self.sums = np.stack([to_left, to_right], axis=-1).reshape(3, -1)
        self.open = np.repeat(cut, 2) & (np.abs(self._impurity(*self.sums)) >= EPSILON)
        n, s, _ = self.sums
        self.values = np.divide(s, n, out=np.zeros_like(s), where=n > 0)

    @property
    def done(self) -> bool:
        return len(self.cuts) == self.depth or not self.open.any()


# Rows ------------------------------------------------------------------------------------
def fits(learners: Sequence) -> bool:
    """Whether :class:`FoldBlocks` can stand in for the learners: boosted trees under squared error that differ in
    depth, step and rounds only and have no other limits."""
    def plain(e):
        return (isinstance(e, GBTRegressor) and e.getLossType() == "squared" and e.getMaxDepth() <= 8 and e.getMaxDepth() >= 1
                and e.getMaxBins() <= 256 and e.getMinInstancesPerNode() == 1 and e.getMinInfoGain() == 0.0
                and e.getMinWeightFractionPerNode() == 0.0 and e.getFeatureSubsetStrategy() == "all" and not e.getLeafCol()
                and not any(e.isSet(e.getParam(p)) for p in ("weightCol", "validationIndicatorCol")))

    return (len(learners) > 0 and all(plain(e) for e in learners)
            and len({(e.getSeed(), e.getSubsamplingRate(), e.getMaxBins()) for e in learners}) == 1)


class FoldBlocks:
    """Rows under folds, written once in blocks: a partition's rows in their order, feature by feature.

    ``score`` fits each learner (see :func:`fits`) to all folds but one and predicts that one.
    """

    def __init__(self, df: DataFrame, feats: Sequence[str], y: str, fold: str):
        names = [f"x{i}" for i in range(len(feats))]
        rows = df.select(F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"),
                         *[F.col(f).cast("double").alias(n) for f, n in zip(feats, names)])
        self.sparkSession, self.n_feats, self.binned = df.sparkSession, len(feats), {}

        def pack(batches):
            part, at, held = TaskContext.get().partitionId(), {}, []

            def block():
                b = pd.concat(held)
                held.clear()
                numbers = b[["y", *names]].to_numpy(np.float64).T
                if b["fold"].isna().any() or not np.isfinite(numbers).all():
                    raise ValueError("boosted trees take rows with a fold, a finite target and finite features only")
                own = b["fold"].to_numpy(np.int32)
                labels, counts = np.unique(own, return_counts=True)
                out = pd.DataFrame({"part": [part], "folds": [list(at)], "before": [list(at.values())], "own": [own.tobytes()],
                                    "y": [numbers[0].tobytes()], "x": [numbers[1:].tobytes()],
                                    "labels": [labels.tolist()], "sizes": [counts.tolist()]})
                for k, c in zip(labels.tolist(), counts.tolist()):
                    at[k] = at.get(k, 0) + c
                return out

            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= BLOCK:
                    yield block()
            if sum(map(len, held)):
                yield block()

        packed = rows.mapInPandas(pack, "part int, folds array<int>, before array<long>, own binary, y binary, x binary, "
                                        "labels array<int>, sizes array<long>")
        self.blocks = written(packed, "blocks", **{"parquet.block.size": 8 << 20})   # small groups: splits of a file are even
        sizes = (self.blocks.select("part", F.explode(F.arrays_zip("labels", "sizes")).alias("z"))
                 .groupBy("part", "z.labels").agg(F.sum("z.sizes").alias("n")).collect())   # a row a partition and fold
        self.sizes = {(r["part"], r["labels"]): r["n"] for r in sizes}
        self.folds = sorted({k for _, k in self.sizes})
        self.apart = len({p for p, _ in self.sizes}) <= APART
        self.edges: dict = {}

    @staticmethod
    def _positions(row, k: int) -> tuple[np.ndarray, int]:
        """Rows of the block outside fold k, and how many such rows its partition has before it."""
        own = np.frombuffer(row.own, np.int32)
        return np.flatnonzero(own != k), sum(int(n) for f, n in zip(row.folds, row.before) if f != k)

    def _find_edges(self, seed: int, max_bins: int) -> None:
        """Bin edges of every fold's training rows, from one pass over the sampled rows of all folds."""
        taken, expected, bins = {}, {}, {}
        for k in self.folds:
            sizes: dict = {}
            for (p, f), n in self.sizes.items():
                sizes[p] = sizes.get(p, 0) + (n if f != k else 0)
            total = sum(sizes.values())
            if total == 0:
                raise ValueError("boosted trees need rows outside the fold that is held out")
            wanted = max(max_bins * max_bins, 10_000)
            fraction = wanted / total if wanted < total else 1.0
            taken[k], expected[k], bins[k] = _sampled(sizes, fraction, seed), fraction * total, min(max_bins, total)
        positions, d = self._positions, self.n_feats

        def sample(batches):
            for b in batches:
                for row in b.itertuples():
                    x = np.frombuffer(row.x).reshape(d, -1)
                    for k, at in taken.items():
                        use, before = positions(row, k)
                        lo, hi = np.searchsorted(at[row.part], [before, before + len(use)])
                        some = x[:, use[at[row.part][lo:hi] - before]]
                        yield pd.DataFrame(some.T, columns=[f"x{i}" for i in range(d)]).assign(fold=k)

        found = (self.blocks.select("part", "folds", "before", "own", "x")
                 .mapInPandas(sample, ", ".join(f"x{i} double" for i in range(d)) + ", fold int").toPandas())   # a sample of fixed size
        for k in self.folds:
            some = found[found["fold"] == k]
            self.edges[k] = [_edges(some[f"x{i}"].to_numpy(), bins[k], expected[k]) for i in range(d)]

    def _training(self, k: int, seed: int, rate: float, rounds: int) -> DataFrame:
        """Binned blocks for fold k held out: its own rows apart from the others, which carry a bit a round that
        says whether the round's tree is fitted to them."""
        positions, edges = self._positions, self.edges[k]

        def place(batches):
            for b in batches:
                for row in b.itertuples():
                    use, before = positions(row, k)
                    y = np.frombuffer(row.y)
                    x = np.stack([_bins(v, e) for v, e in zip(np.frombuffer(row.x).reshape(len(edges), -1), edges)])
                    if rate < 1:
                        bag = uniforms([seed + m + row.part + 1 for m in range(rounds)], before, len(use)) < rate
                    else:
                        bag = np.ones((rounds, len(use)), bool)
                    rest = np.ones(len(y), bool)
                    rest[use] = False
                    out = [(False, y[use], x[:, use], np.packbits(bag, axis=1)), (True, y[rest], x[:, rest], np.empty(0))]
                    yield pd.DataFrame([(row.part, held, len(v), v.tobytes(), z.tobytes(), g.tobytes()) for held, v, z, g in out if len(v)],
                                       columns=["part", "held", "n", "y", "x", "bag"])

        return (self.blocks.select("part", "folds", "before", "own", "y", "x")
                .mapInPandas(place, "part int, held boolean, n int, y binary, x binary, bag binary").persist(StorageLevel.DISK_ONLY))

    def _histograms(self, rows: DataFrame, many: bool, round_: int, models: dict, growing: dict, n_bins: int) -> dict:
        """``{learner: (3, nodes, features, bins)}``: number, sum and squares of the labels of the round's rows.
        Each partition is added up row by row, as by Spark ML, since cuts of equal gain are told apart by rounding;
        beyond ``APART`` partitions a task adds up all its own, so what the driver gets grows with the tasks only."""
        d = self.n_feats
        nodes, apart = {t: len(g.open) for t, g in growing.items()}, self.apart

        def sums(batches):
            part, acc = None, {}

            def row():
                return pd.DataFrame({"part": part, "learner": list(acc), "sums": [a.tobytes() for a in acc.values()]})

            for b in batches:
                for p, n, y, x, bag in zip(b["part"], b["n"], b["y"], b["x"], b["bag"]):
                    if not acc or (apart and p != part):
                        if acc:
                            yield row()
                        part, acc = p, {t: np.zeros((3, d, m * n_bins)) for t, m in nodes.items()}
                    bits = np.frombuffer(bag, np.uint8).reshape(-1, -(-n // 8))[round_]
                    use = np.flatnonzero(np.unpackbits(bits, count=n))
                    y, x = np.frombuffer(y)[use], [v[use] for v in np.frombuffer(x, np.uint8).reshape(d, -1)]
                    for t, tree in growing.items():
                        size = nodes[t] * n_bins
                        cell, g, gg = np.empty(size + len(y), np.intp), np.empty(size + len(y)), np.empty(size + len(y))
                        cell[:size] = np.arange(size)   # the sums so far come first: rows are added one by one, block or not
                        g[size:] = 2.0 * (y - models[t].predict(x)) if round_ else y
                        np.multiply(g[size:], g[size:], out=gg[size:])
                        at = tree.leaves(x).astype(np.intp) * n_bins
                        for j in range(d):
                            np.add(at, x[j], out=cell[size:])
                            acc[t][0, j] += np.bincount(cell[size:], minlength=size)
                            g[:size], gg[:size] = acc[t][1, j], acc[t][2, j]
                            acc[t][1, j], acc[t][2, j] = np.bincount(cell, g, size), np.bincount(cell, gg, size)
            if acc:
                yield row()

        def shaped(r):
            return np.frombuffer(r["sums"]).reshape(3, d, nodes[r["learner"]], n_bins).swapaxes(1, 2)

        parts = rows.select("part", "n", "y", "x", "bag").mapInPandas(sums, "part int, learner int, sums binary")
        if many:
            return parts.rdd.map(lambda r: {r["learner"]: shaped(r)}).treeReduce(
                lambda a, b: {t: a[t] + b[t] if t in a and t in b else a.get(t, b.get(t)) for t in {**a, **b}})
        out: dict = {}
        for r in sorted(parts.collect(), key=lambda r: r["part"]):   # a row a task (or one of few partitions) and learner
            out[r["learner"]] = out[r["learner"]] + shaped(r) if r["learner"] in out else shaped(r)
        return out

    def score(self, k: int, learners: dict) -> DataFrame:
        """Rows ``(y, p<t>...)`` of fold k, predicted by each learner ``{t: GBTRegressor}`` fitted to the other folds."""
        any_ = next(iter(learners.values()))
        if not self.edges:
            self._find_edges(any_.getSeed(), any_.getMaxBins())
        edges = self.edges[k]
        n_bins = max(map(len, edges)) + 1
        rounds = max(e.getMaxIter() for e in learners.values())
        models = {t: Boosted(e.getStepSize()) for t, e in learners.items()}
        data = self._training(k, any_.getSeed(), any_.getSubsamplingRate(), rounds)
        try:
            rows = data.filter("not held")
            many = rows.rdd.getNumPartitions() > MERGE
            for m in range(rounds):
                trees = {t: Growing(e.getMaxDepth()) for t, e in learners.items() if m < e.getMaxIter()}
                while growing := {t: g for t, g in trees.items() if not g.done}:
                    one = next(iter(growing))   # the first trees of all learners have the same cuts as far as they reach
                    found = self._histograms(rows, many, m, models, growing if m else {one: growing[one]}, n_bins)
                    for t, g in growing.items():
                        g.grow(found[t if m else one], edges)
                for t, g in trees.items():
                    models[t].trees.append(Tree(g.cuts, g.values))
            d = self.n_feats

            def predict(batches):
                for b in batches:
                    for y, x in zip(b["y"], b["x"]):
                        x = list(np.frombuffer(x, np.uint8).reshape(d, -1))
                        yield pd.DataFrame({"y": np.frombuffer(y), **{f"p{t}": m.predict(x) for t, m in models.items()}})

            schema = "y double, " + ", ".join(f"p{t} double" for t in models)
            return written(data.filter("held").select("y", "x").mapInPandas(predict, schema), "oof")
        finally:
            data.unpersist()
