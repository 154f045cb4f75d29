"""Exact k-nearest-neighbour join without a cross join.

Plan (all distributed, no pair set is ever materialised):

1. A two-level pivot tree that grows with the base rows: one leaf pivot for every ``LEAF_ROWS`` rows
   (those with the smallest ``hash01(id)``), at most as many as fit in ``PIVOT_BYTES``; the first
   square root of them are the tops, every pivot hangs below its nearest top. A row looks at the
   tops, then at one top's leaves: about twice the square root of the leaves, not all of them.
2. One pass gives each base row its leaf; vectors travel along, nothing is joined back. Leaves and
   tops keep their row counts and radii (largest distance of a member).
3. Phase 1: each probe searches its nearest leaves until they hold ``k`` rows; the k-th distance
   found is an upper bound ``tau`` on its true k-th distance.
4. Phase 2: by the triangle inequality a top or leaf can hold a closer point only if
   ``d(q, pivot) - radius <= tau``; only such leaves not searched yet are probed.
5. A leaf's base rows and probes are salted into chunks of at most ``CHUNK_BYTES`` of vectors, so a
   hot leaf is split and a chunk is seldom copied. A cogrouped ``applyInPandas`` goes over a pair of
   chunks in tiles: ``|q|^2 + |b|^2 - 2 q.b`` in at most ``TILE_BYTES`` of distances, whose candidates
   (rounding error allowed for) get exact distances before they are ranked. Each pair of chunks
   emits its top-k per probe; a final per-probe top-k merges.

Ties are broken by ``(distance, base_id)``. Rows with a null vector take no part. ``exact=False``
searches the nearest leaf only (approximate, bounded work); ``n_pivots`` asks for one level of so
many pivots in place of the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash01, hash_u32, lit_d

LEAF_ROWS = 256
MIN_LEAVES = 16
PIVOT_BYTES = 1 << 24
CHUNK_BYTES = 1 << 25
TILE_BYTES = 1 << 23
PROBE_TILE = 256

_PAIR_SCHEMA = "probe_id long, base_id long, dist double"


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in y], axis=1)) if len(y) else np.zeros((len(x), 0))


@dataclass
class Tree:
    """Leaf pivots ordered by top: top ``t`` has the leaves ``first[t]`` to ``first[t + 1] - 1``."""
    tops: np.ndarray
    leaves: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, n_tops: int) -> Tree:
        tops = pivots[:n_tops]
        near = _distances(pivots, tops).argmin(axis=1)
        near[:n_tops] = np.arange(n_tops)       # a top is its own leaf, also beside an equal one
        order = np.argsort(near, kind="stable")
        return cls(tops, pivots[order], np.searchsorted(near[order], np.arange(n_tops + 1)))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to its top) of each row: nearest top, then its nearest leaf."""
        to_top = _distances(x, self.tops)
        top = to_top.argmin(axis=1)
        leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            d = _distances(x[at], self.leaves[self.first[t]:self.first[t + 1]])
            leaf[at] = self.first[t] + d.argmin(axis=1)
            dist[at] = d.min(axis=1)
        return leaf, dist, to_top[np.arange(len(x)), top]

    def top_of(self) -> np.ndarray:
        return np.searchsorted(self.first, np.arange(len(self.leaves)), "right") - 1


def _tree(base: DataFrame, n_pivots: int | None) -> tuple[Tree | None, int]:
    """The tree of (_bid, _bv) rows and their number; the pivots' bytes are bounded."""
    shape = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_bv")).alias("d")).first()
    if not shape["n"] or not shape["d"]:
        return None, 0
    most = max(1, PIVOT_BYTES // (8 * shape["d"]))
    count = min(most, n_pivots or max(MIN_LEAVES, math.ceil(shape["n"] / LEAF_ROWS)))
    rows = (base.withColumn("_h", hash01("_bid", 7)).orderBy("_h", "_bid").limit(count).select("_bv").collect())
    pivots = np.array([r["_bv"] for r in rows], np.float64)
    return Tree.of(pivots, len(pivots) if n_pivots else math.isqrt(max(0, len(pivots) - 1)) + 1), shape["n"]


@dataclass
class _Base:
    """Base rows of a task: vectors, ids, and the vectors about their centre beside their squared lengths."""
    rows: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    about: np.ndarray

    @classmethod
    def of(cls, b: np.ndarray, bid: np.ndarray) -> _Base:
        centre = b.mean(axis=0)          # near the data the terms are small, and so is their rounding
        about = np.empty((len(b), b.shape[1] + 1))
        np.subtract(b, centre, out=about[:, :-1])
        np.einsum("ij,ij->i", about[:, :-1], about[:, :-1], out=about[:, -1])
        return cls(b, bid, centre, about)


def _slack(dim: int, sq: np.ndarray, most: float) -> np.ndarray:
    """What |q|^2 + |b|^2 - 2 q.b may be off by."""
    return 8 * (dim + 4) * np.finfo(float).eps * (sq + most)


def _tile_topk(q: np.ndarray, pid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(probe_id, base_id, dist): the k nearest of ``b`` for each row of ``q``."""
    return _nearest(q, pid, _Base.of(b, bid), k)


def _nearest(q: np.ndarray, pid: np.ndarray, base: _Base, k: int, tau: np.ndarray | None = None,
             at: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(probe_id, base_id, dist): the k nearest of ``base`` for each row of ``q``, by exact distances.
    ``tau`` bounds the distances that are wanted, ``at`` names the base rows to look at.

    Distances are made in tiles of at most ``TILE_BYTES``; |q|^2 + |b|^2 - 2 q.b may be off by a
    few roundings of its terms, so all rows within that of the k-th are kept and ranked again."""
    out = []
    dim = q.shape[1]
    total = len(base.rows) if at is None else len(at)
    # at most half the bytes a side of the tile, for its vectors as for its distances
    n_b = max(1, min(total, TILE_BYTES // (16 * max(dim, 1)), 1 << 12))
    n_q = max(1, min(len(q), TILE_BYTES // (16 * n_b)))
    step = max(1, TILE_BYTES // (16 * max(dim, 1)))
    for lo in range(0, len(q), n_q):
        part = q[lo:lo + n_q]
        turned = np.empty((len(part), dim + 1))
        np.subtract(part, base.centre, out=turned[:, :-1])
        q_sq = (turned[:, :-1] ** 2).sum(axis=1)
        turned[:, :-1] *= -2
        turned[:, -1] = 1
        bound = np.full(len(part), np.inf) if tau is None else np.where(np.isnan(tau[lo:lo + n_q]), np.inf, tau[lo:lo + n_q])
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        more, waiting = [], 0
        for i in range(0, total, n_b):
            some = slice(i, i + n_b) if at is None else at[i:i + n_b]
            about = base.about[some]
            near = turned @ about.T          # less |q|^2
            slack = 2 * _slack(dim, q_sq, about[:, -1].max())
            cut = bound ** 2 * (1 + 1e-12) - q_sq
            if near.shape[1] > k and np.isinf(bound).any():
                cut = np.minimum(cut, np.partition(near, k - 1, axis=1)[:, k - 1])
            rows, cols = np.nonzero(near <= (cut + slack)[:, None])
            tile = base.rows[some]
            dist = np.empty(len(rows))
            for s in range(0, len(rows), step):
                dist[s:s + step] = ((part[rows[s:s + step]] - tile[cols[s:s + step]]) ** 2).sum(axis=1)
            more.append((rows, base.ids[some][cols], np.sqrt(dist)))
            waiting += len(rows)
            if waiting > 2 * k * len(part) or i + n_b >= total:
                rows, ids, dist = (np.concatenate(c) for c in zip(best, *more))
                order = np.lexsort((ids, dist, rows))
                rows = rows[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                best = tuple(v[rank < k] for v in (rows, ids[order], dist[order]))
                last = rank == k - 1
                bound[rows[last]] = np.minimum(bound[rows[last]], dist[order][last])
                more, waiting = [], 0
        out.append((pid[lo + best[0]], best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _below(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to the pivots, less what their rounding may add."""
    centre = pivots.mean(axis=0)
    xc, pc = x - centre, pivots - centre
    x_sq, p_sq = (xc ** 2).sum(axis=1), (pc ** 2).sum(axis=1)
    sq = xc @ (-2 * pc.T)
    sq += p_sq
    sq += (x_sq - _slack(x.shape[1], x_sq, p_sq.max()))[:, None]
    return np.sqrt(np.maximum(sq, 0, out=sq), out=sq)


def _reach(tau: np.ndarray) -> np.ndarray:
    """How near a ball must come, with room for rounding; anything where no k rows are known."""
    return np.where(np.isnan(tau), np.inf, tau * (1 + 1e-9) + 1e-12)


def _block_topk(tree: Tree, radius: np.ndarray, k: int):
    """Top-k of a block's probes: the probes go through it in tiles of neighbours, each over the leaves
    whose ball reaches within ``tau`` of one of them."""
    def fn(probes: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        if probes.num_rows and base.num_rows:
            b, leaf, bid = _matrix(base["_bv"].combine_chunks()), base["part"].to_numpy(), base["_bid"].to_numpy()
            kept = np.flatnonzero(np.isfinite(b).all(axis=1))
            order = kept[np.argsort(leaf[kept], kind="stable")]
            held, leaf = _Base.of(b[order], bid[order]) if len(order) else None, leaf[order]
            here, size = np.unique(leaf, return_counts=True)
            del b
            q, pid, tau = _matrix(probes["_qv"].combine_chunks()), probes["_pid"].to_numpy(), probes["tau"].to_numpy()
            wanted = np.flatnonzero(np.isfinite(q).all(axis=1)) if len(here) else np.zeros(0, np.int64)
            pivots, r = tree.leaves[here], radius[here] * (1 + 1e-9)
            n = max(1, min(PROBE_TILE, TILE_BYTES // (16 * max(len(here), 1))))
            home = [_below(q[wanted[i:i + n]], pivots).argmin(axis=1) for i in range(0, len(wanted), n)]
            wanted = wanted[np.argsort(np.concatenate(home), kind="stable")] if home else wanted
            for i in range(0, len(wanted), n):
                rows = wanted[i:i + n]
                near = (~(_below(q[rows], pivots) - r > _reach(tau[rows])[:, None])).any(axis=0)
                if near.any():
                    at = None if near.all() else np.flatnonzero(np.repeat(near, size))
                    out.append(_nearest(q[rows], pid[rows], held, k, tau[rows], at))
        cols = [np.concatenate(c) for c in zip(*out)] or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("probe_id", "base_id", "dist"), cols)))
    return fn


def _blocks(sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Leaves ``lo`` to ``hi - 1`` of each block of ``rows`` base rows, taken in the order of the leaves;
    a leaf on a border belongs to both."""
    end = np.cumsum(sizes)
    starts = range(0, int(end[-1]), rows)
    return [(int(np.searchsorted(end, s, "right")), int(np.searchsorted(end, min(s + rows, end[-1]), "left")) + 1) for s in starts]


def _blocked_topk(probes: DataFrame, parts: DataFrame, tree: Tree, sizes: np.ndarray, radius: np.ndarray, most: int, k: int) -> DataFrame:
    """Top-k within ``tau`` of every probe (_pid, _qv, tau) in each block of leaves that it reaches; parts:
    (_bid, part, _bv). A probe is sent once a block, however many of its leaves it needs, and a block
    of at most ``2 * most`` rows once a chunk of ``most`` probes."""
    spark = probes.sparkSession
    blocks = _blocks(sizes, 2 * most)

    def places(batches):
        for b in batches:
            x, reach = _matrix(b.column(1)), _reach(b.column(2).to_numpy(zero_copy_only=False))
            n = max(1, TILE_BYTES // (16 * len(radius)))
            need = np.zeros((len(x), len(blocks)), bool)
            for i in range(0, len(x), n):
                near = (sizes > 0) & ~(_below(x[i:i + n], tree.leaves) - radius * (1 + 1e-9) > reach[i:i + n, None])
                for j, (lo, hi) in enumerate(blocks):
                    need[i:i + n, j] = near[:, lo:hi].any(axis=1)
            for j in range(len(blocks)):
                at = pa.array(np.flatnonzero(need[:, j]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.full(len(at), j, np.int32)), b.column(1).take(at),
                                                      b.column(2).take(at)], names=["_pid", "block", "_qv", "tau"])
    q = probes.mapInArrow(places, "_pid long, block int, _qv array<double>, tau double")
    counts = {int(r["block"]): int(r["n"]) for r in q.groupBy("block").agg(F.count("*").alias("n")).collect()}   # a row a block
    if not counts:
        return spark.createDataFrame([], _PAIR_SCHEMA)
    share = math.ceil(2 * spark.sparkContext.defaultParallelism / len(counts))   # chunks that keep all cores busy
    chunks = F.broadcast(spark.createDataFrame(
        [(j, max(math.ceil(n / most), min(share, math.ceil(n / PROBE_TILE)))) for j, n in counts.items()], "block int, _Q int"))
    before = np.cumsum(sizes) - sizes
    leaves = F.broadcast(spark.createDataFrame([(p, int(before[p]), int(n)) for p, n in enumerate(sizes) if n],
                                               "part int, _from long, _n long"))   # at most one row a leaf
    b = (parts.join(leaves, "part")
         .withColumn("block", F.floor((F.col("_from") + F.floor(hash01("_bid", 11) * F.col("_n"))) / F.lit(2 * most)).cast("int"))
         .join(chunks, "block").withColumn("_pc", F.explode(F.sequence(F.lit(0), F.col("_Q") - 1))))
    q = q.join(chunks, "block").withColumn("_pc", F.pmod(hash_u32("_pid", 13), F.col("_Q")).cast("int"))
    keys = ["block", "_pc"]
    return (q.select(*keys, "_pid", "_qv", "tau").groupBy(*keys)
            .cogroup(b.select(*keys, "_bid", "part", "_bv").groupBy(*keys))
            .applyInArrow(_block_topk(tree, radius, k), _PAIR_SCHEMA))


def _group_topk(k: int):
    def fn(probes: pa.Table, base: pa.Table) -> pa.Table:
        if probes.num_rows and base.num_rows:
            cols = _tile_topk(_matrix(probes["_qv"].combine_chunks()), probes["_pid"].to_numpy(),
                              _matrix(base["_bv"].combine_chunks()), base["_bid"].to_numpy(), k)
        else:
            cols = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("probe_id", "base_id", "dist"), cols)))
    return fn


def _chunked_topk(probe_parts: DataFrame, base_parts: DataFrame, sizes: dict[int, int], most: int, k: int) -> DataFrame:
    """Top-k of every probe in each pair of chunks. probe_parts: (_pid, part, _qv); base_parts:
    (_bid, part, _bv), ``sizes`` its rows a part; ``most`` rows a chunk."""
    spark = probe_parts.sparkSession
    probes = {int(r["part"]): int(r["n"]) for r in probe_parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    plan = [(p, max(1, math.ceil(sizes[p] / most)), max(1, math.ceil(n / most))) for p, n in probes.items() if p in sizes]
    if not plan:
        return spark.createDataFrame([], _PAIR_SCHEMA)
    salts = F.broadcast(spark.createDataFrame(plan, "part int, _S int, _Q int"))  # at most one row a leaf
    b = (base_parts.join(salts, "part")
         .withColumn("_sub", F.pmod(hash_u32("_bid", 11), F.col("_S")).cast("int"))
         .withColumn("_pc", F.explode(F.sequence(F.lit(0), F.col("_Q") - 1))))
    q = (probe_parts.join(salts, "part")
         .withColumn("_pc", F.pmod(hash_u32("_pid", 13), F.col("_Q")).cast("int"))
         .withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_S") - 1))))
    keys = ["part", "_sub", "_pc"]
    return (q.select(*keys, "_pid", "_qv").groupBy(*keys)
            .cogroup(b.select(*keys, "_bid", "_bv").groupBy(*keys))
            .applyInArrow(_group_topk(k), _PAIR_SCHEMA))


def _keep_topk(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("probe_id").orderBy("dist", "base_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _with_leaf(rows: DataFrame, tree: Tree) -> DataFrame:
    """(_bid, _bv, part, d_leaf, d_top): vectors travel with their leaf."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf, d_leaf, d_top = tree.homes(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), pa.array(d_leaf), pa.array(d_top)],
                                                 names=["_bid", "_bv", "part", "d_leaf", "d_top"])
    return rows.mapInArrow(run, "_bid long, _bv array<double>, part int, d_leaf double, d_top double")


def _searched(x: np.ndarray, tree: Tree, sizes: np.ndarray, k: int, home_only: bool) -> list[np.ndarray]:
    """Leaves of phase 1 for each row: the home leaf, or the nearest leaves of the nearest tops
    until they hold k rows."""
    homes = tree.homes(x)[0]
    if home_only:
        return [np.array([h]) for h in homes]
    top_order = np.argsort(_distances(x, tree.tops), axis=1, kind="stable")
    out = []
    for i, v in enumerate(x):
        found, held = [], 0
        for t in top_order[i]:
            leaves = np.arange(tree.first[t], tree.first[t + 1])
            near = leaves[np.argsort(((tree.leaves[leaves] - v) ** 2).sum(axis=1), kind="stable")]
            enough = np.searchsorted(np.cumsum(sizes[near]) + held, k) + 1
            found.append(near[:enough])
            held += sizes[near[:enough]].sum()
            if held >= k:
                break
        out.append(np.concatenate(found))
    return out


def _probe_parts(rows: DataFrame, leaves_of) -> DataFrame:
    """(_pid, part, _qv): each row once for every leaf that ``leaves_of``(vectors) names."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = leaves_of(_matrix(b.column(1)))
            n = np.array([len(v) for v in lists])
            at = pa.array(np.repeat(np.arange(len(n)), n))
            part = np.concatenate(lists).astype(np.int32) if n.sum() else np.zeros(0, np.int32)
            for lo in range(0, len(part), 1 << 14):
                some = at.slice(lo, 1 << 14)
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), pa.array(part[lo:lo + (1 << 14)]), b.column(1).take(some)],
                                                 names=["_pid", "part", "_qv"])
    return rows.mapInArrow(run, "_pid long, part int, _qv array<double>")


def knn(probe: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding",
        n_pivots: int | None = None, block: int | None = None, exact: bool = True) -> DataFrame:
    """``(probe_id, rank, base_id, dist)`` for the k nearest base rows of every probe (Euclidean)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(base.sparkSession)

    def side(df: DataFrame, i: str, v: str) -> DataFrame:
        return (df.filter(F.col(vec).isNotNull())
                .select(F.col(id_col).cast("long").alias(i), F.col(vec).cast("array<double>").alias(v)))
    rows = side(base, "_bid", "_bv")
    tree, _ = _tree(rows, n_pivots)
    if tree is None:
        return base.sparkSession.createDataFrame([], "probe_id long, rank int, base_id long, dist double")
    parts = _with_leaf(rows, tree).checkpoint()     # used by both phases
    stats = parts.groupBy("part").agg(F.count("*").alias("n"), F.max("d_leaf").alias("r")).collect()
    sizes, radius = np.zeros(len(tree.leaves), np.int64), np.full(len(tree.leaves), -np.inf)
    for r in stats:
        p = r["part"]
        sizes[p], radius[p] = r["n"], r["r"]
    held = {int(p): int(n) for p, n in enumerate(sizes) if n}
    base_parts = parts.select("_bid", "part", "_bv")
    block = block or max(1, CHUNK_BYTES // (8 * tree.tops.shape[1]))
    home_only = not exact

    def first(x):
        return _searched(x, tree, sizes, k, home_only)
    probes = side(probe, "_pid", "_qv")
    q1 = _probe_parts(probes, first)
    phase1 = _keep_topk(_chunked_topk(q1, base_parts, held, block, k), k)
    if not exact:
        return phase1.select("probe_id", "rank", "base_id", "dist")
    phase1 = phase1.checkpoint()
    tau = phase1.groupBy(F.col("probe_id").alias("_pid")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("tau"))

    bounded = probes.join(tau, "_pid", "left").select("_pid", "_qv", "tau")
    found = _blocked_topk(bounded, base_parts, tree, sizes, radius, block, k)
    return _keep_topk(found, k).select("probe_id", "rank", "base_id", "dist")


def knn_predict(neigh: DataFrame, base_labels: DataFrame, ks, label: str = "label", id_col: str = "vec_id",
                eps: float = 1e-8) -> DataFrame:
    """Distance-weighted mean ``sum(w y) / sum(w)``, ``w = 1 / (d + eps)``, for each K in ``ks``."""
    j = neigh.join(base_labels.select(F.col(id_col).alias("base_id"), F.col(label).cast("double").alias("_y")), "base_id")
    w = lit_d(1.0) / (F.col("dist") + lit_d(eps))
    aggs = []
    for K in ks:
        inK = F.col("rank") <= K
        aggs.append((F.sum(F.when(inK, w * F.col("_y"))) / F.sum(F.when(inK, w))).alias(f"pred_k{K}"))
    return j.groupBy("probe_id").agg(*aggs)
