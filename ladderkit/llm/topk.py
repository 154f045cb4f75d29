"""Exact top-k inner products: tiled matrix products, partial selection, merging of top lists.

Queries and candidates are packed into tiles (matrices of bounded size). Every query tile
meets every candidate tile through an equi-join on a salt: each candidate tile carries one
salt, each query tile is copied once per salt, so the work is dealt evenly over all tasks and
nothing is broadcast. A tile pair is one matrix product; ``numpy`` selects each query's best
``k`` of the tile, and the lists are merged pair by pair inside a task and then in groups of
sixteen over the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash

QUERY_TILE = 1024
BASE_TILE = 4096
FAN_IN = 16
_TILE = "dim int, n int, ids binary, width int, mat binary"


def quantise(vectors: DataFrame, vec: str, scale: int = 1024) -> DataFrame:
    """``vec`` as floor(scale * x) in 64-bit integers; rows whose vector is null or holds a
    null or non-finite component go."""
    x = F.col(vec)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return (vectors.filter(x.isNotNull() & F.coalesce(ok, F.lit(False)))
            .withColumn(vec, F.transform(x, lambda v: F.floor(v.cast("double") * scale))))


def _narrow(mat: np.ndarray) -> np.ndarray:
    top = int(np.abs(mat).max(initial=0)) if mat.size else 0
    return mat.astype(np.int16 if top < 2 ** 15 else np.int32 if top < 2 ** 31 else np.int64)


def _pack(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def tile(dim, rows):
            ids = np.array([r[0] for r in rows], np.int64)
            mat = _narrow(np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim))
            return pd.DataFrame([(dim, len(rows), ids.tobytes(), mat.dtype.itemsize, mat.tobytes())],
                                columns=["dim", "n", "ids", "width", "mat"])

        for b in batches:
            for i, v in zip(b["id"], b["v"]):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield tile(len(v), held.pop(len(v)))
        for dim, rows in held.items():
            yield tile(dim, rows)
    return run


def _matrix(ids, n, dim, width, mat):
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[width]
    return np.frombuffer(ids, np.int64), np.frombuffer(mat, kind).reshape(n, dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while every partial sum is exact, else in int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2 ** 53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def select_top(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int):
    """(query index, id, score) of each query's best ``k`` in a tile, best first, ties to the
    smaller id; a query never meets its own id."""
    low = np.iinfo(np.int64).min
    own = q_ids[:, None] == c_ids[None, :]
    s = np.where(own, low, scores)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        qi, ci = np.nonzero((s >= kth[:, None]) & ~own)
    else:
        qi, ci = np.nonzero(~own)
    return _best(qi, c_ids[ci], s[qi, ci], k)


def _best(qi, ids, scores, k):
    order = np.lexsort((ids, -scores, qi))
    qi, ids, scores = qi[order], ids[order], scores[order]
    first = np.searchsorted(qi, qi, side="left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], ids[keep], scores[keep]


def _join_tiles(k: int, flush: int = 64):
    def emit(held):
        for (q_ids, salt, top) in held.values():
            qi, ids, scores = top
            cut = np.searchsorted(qi, np.arange(len(q_ids) + 1))
            rows = [(int(q_ids[i]), int(salt), ids[a:b].tolist(), scores[a:b].tolist())
                    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            yield pd.DataFrame(rows, columns=["query_id", "part", "ids", "scores"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for r in b.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_n, r.dim, r.q_width, r.q_mat)
                c_ids, c = _matrix(r.ids, r.n, r.dim, r.width, r.mat)
                top = select_top(_products(q, c), q_ids, c_ids, k)
                key = (r.dim, r.salt, r.q_ids)
                if key in held:
                    old = held[key][2]
                    top = _best(*(np.concatenate(x) for x in zip(old, top)), k)
                held[key] = (q_ids, r.salt, top)
                if len(held) >= flush:
                    yield from emit(held)
                    held = {}
        yield from emit(held)
    return run


def topk(queries: DataFrame, base: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products.

    Both sides hold integer vectors (see :func:`quantise`). Vectors only meet vectors of the
    same length; a query skips candidates of its own id; ties go to the smaller id; fewer than
    ``k`` candidates give fewer rows. Rows with a null id take no part, repeated query ids
    count once (least vector), repeated candidates count each. Products are exact up to int64.
    """
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    q = (queries.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
         .agg(F.min(vec).alias("v")))
    q = stash(q, "topk-queries")
    tiles = max(1, -(-q.count() // QUERY_TILE))
    q = q.repartition(tiles).mapInPandas(_pack(QUERY_TILE), _TILE)
    c = (base.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
         .mapInPandas(_pack(BASE_TILE), _TILE)
         .withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")))
    q = (q.select("dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"),
                  F.col("mat").alias("q_mat"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")))
    lists = c.join(q, ["dim", "salt"]).mapInPandas(
        _join_tiles(k), "query_id long, part int, ids array<bigint>, scores array<bigint>")
    lists = lists.select("query_id", "part", F.transform(
        F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i"))).alias("top"))

    def merge(col: str) -> Column:
        return F.slice(F.array_sort(F.flatten(F.collect_list(col))), 1, k)

    width = parts
    while width > 1:
        width = -(-width // FAN_IN)
        lists = (lists.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part"))
                 .agg(merge("top").alias("top")))
    lists = lists.groupBy("query_id").agg(merge("top").alias("top"))
    return (lists.select("query_id", F.posexplode("top").alias("rank", "t"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                    F.col("t.i").alias("vec_id"), (-F.col("t.s")).alias("score")))
