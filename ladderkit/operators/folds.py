"""Sampling and fold assignment (R1-R3, R5, R6), deterministic across engines and partitionings.

Randomness comes from ``hash01(id, seed)`` (md5 of ``"seed:id"``), never from
``rand()``, so a row lands in the same fold whatever the partitioning or
retry. Balanced variants need a global order; they use the dense index
(range partitioning), never a single-task window, and a per-label order for
stratification uses per-label offsets from one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash01, hash_u32
from ..session import written
from .sequence import dense_index


def holdout(df: DataFrame, id_col: str = "id", frac: float = 0.2, seed: int = 42, out: str = "is_holdout") -> DataFrame:
    """R2: Bernoulli mask ``hash01(id) < frac`` (partition-independent)."""
    return df.withColumn(out, (hash01(id_col, seed) < frac).cast("int"))


TOPN_MAX = 100_000


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement: the ``n`` rows with the smallest ``(hash, id)``.

    Up to ``TOPN_MAX`` rows this is a top-n (each task keeps n, one merge); beyond it the same
    rows are selected with the dense index (``_idx < n``), so a large sample never funnels
    through a single task.
    """
    h = df.withColumn("_h", hash01(id_col, seed))
    if n <= TOPN_MAX:
        return h.orderBy("_h", id_col).limit(n).drop("_h")
    ix, _ = dense_index(h, ["_h", id_col])
    return ix.filter(F.col("_idx") < n).drop("_h", "_idx")


def kfold(df: DataFrame, k: int, id_col: str = "id", seed: int = 42, balanced: bool = True,
          out: str = "fold") -> DataFrame:
    """Shuffled k-fold. ``balanced``: fold sizes differ by at most one (rank by hash % k, via the
    dense index); otherwise ``hash_u32 % k`` (one narrow projection)."""
    if not balanced:
        return df.withColumn(out, F.pmod(hash_u32(id_col, seed), F.lit(k)).cast("int"))
    ix, _ = dense_index(df.withColumn("_h", hash01(id_col, seed)), ["_h", id_col])
    return ix.withColumn(out, F.pmod(F.col("_idx"), F.lit(k)).cast("int")).drop("_h", "_idx")


def stratified_split(df: DataFrame, label: str, frac: float = 0.2, id_col: str = "id", seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """Per label, the ``floor(frac * n_label + 0.5)`` rows with the smallest hash go to the test
    side. Rows without a label are a label of their own."""
    ix, _ = dense_index(df.withColumn("_h", hash01(id_col, seed)), [label, "_h", id_col])
    starts = ix.groupBy(F.col(label).alias("_l")).agg(F.min("_idx").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = ix.join(starts, ix[label].eqNullSafe(starts["_l"]))
    cut = F.floor(F.lit(frac) * F.col("_n") + F.lit(0.5))
    return j.withColumn(out, ((F.col("_idx") - F.col("_s")) < cut).cast("int")).drop("_h", "_idx", "_s", "_n", "_l")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def greedy_runs(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest-first assignment to the lightest of ``k`` folds (ties: lowest fold), for whole size classes.

    ``classes`` are (size, number of groups), largest size first. Within a class the folds take
    their groups in the order of (load, fold); all loads grow by the same size, so the order
    repeats itself over the folds that have come level. The result is runs
    ``(size, first rank, end rank, fold order)``, at most ``k`` a class, over the ranks of all groups.
    """
    load, runs, rank = [0] * k, [], 0
    for size, count in classes:
        low = min(load)
        level = [(x - low) // size for x in load]
        inside = [(x - low) % size for x in load]
        steps = sorted(set(level))
        left = count
        for at, step in enumerate(steps):
            order = sorted((i for i in range(k) if level[i] <= step), key=lambda i: (inside[i], i))
            take = left if at + 1 == len(steps) else min(left, (steps[at + 1] - step) * len(order))
            if not take:
                break
            runs.append((size, rank, rank + take, order))
            for pos, i in enumerate(order):
                load[i] += size * (take // len(order) + (pos < take % len(order)))
            rank, left = rank + take, left - take
    return runs


def group_kfold(df: DataFrame, group: str, k: int, method: str = "greedy", out: str = "fold") -> DataFrame:
    """Whole groups to folds; rows without a group are one group.

    Groups are ranked by (size desc, key asc, null first) on the dense index. ``round_robin``:
    fold = rank % k. ``greedy``: largest group first to the lightest fold (ties: lowest fold),
    the usual balanced group k-fold, at any number of groups: only the table of distinct group
    sizes (about the square root of the rows at most) reaches the driver, the groups stay in Spark.
    """
    sizes = written(group_sizes(df, group), "sizes")    # a row a group: several passes read them, the rows are made once
    ix, _ = dense_index(sizes.withColumn("_neg", -F.col("n")), ["_neg", group])
    if method == "round_robin":
        fmap = ix.select(F.col(group).alias("_g"), F.pmod(F.col("_idx"), F.lit(k)).cast("int").alias(out))
    else:
        classes = sorted(((int(r["n"]), int(r["c"])) for r in
                          sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
        runs = df.sparkSession.createDataFrame(greedy_runs(classes, k), "n long, _from long, _to long, _order array<int>")
        place = F.pmod(F.col("_idx") - F.col("_from"), F.size("_order")) + 1
        fmap = (ix.join(runs, "n").filter((F.col("_idx") >= F.col("_from")) & (F.col("_idx") < F.col("_to")))
                .select(F.col(group).alias("_g"), F.element_at("_order", place.cast("int")).alias(out)))
    return df.join(fmap, df[group].eqNullSafe(fmap["_g"])).drop("_g")


def fold_sizes(df: DataFrame, fold: str = "fold", group: str | None = None) -> DataFrame:
    """Per-fold row (and group) counts - the balance check."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if group:
        aggs.append(F.count_distinct(group).alias("n_groups"))
    return df.groupBy(fold).agg(*aggs)
