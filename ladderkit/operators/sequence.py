"""Ordered-sequence primitives that stay distributed when one group is huge.

``Window.partitionBy(g)`` sends a whole group to one task; with a group holding
a third of all rows that task never finishes. The primitives here therefore
choose a plan per call:

* ``window`` - the native partitioned window, used when the heaviest group has
  at most ``ladderkit.window.maxGroupRows`` rows (checked with one cheap
  aggregate, like a size check before a broadcast);
* ``blocked`` - a dense global index over the full ordering
  ``(group..., order..., id)``; rows are cut into fixed-size blocks, each block
  receives a ``k``-row halo from its neighbours, and the offset window runs per
  block. Work per task is bounded by the block size whatever the skew.

A dense index is also what global (unpartitioned) ranks need, so it is exposed.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MAX_GROUP_ROWS_CONF = "ladderkit.window.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
MAX_BLOCK_ROWS_CONF = "ladderkit.block.maxRows"
DEFAULT_MAX_BLOCK_ROWS = 4_000_000
_POS_BITS = 33


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


_GROUP_SIZE_CACHE: dict = {}


def max_group_rows(df: DataFrame, group: Sequence) -> int:
    """Row count of the heaviest group (partial aggregation, one row to the driver).

    Memoised per (plan, group): the answer only selects a physical strategy -
    both strategies give identical results - so a stale entry can cost speed,
    never correctness.
    """
    try:
        ck = (df.semanticHash(), tuple(str(g) for g in group))
    except Exception:  # noqa: BLE001 - plans without a semantic hash are simply not cached
        ck = None
    if ck is not None and ck in _GROUP_SIZE_CACHE:
        return _GROUP_SIZE_CACHE[ck]
    row = df.groupBy(*group).count().agg(F.max("count").alias("m")).first()
    m = int(row["m"] or 0)
    if ck is not None:
        _GROUP_SIZE_CACHE[ck] = m
    return m


def choose_strategy(df: DataFrame, group: Sequence, strategy: str = "auto") -> str:
    if strategy != "auto":
        return strategy
    if not group:
        return "blocked"
    limit = int(df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))
    return "window" if max_group_rows(df, group) <= limit else "blocked"


def dense_index(df: DataFrame, order: Sequence, idx: str = "_idx",
                num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Attach a dense 0-based index following ``order`` (which must be a total order).

    Range-partition + sort within partitions, persist through a reliable
    checkpoint (so a lost executor cannot reshuffle rows between the count and
    the use), count rows per partition of the copy (one row per partition to the driver),
    and add the prefix offset with a broadcast join whose size is bounded by
    the partition count. Returns ``(frame, total_rows)``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or range_partitions(df)
    order = _cols(order)
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # written at once, so that the count job and every later use read the copy and sort nothing
    ranged = ranged.checkpoint()
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    counts = sorted((int(r["_p"]), int(r["n"])) for r in
                    ranged.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for p, cnt in counts:
        offsets.append((p, acc))
        acc += cnt
    if not offsets:
        return ranged.withColumn(idx, F.lit(0).cast("long")).drop("_mid"), 0
    off_df = spark.createDataFrame(offsets, "_p long, _off long")
    out = (ranged.withColumn("_p", pid)
           .join(F.broadcast(off_df), "_p")
           .withColumn(idx, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
           .drop("_p", "_off", "_mid"))
    return out, acc


RANGE_PARTITIONS_CONF = "ladderkit.rangePartitions"


def range_partitions(df: DataFrame) -> int:
    """Range-partition count for the dense index: ``ladderkit.rangePartitions`` if set, else
    ``spark.sql.shuffle.partitions`` (size it for the data, as for any sort). Nothing is
    executed to decide - asking an adaptive plan for its RDD would run its upstream stages."""
    conf = df.sparkSession.conf
    return int(conf.get(RANGE_PARTITIONS_CONF, None) or conf.get("spark.sql.shuffle.partitions"))


def block_size(spark, total: int, halo: int = 0) -> int:
    """Rows per block: spread over the range partitions, never above ``ladderkit.block.maxRows``."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cap = int(spark.conf.get(MAX_BLOCK_ROWS_CONF, str(DEFAULT_MAX_BLOCK_ROWS)))
    return halo + max(1, min(cap, math.ceil(total / max(1, n))))


def _default_name(col: str, off: int) -> str:
    return f"{col}_lag{-off}" if off < 0 else f"{col}_lead{off}"


def shift(df: DataFrame, group, order, lags: dict | None = None, leads: dict | None = None,
          name: Callable[[str, int], str] = _default_name, strategy: str = "auto") -> DataFrame:
    """Add lag/lead columns within ``group`` following ``order``.

    ``lags``/``leads`` map a column (name or ``(name, Column)``) to a list of
    offsets. Rows past a group edge get NULL, like ``lag``/``lead``. The
    ordering must be total (end it with a unique id).
    """
    group, order = _cols(group), _cols(order)
    specs = [(col, -k) for col, ks in (lags or {}).items() for k in ks]
    specs += [(col, k) for col, ks in (leads or {}).items() for k in ks]
    if not specs:
        return df
    strategy = choose_strategy(df, group, strategy)
    if strategy == "window":
        w = Window.partitionBy(*group).orderBy(*order)
        return df.select("*", *[
            (F.lag(col, -off) if off < 0 else F.lead(col, off)).over(w).alias(name(col, off))
            for col, off in specs])
    return _blocked_shift(df, group, order, specs, name)


def _blocked_shift(df, group, order, specs, name):
    k_lag = max([-o for _, o in specs if o < 0] or [0])
    k_lead = max([o for _, o in specs if o > 0] or [0])
    cols = df.columns
    ix, total = dense_index(df, group + order)
    size = block_size(df.sparkSession, total, halo=max(k_lag, k_lead))
    blk = F.floor(F.col("_idx") / F.lit(size)).cast("long")
    pos = F.col("_idx") - blk * F.lit(size)
    targets = F.array(blk,
                      F.when(pos >= F.lit(size - k_lag), blk + 1) if k_lag else F.lit(None).cast("long"),
                      F.when((pos < F.lit(k_lead)) & (blk > 0), blk - 1) if k_lead else F.lit(None).cast("long"))
    ex = (ix.withColumn("_home", blk)
          .withColumn("_b", F.explode(targets))
          .filter(F.col("_b").isNotNull()))
    w = Window.partitionBy("_b").orderBy("_idx")
    gkey = F.struct(*[F.col(g) for g in group]) if group else None
    out = []
    for col, off in specs:
        k = -off if off < 0 else off
        fn = F.lag if off < 0 else F.lead
        val = fn(col, k).over(w)
        idx_ok = fn("_idx", k).over(w) == F.col("_idx") + F.lit(off)
        ok = idx_ok if gkey is None else (idx_ok & fn(gkey, k).over(w).eqNullSafe(gkey))
        out.append(F.when(ok, val).alias(name(col, off)))
    return (ex.select(*cols, "_b", "_home", *out)
            .filter(F.col("_b") == F.col("_home"))
            .drop("_b", "_home"))


def global_rank(df: DataFrame, order, idx: str = "rn") -> DataFrame:
    """0-based ordinal position over the whole table without a single-task window."""
    out, _ = dense_index(df, _cols(order), idx=idx)
    return out


def running_sum(df: DataFrame, order, cols: Sequence[str], suffix: str = "_cum",
                inclusive: bool = True) -> DataFrame:
    """Global running sums of ``cols`` along ``order`` without a single-task window.

    Dense index -> fixed-size blocks -> per-block totals (one row per block to
    the driver) -> prefix offsets broadcast back -> window running sum inside
    each block. Adds ``_idx`` and ``<col><suffix>`` columns.
    """
    spark = df.sparkSession
    ix, total = dense_index(df, _cols(order))
    size = block_size(spark, total)
    ix = ix.withColumn("_blk", F.floor(F.col("_idx") / F.lit(size)).cast("long"))
    tots = sorted(ix.groupBy("_blk").agg(*[F.sum(x).alias(x) for x in cols]).collect(), key=lambda r: r["_blk"])
    acc = [0.0] * len(cols)
    offs = []
    for r in tots:
        offs.append((int(r["_blk"]), *[float(a) for a in acc]))
        acc = [a + float(r[x] or 0.0) for a, x in zip(acc, cols)]
    schema = "_blk long, " + ", ".join(f"_off{i} double" for i in range(len(cols)))
    off_df = spark.createDataFrame(offs, schema)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("_blk").orderBy("_idx").rowsBetween(*frame)
    out = ix.join(F.broadcast(off_df), "_blk")
    for i, x in enumerate(cols):
        out = out.withColumn(x + suffix, F.col(f"_off{i}") + F.coalesce(F.sum(x).over(w), F.lit(0.0)))
    return out.drop("_blk", *[f"_off{i}" for i in range(len(cols))])
