"""Lookup joins, key-set logic and sequence stitching.

Scale rules applied throughout:

* the build side of every lookup/link is aggregated to one row per key before
  the join, so a hot key (flat prices!) never multiplies rows; the join is then
  many-to-one and AQE may broadcast it when its measured size is small;
* many-to-many overlap is *counted* from per-key counts (``sum(n_a * n_b)``),
  never materialised as pairs;
* chain walks use pointer doubling with a reliable ``checkpoint`` per round
  (log2(max chain) joins), never a driver loop over rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, key, lit_d, safe_corr, sdiv
from .sequence import shift
from .windows import fill


# J1, J5, U2, U3 ----------------------------------------------------------------
def overlap_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of the many-to-many inner join on ``keys`` and the share of rows that match.

    Counts per key on each side, one full-outer equi-join of the two count
    tables, one aggregate: ``n_pairs = sum(n_a * n_b)`` - the pair set itself
    is never produced. NULL keys never match (they stay one-sided).
    """
    keys = list(keys)
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, keys, "full_outer")
    both = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    return j.agg(
        F.coalesce(F.sum(F.when(both, F.col("_na") * F.col("_nb"))), F.lit(0)).cast("long").alias("n_pairs"),
        F.coalesce(F.sum(F.when(both, F.col("_na"))), F.lit(0)).cast("long").alias("n_left_matched"),
        F.coalesce(F.sum(F.when(both, F.col("_nb"))), F.lit(0)).cast("long").alias("n_right_matched"),
        F.coalesce(F.sum("_na"), F.lit(0)).cast("long").alias("n_left"),
        F.coalesce(F.sum("_nb"), F.lit(0)).cast("long").alias("n_right"),
    ).withColumn("share_right_matched", F.try_divide(F.col("n_right_matched"), F.col("n_right")))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key sets - left, right, both, left-only, right-only counts (one full-outer join)."""
    keys = list(keys)
    ka = a.select(*keys).dropna().distinct().withColumn("_l", F.lit(1))
    kb = b.select(*keys).dropna().distinct().withColumn("_r", F.lit(1))
    j = ka.join(kb, keys, "full_outer")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return j.agg(F.count_if(l).alias("n_left"), F.count_if(r).alias("n_right"), F.count_if(l & r).alias("n_both"),
                 F.count_if(l & ~r).alias("n_left_only"), F.count_if(r & ~l).alias("n_right_only"))


def intersect_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*keys).dropna().intersect(b.select(*keys).dropna())


def except_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` absent from ``b``."""
    return a.select(*keys).dropna().subtract(b.select(*keys).dropna())


# J2-J4 -------------------------------------------------------------------------
def lookup_table(build: DataFrame, keys: Sequence[str], value: str, with_median: bool = False) -> DataFrame:
    """Aggregate the build side to one row per key: mean, count (and exact median)."""
    keys = list(keys)
    t = build.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"), F.count(F.lit(1)).alias(f"{value}_n"))
    if with_median:
        from .quantiles import quantiles
        med = quantiles(build, value, [0.5], group=keys).select(*keys, F.col("q").alias(f"{value}_median"))
        t = t.join(med, keys, "left")
    return t


def lookup_join(probe: DataFrame, build: DataFrame, keys: Sequence[str], value: str,
                with_median: bool = False) -> DataFrame:
    """Attach per-key aggregates of ``build`` to ``probe`` (left outer; unmatched -> NULL)."""
    return probe.join(lookup_table(build, keys, value, with_median), list(keys), "left")


def override(default: Column, rules: Sequence[tuple[str, Column, float]]) -> Column:
    """Priority override. ``rules`` in increasing priority: ``("blend", v, w)`` blends
    ``w * v + (1 - w) * current`` where v is not NULL; ``("replace", v, _)`` overwrites."""
    cur = default
    for kind, v, w in rules:
        if kind == "blend":
            cur = F.when(v.isNotNull(), lit_d(w) * v + lit_d(1.0 - w) * cur).otherwise(cur)
        else:
            cur = F.coalesce(v, cur)
    return cur


# J6, J7 ------------------------------------------------------------------------
def state_keys(cur: Sequence, lags: Sequence, d: int = 4) -> tuple[list[Column], list[Column]]:
    """Current state ``round(x, d)`` and past state ``round(x - x_lag1, d)`` as long keys."""
    cur_k = [key(c(x), d) for x in cur]
    past_k = [key(c(x) - c(lg), d) for x, lg in zip(cur, lags)]
    return cur_k, past_k


def link_successor(df: DataFrame, cur: Sequence[str], lags: Sequence[str], id_col: str = "id",
                   d: int = 4) -> DataFrame:
    """Edge ``i -> j`` when ``current(i) == past(j)`` and that past state is unique.

    The build side is grouped by the past key (count + min id), so only unique
    candidates survive and the join is many-to-one. A self-link is allowed, as
    in the reference, when a row's current and past states coincide.
    """
    ck, pk = state_keys(cur, lags, d)
    names = [f"_k{i}" for i in range(len(cur))]
    past = (df.select(F.col(id_col).alias("_dst"), *[k.alias(n) for k, n in zip(pk, names)]).dropna()
            .groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_dst").alias("dst"))
            .filter(F.col("_n") == 1).drop("_n"))
    probe = df.select(F.col(id_col).alias("src"), *[k.alias(n) for k, n in zip(ck, names)]).dropna()
    return probe.join(past, names).select("src", "dst")


def link_average(df: DataFrame, cur: Sequence[str], lags: Sequence[str], value: str, id_col: str = "id",
                 d: int = 4) -> DataFrame:
    """Like J6 but ambiguous candidates are averaged (their ``value``) and orphans get 0."""
    ck, pk = state_keys(cur, lags, d)
    names = [f"_k{i}" for i in range(len(cur))]
    past = (df.select(F.col(value).alias("_v"), *[k.alias(n) for k, n in zip(pk, names)]).dropna(subset=names)
            .groupBy(*names).agg(F.count(F.lit(1)).alias("n_cand"), F.avg("_v").alias("_avg")))
    probe = df.select(F.col(id_col).alias("id"), *[k.alias(n) for k, n in zip(ck, names)])
    return probe.join(past, names, "left").select(
        "id", F.coalesce("n_cand", F.lit(0)).cast("long").alias("n_cand"),
        F.coalesce("_avg", lit_d(0.0)).alias("next_value"))


# J8 ----------------------------------------------------------------------------
def link_signature(df: DataFrame, price: str, lags: Sequence[str], id_col: str = "id", d: int = 5) -> DataFrame:
    """Overlapping 3-tick signature link.

    Levels ``p0 = p - L3, p1 = p - L2, p2 = p - L1, p3 = p``; past anchor
    ``(p0, p1, p2)``, current anchor ``(p1, p2, p3)``, rounded to ``d``
    decimals. On duplicate anchors the last writer wins (largest id); an edge
    ``i -> j`` needs ``i != j``. The edge set is injective.
    """
    l1, l2, l3 = lags
    p = F.col(price)
    lv = [p - F.col(l3), p - F.col(l2), p - F.col(l1), p]
    names = ["_a0", "_a1", "_a2"]
    past = (df.select(F.col(id_col).alias("_id"), *[key(lv[i], d).alias(names[i]) for i in range(3)]).dropna()
            .groupBy(*names).agg(F.max("_id").alias("dst")))
    cur = (df.select(F.col(id_col).alias("_id"), *[key(lv[i + 1], d).alias(names[i]) for i in range(3)]).dropna()
           .groupBy(*names).agg(F.max("_id").alias("src")))
    return cur.join(past, names).filter(F.col("src") != F.col("dst")).select("src", "dst")


# J9 ----------------------------------------------------------------------------
def link_tolerance(df: DataFrame, a_keys: Sequence[str], b_keys: Sequence[str], tol: float = 1e-4,
                   d: int = 4, id_col: str = "id", probe_filter: Column | None = None,
                   exact: bool = False) -> DataFrame:
    """Link A to the first B (smallest id) whose ``b_keys`` are within ``tol`` of A's ``a_keys``.

    Bucket equi-join on the keys rounded to ``d`` decimals, then the residual ``|diff| < tol``.
    ``exact=True`` buckets by ``floor(x / tol)`` and also probes the +-1 neighbours of every key
    part, so every pair within ``tol`` is found whatever ``tol`` is (the reference's bucket
    equality misses pairs across a rounding boundary). Both sides are reduced to their distinct
    key values first, the build side with its smallest id, so flat prices do not multiply.
    Returns ``(a_id, b_id)``.
    """
    k = len(a_keys)
    names, av, bv = ([f"{p}{i}" for i in range(k)] for p in ("_b", "_av", "_bv"))

    def bucket(x: str) -> Column:
        return F.floor(F.col(x) / F.lit(tol)) if exact else key(x, d)

    b = df.select(F.col(id_col).alias("_bid"), *[F.col(x).alias(v) for x, v in zip(b_keys, bv)]).dropna()
    b = b.groupBy(*bv).agg(F.min("_bid").alias("_bid")).select("_bid", *bv, *[bucket(v).alias(n) for v, n in zip(bv, names)])
    a = df if probe_filter is None else df.filter(probe_filter)
    a = a.select(F.col(id_col).alias("a_id"), *[F.col(x).alias(v) for x, v in zip(a_keys, av)]).dropna()
    probe = a.select(*av).distinct().select(*av, *[bucket(v).alias(n) for v, n in zip(av, names)])
    if exact:
        for n in names:
            probe = probe.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    cond = F.lit(True)
    for x, y in zip(av, bv):
        cond = cond & (F.abs(F.col(y) - F.col(x)) < F.lit(tol))
    found = probe.join(b, names).filter(cond).groupBy(*av).agg(F.min("_bid").alias("b_id"))
    return a.join(found, av).select("a_id", "b_id")


# J10 ---------------------------------------------------------------------------
def asof_successor(df: DataFrame, group: Sequence[str], probe_key: Column, cand_key: Column,
                   id_col: str = "id", probe_filter: Column | None = None) -> DataFrame:
    """For each probe, the smallest id greater than its own among rows of the same group
    whose ``cand_key`` equals the probe's ``probe_key``.

    Probes and candidates are unioned and the answer is a backward fill of the
    candidate id along ``(group, key, id)`` - no pair blow-up, and the fill is
    skew-checked (blocked plan for a hot key).
    """
    group = list(group)
    probes = df if probe_filter is None else df.filter(probe_filter)
    p = probes.select(*group, probe_key.alias("_k"), F.col(id_col).alias("_id"), F.lit(1).alias("_role"),
                      F.lit(None).cast("long").alias("_cid"))
    cands = df.select(*group, cand_key.alias("_k"), F.col(id_col).alias("_id"), F.lit(0).alias("_role"),
                      F.col(id_col).cast("long").alias("_cid"))
    u = p.unionByName(cands).filter(F.col("_k").isNotNull())
    # order (id, role): a row's own candidate entry sorts before its probe entry, so it is never its own successor
    f = fill(u, "_cid", group + ["_k"], ["_id", "_role"], "backward", out="succ_id")
    return f.filter(F.col("_role") == 1).select(F.col("_id").alias(id_col), "succ_id")


# J11, B14 ----------------------------------------------------------------------
def hop(edges: DataFrame, k: int) -> DataFrame:
    """K-hop successor via binary decomposition of k (log2 k self-joins on the edge set)."""
    result, power, kk = None, edges.select("src", "dst"), k
    while kk:
        if kk & 1:
            result = power if result is None else (
                result.join(power.withColumnRenamed("src", "_m").withColumnRenamed("dst", "_d2"),
                            result.dst == F.col("_m")).select("src", F.col("_d2").alias("dst")))
        kk >>= 1
        if kk:
            power = (power.alias("x").join(power.alias("y"), F.col("x.dst") == F.col("y.src"))
                     .select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")))
    return result


def hop_returns(df: DataFrame, edges: DataFrame, price: str, id_col: str = "id", scale: float = 100.0) -> DataFrame:
    """J11 + B14 inputs: 1- and 2-hop returns; ret2 := ret1 without a 2nd hop; 0 when unlinked.

    The edge set feeds three joins, so it is materialised once (reliable checkpoint).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    edges = edges.select("src", "dst").checkpoint()
    e2 = hop(edges, 2)
    pr = df.select(F.col(id_col).alias("_pid"), F.col(price).alias("_p"))
    base = df.select(F.col(id_col).alias("id"), F.col(price).alias("p0"))

    def looked_up(e: DataFrame, n: str, p: str) -> DataFrame:
        """Price at the edge's end: only linked rows take part, unlinked ones share no null key."""
        return (e.select(F.col("src").alias("id"), F.col("dst").alias(n)).join(pr, F.col(n) == F.col("_pid"), "left")
                .select("id", n, F.col("_p").alias(p)))

    j = (base.join(looked_up(edges, "n1", "p1"), "id", "left").join(looked_up(e2, "n2", "p2"), "id", "left"))
    r1 = sdiv(lit_d(scale) * (F.col("p1") - F.col("p0")), F.col("p0"))
    r2 = sdiv(lit_d(scale) * (F.col("p2") - F.col("p0")), F.col("p0"))
    return j.select("id", "n1", "n2",
                    F.coalesce(r1, lit_d(0.0)).alias("ret_1"),
                    F.coalesce(F.when(F.col("n2").isNotNull(), r2), r1, lit_d(0.0)).alias("ret_2"))


def project_horizons(ret1: Column, ret2: Column, w1: float = 0.8044, w2: float = 0.1988) -> Column:
    """Two-horizon linear projection."""
    return lit_d(w1) * ret1 + lit_d(w2) * ret2


# J12 ---------------------------------------------------------------------------
def assemble_chains(nodes: DataFrame, edges: DataFrame, min_len: int = 10, id_col: str = "id") -> DataFrame:
    """Chains of an injective edge set as ``(chain_id, pos, id)``.

    Pointer doubling on predecessor links: every round doubles the jump and adds the distance.
    Only rows that still have a pointer are joined and rewritten (one reliable checkpoint a
    round); rows whose root is known are kept aside and only looked up. Nodes whose pointer
    never reaches a root lie on cycles and are dropped, as in the reference; chains of
    ``min_len`` rows or fewer are dropped.
    """
    from ..session import ensure_checkpoint_dir
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    prev = edges.select(F.col("dst").alias("node"), F.col("src").alias("ptr"))
    start = nodes.select(F.col(id_col).alias("node")).join(prev, "node", "left").checkpoint()
    done = start.filter(F.col("ptr").isNull()).select("node", F.lit(0).cast("long").alias("dist"), F.col("node").alias("root"))
    act = start.filter(F.col("ptr").isNotNull()).select("node", F.lit(1).cast("long").alias("dist"), "ptr")
    active = act.count()
    while active:
        known = (done.withColumn("ptr", F.lit(None).cast("long"))
                 .unionByName(act.withColumn("root", F.lit(None).cast("long"))))
        nxt = (act.alias("a").join(known.alias("b"), F.col("a.ptr") == F.col("b.node"))
               .select("a.node", (F.col("a.dist") + F.col("b.dist")).alias("dist"), "b.root", "b.ptr")).checkpoint()
        done = done.unionByName(nxt.filter(F.col("root").isNotNull()).select("node", "dist", "root"))
        act = nxt.filter(F.col("ptr").isNotNull()).select("node", "dist", "ptr")
        still = act.count()
        if still == active:  # only cycles keep a pointer
            break
        active = still
    lens = done.groupBy("root").agg(F.count(F.lit(1)).alias("_len")).filter(F.col("_len") > min_len)
    return done.join(lens, "root").select(F.col("root").alias("chain_id"), F.col("dist").alias("pos"),
                                          F.col("node").alias(id_col))


# V3, V4 ------------------------------------------------------------------------
def chain_returns(chains: DataFrame, df: DataFrame, price: str, horizons: Sequence[int],
                  id_col: str = "id", scale: float = 1.0) -> DataFrame:
    """V4 building block: h-step return along each chain (NULL past the chain end)."""
    j = chains.join(df.select(id_col, price), id_col)
    s = shift(j, ["chain_id"], ["pos"], leads={price: list(horizons)})
    return s.select("chain_id", "pos", id_col, *[
        sdiv(lit_d(scale) * (F.col(f"{price}_lead{h}") - F.col(price)), F.col(price)).alias(f"ret_{h}")
        for h in horizons])


def decode_horizon(chains: DataFrame, df: DataFrame, price: str, target: str, hmax: int = 199,
                   block: int = 20, min_pairs: int = 100, thr: float = 0.99, id_col: str = "id") -> DataFrame:
    """V3: smallest h whose chained h-step return correlates > ``thr`` with the target (>= ``min_pairs``).

    Horizons are scanned in blocks (all leads of a block in one window pass,
    one aggregate), stopping at the first block with a hit.
    """
    tgt = df.select(id_col, target)
    spark = df.sparkSession
    for start in range(1, hmax + 1, block):
        hs = list(range(start, min(start + block, hmax + 1)))
        r = chain_returns(chains, df, price, hs, id_col).join(tgt, id_col)
        long = r.select(F.col(target).alias("_y"), F.explode(F.array(*[
            F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("ret")) for h in hs])).alias("e")).select(
            "_y", "e.h", "e.ret").filter(F.col("ret").isNotNull() & F.col("_y").isNotNull())
        stats = long.groupBy("h").agg(F.count(F.lit(1)).alias("n"), safe_corr("ret", "_y").alias("corr"))
        hit = stats.filter((F.col("n") >= min_pairs) & (F.col("corr") > thr)).orderBy("h").limit(1).collect()
        if hit:
            return spark.createDataFrame([(int(hit[0]["h"]), int(hit[0]["n"]), float(hit[0]["corr"]))],
                                         "h int, n long, corr double")
    return spark.createDataFrame([], "h int, n long, corr double")
