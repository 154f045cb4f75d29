"""Fixture views over the driver's tables, as Spark plans and as oracle SQL CTEs.

* ``v_ticks`` - a tick stream: events per user ordered by (ts, id) with price
  lag differences, a forward-return target and a test tag.
* ``v_book``  - a seven-level two-sided ladder aggregated from lineitem.
* ``v_wide``  - a wide labelled table (one row per order).
* ``v_preds`` - three prediction columns of very different quality.

The Spark plans are written for scale: lineitem is pre-aggregated per order
before it meets orders/customer (the group key ``o_orderkey`` is unique in
orders, so this is the same result with far less shuffle), and the tick lags
go through :func:`ladderkit.operators.sequence.shift`, which is skew-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import sdiv
from ..operators.sequence import shift
from ..sources.scan import scan

LADDER_LEVELS = 7


# ---------------------------------------------------------------- Spark plans
def ticks_base(spark: SparkSession, sf: str) -> DataFrame:
    ev = scan(spark, sf, "events", ["event_id", "user_id", "ts", "value", "props"])
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("grp"), F.col("ts").alias("t"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"))


def v_ticks(spark: SparkSession, sf: str, strategy: str = "auto") -> DataFrame:
    b = ticks_base(spark, sf)
    s = shift(b, ["grp"], ["t", "id"], lags={"price": [1, 2, 3], "s2": [1]},
              leads={"price": [1]}, strategy=strategy)
    p = F.col("price")
    return s.select(
        "id", "grp", "t", "price", "s2",
        (p - F.col("price_lag1")).alias("price_l1"),
        (p - F.col("price_lag2")).alias("price_l2"),
        (p - F.col("price_lag3")).alias("price_l3"),
        (F.col("s2") - F.col("s2_lag1")).alias("s2_l1"),
        sdiv(F.lit(100.0) * (F.col("price_lead1") - p), p).alias("target"),
        F.when(F.col("id") % 5 < 2, F.lit(1)).otherwise(F.lit(0)).alias("is_test"))


def v_book(spark: SparkSession, sf: str) -> DataFrame:
    li = scan(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    aggs = []
    for i in range(1, LADDER_LEVELS + 1):
        hit = F.col("l_linenumber") == i
        aggs.append(F.sum(F.when(hit, F.col("l_quantity")).otherwise(F.lit(0.0))).alias(f"a{i}"))
        aggs.append(F.sum(F.when(hit, F.col("l_extendedprice") / 1000.0).otherwise(F.lit(0.0))).alias(f"v{i}"))
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(*aggs)


def v_wide(spark: SparkSession, sf: str) -> DataFrame:
    li = scan(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("_rev"),
        F.sum("l_quantity").alias("f1"),
        F.avg("l_discount").alias("f3"),
        F.avg("l_tax").alias("f4"),
        F.count(F.lit(1)).cast("double").alias("f5"),
        F.max("l_quantity").alias("f6"),
        F.min("l_extendedprice").alias("f7"))
    orders = scan(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    cust = scan(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    j = (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
         .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("grp"),
        (F.col("_rev") / 1000.0).alias("target"),
        "f1", F.col("o_totalprice").alias("f2"), "f3", "f4", "f5", "f6", "f7",
        F.col("c_acctbal").alias("f8"), F.lit(1.0).cast("double").alias("f9"))


BOOK_A = [f"a{i}" for i in range(1, LADDER_LEVELS + 1)]
BOOK_V = [f"v{i}" for i in range(1, LADDER_LEVELS + 1)]
LAGS = ["_LagT1", "_LagT2", "_LagT3"]


def v_book_lags(spark: SparkSession, sf: str, strategy: str = "auto") -> DataFrame:
    """v_book + ``grp = id % 50`` + lag-difference columns ``x_LagTk = x - lag(x, k)``."""
    b = v_book(spark, sf).withColumn("grp", F.col("id") % 50)
    cols = BOOK_A + BOOK_V
    s = shift(b, ["grp"], ["id"], lags={x: [1, 2, 3] for x in cols}, strategy=strategy)
    return s.select("id", "grp", *cols, *[
        (F.col(x) - F.col(f"{x}_lag{k}")).alias(f"{x}_LagT{k}") for k in (1, 2, 3) for x in cols])


WIDE_FEATURES = [f"f{i}" for i in range(1, 10)]


def v_preds(spark: SparkSession, sf: str) -> DataFrame:
    w = v_wide(spark, sf)
    return w.select("id", "grp", F.col("target").alias("y"),
                    (F.lit(1.5) * F.col("f1")).alias("p1"),
                    (F.col("f5") * F.col("f7") / 700.0).alias("p2"),
                    (F.lit(10.0) * F.col("f5")).alias("p3"))


PRED_COLS = ["p1", "p2", "p3"]


# ------------------------------------------------------------ oracle SQL CTEs
SQL_TICKS = """v_ticks AS (
  WITH b AS (SELECT event_id AS id, user_id AS grp, ts AS t, value AS price,
                    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s2 FROM events),
  l AS (SELECT *, price - lag(price, 1) OVER w AS price_l1, price - lag(price, 2) OVER w AS price_l2,
               price - lag(price, 3) OVER w AS price_l3, s2 - lag(s2, 1) OVER w AS s2_l1,
               CASE WHEN price = 0 THEN NULL ELSE 100.0 * ((lead(price, 1) OVER w) - price) / price END AS target
        FROM b WINDOW w AS (PARTITION BY grp ORDER BY t, id))
  SELECT *, CASE WHEN id % 5 < 2 THEN 1 ELSE 0 END AS is_test FROM l)"""

SQL_BOOK = "v_book AS (SELECT l_orderkey AS id, " + ", ".join(
    f"SUM(CASE WHEN l_linenumber = {i} THEN l_quantity ELSE 0.0 END) AS a{i}, "
    f"SUM(CASE WHEN l_linenumber = {i} THEN l_extendedprice / 1000.0 ELSE 0.0 END) AS v{i}"
    for i in range(1, LADDER_LEVELS + 1)) + " FROM lineitem GROUP BY l_orderkey)"

SQL_BOOK_L = "v_book_l AS (SELECT id, id % 50 AS grp, " + ", ".join(
    [f"a{i}, v{i}" for i in range(1, LADDER_LEVELS + 1)]) + ", " + ", ".join(
    f"{x} - lag({x}, {k}) OVER w AS {x}_LagT{k}" for k in (1, 2, 3)
    for x in [f"a{i}" for i in range(1, LADDER_LEVELS + 1)] + [f"v{i}" for i in range(1, LADDER_LEVELS + 1)]
) + " FROM v_book WINDOW w AS (PARTITION BY id % 50 ORDER BY id))"

SQL_WIDE = """v_wide AS (
  SELECT o_orderkey AS id, c_nationkey AS grp, SUM(l_extendedprice * (1.0 - l_discount)) / 1000.0 AS target,
         SUM(l_quantity) AS f1, o_totalprice AS f2, AVG(l_discount) AS f3, AVG(l_tax) AS f4,
         CAST(COUNT(*) AS DOUBLE) AS f5, MAX(l_quantity) AS f6, MIN(l_extendedprice) AS f7, c_acctbal AS f8,
         CAST(1.0 AS DOUBLE) AS f9
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, c_nationkey, o_totalprice, c_acctbal)"""

SQL_PREDS = """v_preds AS (SELECT id, grp, target AS y, 1.5 * f1 AS p1, f5 * f7 / 700.0 AS p2, 10.0 * f5 AS p3 FROM v_wide)"""

_CTE = {"v_ticks": [SQL_TICKS], "v_book": [SQL_BOOK], "v_book_l": [SQL_BOOK, SQL_BOOK_L], "v_wide": [SQL_WIDE],
        "v_preds": [SQL_WIDE, SQL_PREDS]}


def with_views(*views: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause defining the named fixture views (dependencies included)."""
    parts: list[str] = []
    for v in views:
        for cte in _CTE[v]:
            if cte not in parts:
                parts.append(cte)
    parts += extra or []
    return "WITH " + ",\n".join(parts) + "\n"
