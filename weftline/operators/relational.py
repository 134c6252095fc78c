"""Relational work over the star schema: Spark-native extras, not operators of the converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n"))


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: dimensions are far below the broadcast threshold at any scale factor but customer, which Spark sizes itself."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.rollup("year", "o_orderstatus").agg(F.count("*").alias("n"))


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each return flag."""
    order = W.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("l_returnflag", "l_orderkey", "l_linenumber", "rn")


def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click at or before it: one window over the union, no range join."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").where("event_type IN ('click', 'purchase')")
    order = W.partitionBy("user_id").orderBy("ts", "event_type", "event_id").rowsBetween(W.unboundedPreceding, 0)
    clicked = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order)
    return e.withColumn("click_id", clicked).where("event_type = 'purchase'").select("event_id", "click_id")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = [("union", c.union(s).distinct()), ("intersect", c.intersect(s)), ("intersect all", c.intersectAll(s)), ("except all", c.exceptAll(s))]
    out = None
    for name, df in named:
        one = df.groupBy("k").count().select(F.lit(name).alias("op"), "k", F.col("count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("c_mktsegment").orderBy("c_nationkey")
    u = W.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(u).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.lead("c_custkey").over(u).alias("next_key"))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {"pricing_summary": pricing_summary, "revenue_by_nation": revenue_by_nation, "order_cube": order_cube, "order_rollup": order_rollup, "top_parts": top_parts, "asof_last_click": asof_last_click, "set_operations": set_operations, "window_ranks": window_ranks, "status_pivot": status_pivot}
ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "order_rollup": "SELECT year, o_orderstatus, count(*) AS n FROM (SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus FROM orders) GROUP BY ROLLUP (year, o_orderstatus)",
    "top_parts": "SELECT l_returnflag, l_orderkey, l_linenumber, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3",
    "asof_last_click": "SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id ROWS UNBOUNDED PRECEDING) AS click_id FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'",
    "set_operations": """
WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k, count(*) AS n FROM (SELECT k FROM c UNION SELECT k FROM s) GROUP BY k UNION ALL SELECT 'intersect', k, count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM s) GROUP BY k UNION ALL
SELECT 'intersect all', k, count(*) FROM (SELECT k FROM c INTERSECT ALL SELECT k FROM s) GROUP BY k UNION ALL SELECT 'except all', k, count(*) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) GROUP BY k""",
    "window_ranks": """SELECT c_custkey, rank() OVER w::INTEGER AS rnk, dense_rank() OVER w::INTEGER AS dense, ntile(4) OVER u::INTEGER AS quarter, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume, lead(c_custkey) OVER u AS next_key
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey), u AS (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey)""",
    "status_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
}
