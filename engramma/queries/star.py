"""Relational primitives on the star schema: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramma.session import table

def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))), 2).alias("revenue"), F.count("*").alias("n"))


def join_inner(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n_orders"))


def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def join_full(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    return a.join(b, "k", "full").select("k", "n_suppliers", "n_customers")


def grouping_sets(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("engramma_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM engramma_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def window_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.ntile(4).over(w).alias("quarter"))


def window_running(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum(F.col("o_totalprice").cast("double")).over(w), 2).alias("running"))


def topk_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "rn")


def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct())


QUERIES = {f.__name__: f for f in (pricing_summary, join_inner, join_left, join_semi, join_anti, join_full, grouping_sets, rollup, cube, window_rank, window_running, topk_per_group, set_union, set_intersect, set_except)}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS sum_qty, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "join_inner": "SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, n_suppliers, n_customers FROM (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) b ON a.k = b.k",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "window_running": "SELECT o_orderkey, round(sum(CAST(o_totalprice AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "topk_per_group": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part QUALIFY rn <= 3",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem",
}
