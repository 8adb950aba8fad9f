"""Star-schema queries that the engine gives for free; coverage beyond the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.jobs.base import Tables, query


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL""")
def star_pricing(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1997-03-15' AND l_shipdate > '1997-03-15' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def star_top_orders(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.orders.where("o_orderdate < timestamp_ntz '1997-03-15'").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    li = t.lineitem.where("l_shipdate > timestamp_ntz '1997-03-15'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    g = li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_local_suppliers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    li = li.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    by = li.groupBy("s_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    named = by.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", F.round("revenue", 2).alias("revenue"))
