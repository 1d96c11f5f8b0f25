"""Data checks on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.operators import checks as A
from driftledger.workload.registry import query


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def composite_key(t):
    return A.composite_key(t.base("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_rows FROM lineitem WHERE l_orderkey = 100")
def key_count(t):
    return A.key_count(t.base("lineitem"), F.col("l_orderkey") == 100)


@query("""
    SELECT 'o_orderpriority' AS "column", count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_nulls FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey) FROM orders
    UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey) FROM orders
    UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate) FROM orders""")
def null_counts(t):
    blanked = {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"}
    return A.null_counts(t.base("orders").withColumns({c: F.nullif(c, F.lit(v)) for c, v in blanked.items()}))


@query("""
    SELECT l_orderkey, count(*) AS n_rows FROM lineitem
    WHERE l_orderkey NOT IN (SELECT CASE o_orderstatus WHEN 'P' THEN -1 - o_orderkey ELSE o_orderkey END FROM orders) GROUP BY 1""")
def fk_check(t):
    moved = F.when(F.col("o_orderstatus") == "P", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return A.fk_check(t.base("lineitem"), t.base("orders").withColumn("o_orderkey", moved), {"l_orderkey": "o_orderkey"})


@query("""
    SELECT c.c_custkey, c.c_name, c.c_custkey // 10 AS boss, p.c_name AS parent_c_name
    FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 10 WHERE c.c_custkey >= 10""")
def self_reference(t):
    boss = F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10))
    return A.parent_of(t.base("customer").select("c_custkey", "c_name", boss.alias("boss")), "c_custkey", "boss", ["c_name"])


@query("""
    SELECT c.c_custkey // 10 AS boss, count(*) AS n_rows FROM customer c
    WHERE c.c_custkey >= 10 AND c.c_custkey // 10 NOT IN (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN -1 - c_custkey ELSE c_custkey END FROM customer) GROUP BY 1""")
def self_reference_orphans(t):
    customers = t.base("customer")
    boss = F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10))
    moved = F.when(F.col("c_mktsegment") == "BUILDING", -1 - F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return A.fk_check(customers.select(boss.alias("boss")), customers.withColumn("c_custkey", moved), {"boss": "c_custkey"})
