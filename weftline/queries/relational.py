"""The SQL passthrough over registered tables: what an arbitrary query may use."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.queries.registry import QUERIES, SQL
from weftline.session import table
from weftline.sources import tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def passthrough(name: str, text: str, oracle: str | None = None, doc: str = "") -> None:
    """Registers a query that Spark and DuckDB run alike, or with another text for DuckDB."""

    def run(spark, sf_dir):
        views = {t: table(spark, sf_dir, t) for t in TABLES if t in text}
        return tables.passthrough(spark, text, **views)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], SQL[name] = run, oracle or text


passthrough("sql_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

passthrough("sql_join_revenue", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")

passthrough("sql_semi_anti", """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")

passthrough("sql_outer_joins", """
SELECT n_name, s_name, count(c_custkey) AS customers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name, s_name""")



def outer_joins(spark, sf_dir):
    """Customers are counted by nation before the join: a nation's suppliers and customers never meet row by row."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    nations = table(spark, sf_dir, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))
    return nations.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "s_name").agg(F.sum("n").alias("customers"))


QUERIES["sql_outer_joins"] = outer_joins

passthrough("sql_range_join", """
SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal AND b.s_acctbal <= a.s_acctbal + 1000""")

passthrough("sql_windows", """
SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_priority FROM orders""")

passthrough("sql_rollup", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")

passthrough("sql_cube", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")

passthrough("sql_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")

passthrough("sql_set_operations", """
(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")

passthrough("sql_cte_having", """
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5)
SELECT c_mktsegment, count(*) AS customers, CAST(sum(CAST(round(total * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean_cents FROM spent JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")

passthrough("sql_statistics", """
SELECT event_type, round(median(value), 6) AS mid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")

passthrough("sql_by_day", """
SELECT date_trunc('day', ts) AS day, hour(ts) AS hour, count(*) AS pages FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
"SELECT date_trunc('day', ts)::TIMESTAMP AS day, hour(ts)::INT AS hour, count(*) AS pages FROM events GROUP BY 1, 2 HAVING count(*) > 1")

passthrough("sql_top_per_group", """
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn <= 3""")

passthrough("sql_scalar_subquery", """
SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)""")

passthrough("sql_case_pivot", """
SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY o_orderpriority""",
"SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY o_orderpriority")


def embeddings_norms(spark, sf_dir):
    """Array functions over vectors."""
    rows = table(spark, sf_dir, "embeddings")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(square)), 5).alias("mean_norm"))


QUERIES["embeddings_norms"] = embeddings_norms
SQL["embeddings_norms"] = "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS mean_norm FROM embeddings GROUP BY label"
