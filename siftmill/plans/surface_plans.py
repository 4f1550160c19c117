"""The SQL surface of the query corpus, over the star schema: texts in its dialect, rewritten for Spark."""

from __future__ import annotations

from ..operators.dialect import to_spark
from .fixtures import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name -> (text in the corpus's dialect, DuckDB text).
SURFACE = {
    "cte_multi": (
        "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY o_custkey), seg AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_mktsegment, COUNT(*) AS n, MAX(spent) AS most FROM big JOIN seg ON o_custkey = c_custkey GROUP BY c_mktsegment",
        "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY o_custkey), seg AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, MAX(spent) AS most FROM big JOIN seg ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "recursive_series": (
        "WITH RECURSIVE s(k, label) AS (SELECT 1, 'day 1' UNION ALL SELECT k + 1, CONCAT('day ', k + 1) FROM s WHERE k < 50) SELECT CAST(k AS BIGINT) AS k, label FROM s",
        "WITH RECURSIVE s(k, label) AS (SELECT 1, 'day 1' UNION ALL SELECT k + 1, 'day ' || (k + 1) FROM s WHERE k < 50) SELECT CAST(k AS BIGINT) AS k, label FROM s",
    ),
    "scalar_subquery": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))", None),
    "not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 100000)", None),
    "left_join_count": ("SELECT c_nationkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey", "SELECT c_nationkey, CAST(COUNT(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey"),
    "having": ("SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 5", "SELECT l_suppkey, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 5"),
    "case_agg": (
        "SELECT l_returnflag, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS large, SUM(IIF(l_quantity > 25, 0, 1)) AS small FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(SUM(CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END) AS BIGINT) AS small FROM lineitem GROUP BY l_returnflag",
    ),
    "window_rank": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, LAG(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
        "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS dr, LAG(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    ),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10, 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10"),
    "date_bucket": ("SELECT STRFTIME('%Y-%m', o_orderdate) AS ym, COUNT(*) AS n FROM orders GROUP BY ym", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY ym"),
    "like_between": ("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%build%' AND c_nationkey BETWEEN 3 AND 12", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_nationkey BETWEEN 3 AND 12"),
    "derived_table": ("SELECT status, MAX(n) AS most FROM (SELECT o_orderstatus AS status, o_custkey, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) AS t GROUP BY status", "SELECT status, CAST(MAX(n) AS BIGINT) AS most FROM (SELECT o_orderstatus AS status, o_custkey, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) AS t GROUP BY status"),
    "set_operations": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey > 3", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)", None),
    "text_functions": ("SELECT c_custkey, SUBSTR(c_mktsegment, 1, 3) AS head, REPLACE(c_mktsegment, 'A', '*') AS masked, UPPER(c_mktsegment) || '-' || CAST(c_nationkey AS STRING) AS tag, INSTR(c_mktsegment, 'I') AS at FROM customer", "SELECT c_custkey, SUBSTR(c_mktsegment, 1, 3) AS head, REPLACE(c_mktsegment, 'A', '*') AS masked, UPPER(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR) AS tag, CAST(INSTR(c_mktsegment, 'I') AS INTEGER) AS at FROM customer"),
    "real_ratio": ("SELECT l_returnflag, CAST(COUNT(*) AS REAL) / 3 AS third FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(COUNT(*) AS DOUBLE) / 3 AS third FROM lineitem GROUP BY l_returnflag"),
    "whole_quotient": (
        "SELECT o_orderstatus, COUNT(*) / COUNT(DISTINCT o_custkey) AS per, 7 / 2 AS three, COUNT(*) / 4 AS quarter, CAST(COUNT(*) AS REAL) / 4 AS part FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, CAST(COUNT(*) // COUNT(DISTINCT o_custkey) AS BIGINT) AS per, CAST(3 AS BIGINT) AS three, CAST(COUNT(*) // 4 AS BIGINT) AS quarter, COUNT(*)::DOUBLE / 4 AS part FROM orders GROUP BY o_orderstatus",
    ),
    "other_names": (
        "SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_regionkey) AS keys, PRINTF('%05d', n_regionkey) AS padded, TOTAL(n_nationkey) AS total, IFNULL(NULL, CAST(n_regionkey AS TEXT)) AS name, COUNT(\"n_name\") AS n FROM `nation` GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(n_regionkey AS VARCHAR) AS keys, printf('%05d', n_regionkey) AS padded, sum(n_nationkey)::DOUBLE AS total, CAST(n_regionkey AS VARCHAR) AS name, CAST(count(n_name) AS BIGINT) AS n FROM nation GROUP BY n_regionkey",
    ),
    "julian_days": ("SELECT o_orderkey, JULIANDAY(o_orderdate) AS day FROM orders", "SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP) / 86400.0::DOUBLE + 2440587.5::DOUBLE AS day FROM orders"),
    "join_aggregate": (
        "SELECT r_name, o_orderstatus, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name, o_orderstatus",
        "SELECT r_name, o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name, o_orderstatus",
    ),
}


def _query(source: str):
    def query(spark, sf_dir):
        for name in TABLES:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(to_spark(source))

    return query


QUERIES = {name: (_query(source), oracle or source) for name, (source, oracle) in SURFACE.items()}
