"""Named queries over the star-schema tables, each with the SQL that says the same (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: SQL for the canonical graph's edges and nodes, for use after WITH.
EDGES_SQL = """
edges AS (
  SELECT 'PLACED' AS rel, 'Customer' AS st, 'Order' AS dt, o_custkey AS src, o_orderkey AS dst, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_totalprice AS w FROM orders
  UNION ALL SELECT 'CONTAINS', 'Order', 'Part', l_orderkey, l_partkey, CAST(floor(epoch(l_shipdate)) AS BIGINT), l_quantity FROM lineitem
  UNION ALL SELECT 'SUPPLIEDBY', 'Order', 'Supplier', l_orderkey, l_suppkey, CAST(floor(epoch(l_shipdate)) AS BIGINT), l_quantity FROM lineitem
  UNION ALL SELECT 'LIVESIN', 'Customer', 'Nation', c_custkey, CAST(c_nationkey AS BIGINT), -1, 1.0 FROM customer
  UNION ALL SELECT 'LIVESIN', 'Supplier', 'Nation', s_suppkey, CAST(s_nationkey AS BIGINT), -1, 1.0 FROM supplier
  UNION ALL SELECT 'ISIN', 'Nation', 'Region', CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), -1, 1.0 FROM nation),
nodes AS (
  SELECT 0 AS ord, 'Customer' AS type, c_custkey AS id, CAST(-1 AS BIGINT) AS ts FROM customer
  UNION ALL SELECT 1, 'Order', o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) FROM orders
  UNION ALL SELECT 2, 'Part', p_partkey, -1 FROM part
  UNION ALL SELECT 3, 'Supplier', s_suppkey, -1 FROM supplier
  UNION ALL SELECT 4, 'Nation', CAST(n_nationkey AS BIGINT), -1 FROM nation
  UNION ALL SELECT 5, 'Region', CAST(r_regionkey AS BIGINT), -1 FROM region),
offs AS (SELECT type, ord, CAST(coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, n
         FROM (SELECT type, ord, count(*) AS n FROM nodes GROUP BY 1, 2)),
gnodes AS (SELECT n.type, n.id + o.lo AS gid, n.ts FROM nodes n JOIN offs o USING (type)),
gedges AS (SELECT e.rel, e.st, e.dt, e.src + a.lo AS src, e.dst + b.lo AS dst, e.ts, e.w FROM edges e JOIN offs a ON a.type = e.st JOIN offs b ON b.type = e.dt)
"""
#: SQL for the first eight hex digits of md5 as a number, over a text.
H = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
#: SQL for the user interaction edges.
USERS_SQL = """
users AS (SELECT event_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value AS w FROM events),
ue AS (SELECT * FROM users WHERE dst IS NOT NULL)
"""
#: SQL for the region partition of the nodes that have one.
REGIONS_SQL = """
regions AS (
  SELECT 'Region' AS type, CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS z FROM region
  UNION ALL SELECT 'Nation', n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'Supplier', s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Customer', c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Order', o_orderkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
z AS (SELECT r.id + o.lo AS gid, r.z FROM regions r JOIN offs o USING (type))
"""
