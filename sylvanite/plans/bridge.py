"""Labelled graph collections derived from the driver's tables; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_V = """
  SELECT CAST(o_orderkey AS BIGINT) AS graph_id, CAST(0 AS BIGINT) AS vid, replace(o_orderpriority, ' ', '_') AS label FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS BIGINT), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT),
         concat(l_returnflag, l_linestatus)
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
ORDER_E = """
  SELECT CAST(l_orderkey AS BIGINT) AS graph_id, CAST(0 AS BIGINT) AS src,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS dst,
         CAST(CAST(floor(l_quantity / 20) AS BIGINT) AS VARCHAR(9)) AS label
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
_EVENTS = """
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events"""
USER_V = f"""
  SELECT CAST(user_id AS BIGINT) AS graph_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS BIGINT) AS vid, event_type AS label
  FROM (SELECT DISTINCT user_id, event_type FROM ({_EVENTS}) AS e) AS t"""
USER_E = f"""
  SELECT DISTINCT v.graph_id, v.vid AS src, w.vid AS dst, '1' AS label
  FROM (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY r) AS b FROM ({_EVENTS}) AS e) AS p
  JOIN ({USER_V}) AS v ON v.graph_id = p.user_id AND v.label = least(p.a, p.b)
  JOIN ({USER_V}) AS w ON w.graph_id = p.user_id AND w.label = greatest(p.a, p.b)
  WHERE p.b IS NOT NULL AND p.a <> p.b"""
CONV_V = """
  SELECT CAST(conv_id AS BIGINT) AS graph_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS vid, role AS label FROM conversations"""
CONV_E = """
  SELECT graph_id, vid - 1 AS src, vid AS dst, '1' AS label FROM (
    SELECT CAST(conv_id AS BIGINT) AS graph_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS vid FROM conversations) AS c WHERE vid > 0"""

#: a user's events are one session as long as none comes 12 hours after the one before
_SESSIONS = """
  SELECT CAST(user_id * 10000 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS graph_id, event_type, ts, event_id
  FROM (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12' HOUR >= ts THEN 0 ELSE 1 END AS new FROM events) AS f"""
SESSION_V = f"""
  SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY event_type) - 1 AS BIGINT) AS vid, event_type AS label FROM (SELECT DISTINCT graph_id, event_type FROM ({_SESSIONS}) AS s) AS t"""
SESSION_E = f"""
  SELECT DISTINCT v.graph_id, v.vid AS src, w.vid AS dst, '1' AS label
  FROM (SELECT graph_id, event_type AS a, lead(event_type) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS b FROM ({_SESSIONS}) AS s) AS p
  JOIN ({SESSION_V}) AS v ON v.graph_id = p.graph_id AND v.label = least(p.a, p.b)
  JOIN ({SESSION_V}) AS w ON w.graph_id = p.graph_id AND w.label = greatest(p.a, p.b)
  WHERE p.b IS NOT NULL AND p.a <> p.b"""

VIEWS = {"session": (SESSION_V, SESSION_E), "order": (ORDER_V, ORDER_E), "user": (USER_V, USER_E), "conv": (CONV_V, CONV_E)}
TABLES = {"session": ("events",), "order": ("orders", "lineitem"), "user": ("events",), "conv": ("conversations",)}


def vertices(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _sql(spark, sf_dir, name, 0)


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _sql(spark, sf_dir, name, 1)


def _sql(spark: SparkSession, sf_dir: str, name: str, k: int) -> DataFrame:
    return spark.sql(_named(VIEWS[name][k]), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})


def _named(sql: str) -> str:
    for t in ("orders", "lineitem", "events", "conversations"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql


def graphs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row for each graph."""
    from ..sources.graphs import assemble

    return assemble(vertices(spark, sf_dir, name), edges(spark, sf_dir, name)).withColumn("activity", F.pmod("graph_id", F.lit(3)).cast("long"))


def with_views(name: str, body: str) -> str:
    """DuckDB SQL with the views v and e."""
    v, e = VIEWS[name]
    return f"WITH RECURSIVE v AS ({v}), e AS ({e}) {body}"
