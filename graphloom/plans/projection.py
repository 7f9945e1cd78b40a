"""The driver's star schema seen as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str, topics: bool = False) -> Graph:
    """Regions own nations, nations own suppliers and customers (services), these call orders,
    expose or reach parts (APIs) and use part types (databases); with `topics`, brands as topics."""
    t = lambda name: table(spark, sf_dir, name)

    def nodes(df: DataFrame, id_, label: str, name: str, path=None) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), (F.lit(None).cast("string") if path is None else F.col(path)).alias("path"))

    def edges(df: DataFrame, src, dst, kind: str, confidence: str | None = None, distinct: bool = False) -> DataFrame:
        pairs = df.select(src.alias("src"), dst.alias("dst"))
        pairs = pairs.distinct() if distinct else pairs
        return pairs.select("src", "dst", F.lit(kind).alias("type"), F.lit(confidence).cast("string").alias("confidence"))

    part, lineitem = t("part"), t("lineitem")
    types = part.select("p_type").distinct()
    n = [
        nodes(t("region"), _key("region", "r_regionkey"), "Repo", "r_name"),
        nodes(t("nation"), _key("nation", "n_nationkey"), "Team", "n_name"),
        nodes(t("supplier"), _key("supplier", "s_suppkey"), "Service", "s_name"),
        nodes(t("customer"), _key("customer", "c_custkey"), "Service", "c_name"),
        nodes(t("orders"), _key("order", "o_orderkey"), "Function", "o_orderkey"),
        nodes(part, _key("part", "p_partkey"), "API", "p_name", "p_type"),
        nodes(types, _key("db", "p_type"), "Database", "p_type"),
    ]
    e = [
        edges(t("nation"), _key("region", "n_regionkey"), _key("nation", "n_nationkey"), "CONTAINS"),
        edges(t("supplier"), _key("nation", "s_nationkey"), _key("supplier", "s_suppkey"), "OWNS"),
        edges(t("customer"), _key("nation", "c_nationkey"), _key("customer", "c_custkey"), "OWNS"),
        edges(t("orders"), _key("customer", "o_custkey"), _key("order", "o_orderkey"), "CALLS", "HIGH"),
        edges(lineitem, _key("order", "l_orderkey"), _key("part", "l_partkey"), "CALLS_API", "MEDIUM", distinct=True),
        edges(lineitem, _key("supplier", "l_suppkey"), _key("part", "l_partkey"), "EXPOSES", "LOW", distinct=True),
        edges(part, _key("part", "p_partkey"), _key("db", "p_type"), "USES"),
    ]
    if topics:
        n.append(nodes(part.select("p_brand").distinct(), _key("topic", "p_brand"), "Topic", "p_brand"))
        sold = lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        e.append(edges(sold, _key("supplier", "l_suppkey"), _key("topic", "p_brand"), "PRODUCES", "HIGH", distinct=True))
        bought = sold.select("l_orderkey", "p_brand").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        e.append(edges(bought, _key("customer", "o_custkey"), _key("topic", "p_brand"), "CONSUMES", "HIGH", distinct=True))
    return Graph(reduce(DataFrame.unionByName, n), reduce(DataFrame.unionByName, e))


#: The same projection in SQL, as common table expressions.
STAR_SQL = """
nodes(id, label, name, path) AS (
  SELECT 'region:' || r_regionkey, 'Repo', r_name, NULL FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Team', n_name, NULL FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Service', s_name, NULL FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'Service', c_name, NULL FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'Function', CAST(o_orderkey AS VARCHAR), NULL FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'API', p_name, p_type FROM part
  UNION ALL SELECT DISTINCT 'db:' || p_type, 'Database', p_type, NULL FROM part
  UNION ALL SELECT DISTINCT 'topic:' || p_brand, 'Topic', p_brand, NULL FROM part),
edges(src, dst, type, confidence) AS (
  SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'CONTAINS', NULL FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'OWNS', NULL FROM supplier
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'OWNS', NULL FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS', 'HIGH' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CALLS_API', 'MEDIUM' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'EXPOSES', 'LOW' FROM lineitem
  UNION ALL SELECT 'part:' || p_partkey, 'db:' || p_type, 'USES', NULL FROM part
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'topic:' || p_brand, 'PRODUCES', 'HIGH' FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'topic:' || p_brand, 'CONSUMES', 'HIGH'
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
STAR_SQL_NO_TOPICS = "nodes AS (SELECT * FROM nodes_ WHERE label <> 'Topic'), edges AS (SELECT * FROM edges_ WHERE type NOT IN ('PRODUCES', 'CONSUMES'))"
