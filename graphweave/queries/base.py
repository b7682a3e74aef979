"""What the registered queries share: registration, tables, and SQL of the table graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.scratch import save
from ..sources.table_graph import entity_mentions, relation_mentions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_entities(entity_mentions(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str, reuse: bool = False) -> DataFrame:
    """reuse: written once, for queries that read them several times."""
    r = graph.merge_relations(relation_mentions(spark, sf_dir), entities(spark, sf_dir))
    return save(r) if reuse else r


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


#: em, rm: mentions; e, r: merged; u: undirected edges.
GRAPH = """WITH RECURSIVE em AS (
  SELECT r_regionkey::BIGINT AS ord, r_name AS name, 'REGION' AS type, r_name AS description, 'region_' || r_regionkey AS chunk_id FROM region
  UNION ALL SELECT 1000000000000 + n_nationkey, n_name, 'NATION', 'nation of region ' || n_regionkey, 'nation_' || n_nationkey FROM nation
  UNION ALL SELECT 2000000000000 + c_custkey, c_name, 'CUSTOMER', c_mktsegment, 'customer_' || c_custkey FROM customer
  UNION ALL SELECT 3000000000000 + s_suppkey, s_name, 'SUPPLIER', 'supplier', 'supplier_' || s_suppkey FROM supplier
  UNION ALL SELECT 4000000000000 + p_partkey, p_name, 'PART', p_brand || ' ' || p_type, 'part_' || p_partkey FROM part),
rm AS (
  SELECT 5000000000000 + c_custkey AS ord, c_name AS source, n_name AS target, 'LOCATED_IN' AS relation_type, 1.0::DOUBLE AS weight, 'customer_' || c_custkey AS chunk_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 6000000000000 + s_suppkey, s_name, n_name, 'LOCATED_IN', 1.0, 'supplier_' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 7000000000000 + n_nationkey, n_name, r_name, 'PART_OF', 1.0, 'nation_' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 8000000000000 + l_orderkey * 10 + l_linenumber, c_name, p_name, 'ORDERED', l_quantity, 'order_' || o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 9000000000000 + l_orderkey * 10 + l_linenumber, s_name, p_name, 'SUPPLIES', 1.0, 'order_' || l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 10000000000000 + o_orderkey, c_name, 'Order#' || o_orderkey, 'PLACED', 1.0, 'order_' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT name, arg_min(type, ord) AS type, count(*)::BIGINT AS mention_count, count(DISTINCT chunk_id)::BIGINT AS n_chunks FROM em GROUP BY name),
r AS (SELECT source, target, relation_type, sum(weight) AS weight, count(*)::BIGINT AS mention_count, count(DISTINCT chunk_id)::BIGINT AS n_chunks FROM rm
  WHERE source IN (SELECT name FROM e) AND target IN (SELECT name FROM e) GROUP BY ALL),
u AS (SELECT least(source, target) AS u, greatest(source, target) AS v, sum(weight) AS weight FROM r GROUP BY ALL),
d AS (SELECT e.name, coalesce(n, 0)::BIGINT AS degree FROM e LEFT JOIN (SELECT name, count(*) AS n FROM (SELECT u AS name FROM u UNION ALL SELECT v FROM u) GROUP BY name) x USING (name))
"""
