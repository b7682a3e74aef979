"""Mentions out of relational tables: rows become entities, foreign keys relations.

ord numbers the mentions, so that what came first is a property of the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = 1_000_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, name, type, description, mention_count, chunk_id)."""

    def of(table: str, kind: int, key: str, name: str, description) -> DataFrame:
        return _table(spark, sf_dir, table).select(
            (F.lit(kind * KIND) + F.col(key)).cast("long").alias("ord"), F.col(name).alias("name"), F.lit(table.upper()).alias("type"), description.alias("description"),
            F.lit(1).cast("long").alias("mention_count"), F.concat(F.lit(f"{table}_"), F.col(key).cast("string")).alias("chunk_id"))

    parts = [
        of("region", 0, "r_regionkey", "r_name", F.col("r_name")),
        of("nation", 1, "n_nationkey", "n_name", F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string"))),
        of("customer", 2, "c_custkey", "c_name", F.col("c_mktsegment")),
        of("supplier", 3, "s_suppkey", "s_name", F.lit("supplier")),
        of("part", 4, "p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, target, relation_type, weight, chunk_id); customers also point to orders, which are no entities."""
    t = {x: _table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    row = lambda kind, key, source, target, name, weight, chunk: [(F.lit(kind * KIND) + key).cast("long").alias("ord"), F.col(source).alias("source"), target.alias("target"), F.lit(name).alias("relation_type"), weight.cast("double").alias("weight"), chunk.alias("chunk_id")]
    one = F.lit(1.0)
    nation, part = t["nation"].select(F.col("n_nationkey").alias("k"), "n_name"), t["part"].select("p_partkey", "p_name")
    order = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # Nations, regions and suppliers are dimension tables, parts a middle one: Spark broadcasts by their size.
    lines = t["lineitem"].join(part, F.col("l_partkey") == F.col("p_partkey"))
    bought = lines.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"].select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    sold = lines.join(t["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    parts = [
        t["customer"].join(nation, F.col("c_nationkey") == F.col("k")).select(*row(5, F.col("c_custkey"), "c_name", F.col("n_name"), "LOCATED_IN", one, F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")))),
        t["supplier"].join(nation, F.col("s_nationkey") == F.col("k")).select(*row(6, F.col("s_suppkey"), "s_name", F.col("n_name"), "LOCATED_IN", one, F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")))),
        t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(*row(7, F.col("n_nationkey"), "n_name", F.col("r_name"), "PART_OF", one, F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")))),
        bought.select(*row(8, at, "c_name", F.col("p_name"), "ORDERED", F.col("l_quantity"), order)),
        sold.select(*row(9, at, "s_name", F.col("p_name"), "SUPPLIES", one, F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")))),
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(*row(10, F.col("o_orderkey"), "c_name", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), "PLACED", one, order)),
    ]
    return reduce(DataFrame.unionByName, parts)
