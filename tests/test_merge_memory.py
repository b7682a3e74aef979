"""Merging relations: what a task holds is its part of the mentions, not all that it reads."""

from pyspark.sql import functions as F

from graphweave.operators import graph


def mentions(spark, n):
    """n mentions of n / 2 relations; every chunk mentions a relation twice."""
    k = F.floor(F.col("id") / 2)
    return spark.range(n).select(
        F.col("id").alias("ord"), F.format_string("a %d", k % 7).alias("source"), F.format_string("b %d", k % 11).alias("target"), F.lit("R").alias("relation_type"),
        F.lit(1.5).alias("weight"), F.format_string("c %d", k).alias("chunk_id"))


def test_mentions_are_dealt_before_they_are_added_up(spark):
    names = spark.range(11).select(F.explode(F.array(F.format_string("a %d", "id"), F.format_string("b %d", "id"))).alias("name"))
    got = graph.merge_relations(mentions(spark, 77 * 40), names)
    rows = got.collect()
    assert len(rows) == 77 and {(r.weight, r.mention_count, r.n_chunks) for r in rows} == {(60.0, 40, 20)}
    assert sorted(r.first_ord for r in rows) == list(range(0, 154, 2))
    # No aggregate with chunks in its key stands before the first exchange, where a task would hold all that it reads.
    plan = got._jdf.queryExecution().executedPlan().toString()
    after = plan[plan.rindex("REPARTITION_BY_NUM"):]
    assert "Aggregate" not in after and "chunk_id" in after


def test_a_chunk_that_is_null_counts_as_none(spark):
    rows = [(1, "a", "b", "R", 1.0, None), (2, "a", "b", "R", 2.0, None), (3, "a", "b", "R", 4.0, "c")]
    m = spark.createDataFrame(rows, "ord long, source string, target string, relation_type string, weight double, chunk_id string")
    assert graph.merge_relations(m, spark.createDataFrame([("a",), ("b",)], "name string")).first()[3:] == (7.0, 3, 1, 1)
