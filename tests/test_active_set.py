"""Local moving over what has moved only: rounds shrink, and results stay as good."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.operators import community
from graphweave.sources.scratch import save
from tests.test_engine import quality


def planted(seed, groups=40, size=12):
    r = random.Random(seed)
    edges = {(min(a, b), max(a, b)) for g in range(groups) for a in range(g * size, g * size + size) for b in r.sample(range(g * size, g * size + size), 5) if a != b}
    edges |= {(a, b) for a, b in ((r.randrange(groups * size), r.randrange(groups * size)) for _ in range(groups * 4)) if a < b}
    return sorted(edges)


def start(spark, edges):
    e = spark.createDataFrame([(0, a, b, 1.0) for a, b in edges], "graph long, u long, v long, weight double")
    arcs = e.select("graph", F.col("u").alias("a"), F.col("v").alias("b"), "weight")
    arcs = save(arcs.unionByName(arcs.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    nodes = arcs.groupBy("graph", F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    return save(nodes.select("graph", "node", F.col("node").alias("c"), "k", F.lit(2.0 * len(edges)).alias("total"))), arcs


def test_rounds_shrink_and_the_result_is_as_good(spark, caplog):
    edges = planted(1)
    nodes, arcs = start(spark, edges)
    weighed = []
    got = {r.node: r.c for r in community._local(nodes, arcs, 1.0, EngineConfig(), weighed).collect()}
    assert weighed[0] == 2 * len(edges) and len(weighed) > 2
    assert weighed[-1] < 0.5 * weighed[0] and sum(weighed) < 0.9 * len(weighed) * weighed[0]
    named = [(a, b, 1.0) for a, b in edges]
    truth = {n: n // 12 for n in got}
    assert quality(named, got) >= 0.8 * quality(named, truth)
    assert not caplog.records
    nodes, arcs = start(spark, edges)
    community._local(nodes, arcs, 1.0, replace(EngineConfig(), community_rounds=2))
    assert "ended after 2 rounds" in caplog.text


def test_invariants_of_a_hierarchy(spark):
    """Cover, nesting, sizes and connectedness of Leiden's communities; the figures see what is wrong with others."""
    from graphweave.queries.graph import invariants

    edges = planted(2, groups=6, size=10)
    named = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in edges], "u string, v string, weight double")
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)], "name string")  # one of them without edges
    found = community.hierarchy(names, named, replace(EngineConfig(), community_algorithm="leiden", max_community_levels=2, max_cluster_size=5))
    floor = spark.createDataFrame([(0.3,)], "q double")
    figures = {r["figure"]: r["value"] for r in invariants(found, names, named, floor).collect()}
    assert figures == {"covered": 61, "repeated": 0, "outside_parent": 0, "wrong_size": 0, "in_parts": 0, "modularity_up_to_floor": 0.3}
    wrong = spark.createDataFrame([("A", 0, None, 3, "n000"), ("A", 0, None, 3, "n060"), ("B", 0, None, 1, "n000"), ("C", 1, "A", 1, "n005")], "id string, level int, parent_id string, size long, name string")
    figures = {r["figure"]: r["value"] for r in invariants(wrong, names, named, floor).collect()}
    assert figures["covered"] == 2 and figures["repeated"] == figures["outside_parent"] == figures["wrong_size"] == figures["in_parts"] == 1 and figures["modularity_up_to_floor"] < 0.3


def test_a_large_graph_shuffles_sums_and_no_edges(spark, monkeypatch):
    """Edges lie in buckets by the end whose community is asked for; moves are those of a small graph."""
    nodes, arcs = start(spark, planted(3))
    nodes = nodes.withColumn("was", F.col("c"))
    want = {r.node: r.c for r in community._half(nodes, arcs, None, 1.0, 0, 42)[0].collect()}
    plans, real = [], community.save
    monkeypatch.setattr(community, "BUCKET_ARCS", 500)
    monkeypatch.setattr(community, "save", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    dealt = community._dealt(arcs, arcs.count())
    got = {r.node: r.c for r in community._half(nodes, dealt, None, 1.0, 0, 42)[0].collect()}
    assert got == want and len(set(got.values())) < len(got)
    lines = plans[-1].splitlines()
    at = next(i for i, x in enumerate(lines) if "SelectedBucketsCount" in x)
    join = max(i for i, x in enumerate(lines[:at]) if "ShuffledHashJoin" in x)
    assert not any("Exchange" in x for x in lines[join:at])
