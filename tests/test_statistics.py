"""Figures of a graph: relations are gone over once, and what is written is one row for each pair of names."""

from graphweave.operators import components, graph
from graphweave.queries import base


def test_figures_of_a_graph_are_from_one_pass(spark, monkeypatch):
    rows = [(1, "a", "b", "r", 1.0, "c1"), (2, "a", "b", "r", 1.0, "c1"), (3, "b", "a", "s", 1.0, "c2"), (4, "c", "c", "r", 1.0, None), (5, "d", "e", "r", 1.0, "c"), (6, "x", "a", "r", 1.0, "c")]
    m = spark.createDataFrame(rows, "ord long, source string, target string, relation_type string, weight double, chunk_id string")
    names = spark.createDataFrame([(n, 2) for n in "abcdef"], "name string, mention_count long")
    merged, counted = graph.merge_relations(m, names), graph.merge_counts(m, names)
    keys = ["source", "target", "relation_type", "mention_count"]
    assert counted.columns == keys and sorted(map(tuple, counted.collect())) == sorted(map(tuple, merged.select(keys).collect()))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "chunk_id" not in plan.split("LogicalRDD")[0]
    written = []
    for module in (graph, components):
        monkeypatch.setattr(module, "save", lambda df, real=module.save: written.append(df.columns) or real(df))
    got = graph.statistics(names, counted).first()
    assert tuple(got) == (6, 4, 12, 5, 2 * 3 / 6, 2 * 3 / 30, 4)
    # Pairs once, then nodes; the edges are not written a second time before the first round.
    assert written[:2] == [["u", "v", "n", "mentions"], ["node", "root"]]
    assert tuple(graph.statistics(names, merged.limit(0)).first()) == (6, 0, 12, 0, 0, 0, 6)


def test_the_query_merges_without_chunks(spark, monkeypatch):
    from graphweave.queries import graph as queries

    monkeypatch.setattr(queries, "relations", None)
    got = queries.graph_statistics(spark, "/root/testdata/sf0.001").first()
    assert got["relations"] == base.relations(spark, "/root/testdata/sf0.001").count()
