"""Resolution, merging, descriptions, pruning, components, communities."""

import random
from dataclasses import replace

import pytest

from graphweave.config import EngineConfig
from graphweave.operators import claims, community, describe, graph, prune, resolution
from graphweave.operators.components import components

EM = "ord long, name string, type string, description string, mention_count long, chunk_id string"
RM = "ord long, source string, target string, relation_type string, description string, weight double, chunk_id string"


def ents(spark, names, **kw):
    return spark.createDataFrame([(i, n, "T", n, kw.get("count", 1), f"c{i}") for i, n in enumerate(names)], EM)


def rels(spark, edges):
    return spark.createDataFrame([(i, e[0], e[1], "R", "d", float(e[2]) if len(e) > 2 else 1.0, f"c{i}") for i, e in enumerate(edges)], RM)


def build(spark, names, edges):
    e = graph.merge_entities(ents(spark, names))
    return e, graph.merge_relations(rels(spark, edges), e)


def test_resolution(spark):
    m = spark.createDataFrame([(0, "Acme", "Organization", "", 1, "c1"), (1, "ACME!", "ORGANIZATION", "", 1, "c2"), (2, "Bob", "PERSON", "", 1, "c2"), (3, "Mercury", "PLANET", "", 1, "c1"), (4, "MERCURY", "ORGANIZATION", "", 1, "c1")], EM)
    got = {(r.name, r.type): r.canonical for r in resolution.resolve_entities(m, exact=True).collect()}
    assert got == {("Acme", "ORGANIZATION"): "Acme", ("ACME!", "ORGANIZATION"): "Acme", ("Bob", "PERSON"): "Bob", ("Mercury", "PLANET"): "Mercury", ("MERCURY", "ORGANIZATION"): "MERCURY"}
    r = spark.createDataFrame([(0, "ACME!", "Bob", " employs ", "", 1.0, "c2"), (1, "Zed", "Bob", "X", "", 1.0, "c2")], RM)
    out = resolution.resolve_relations(r, resolution.raw_name_map(m)).orderBy("ord").collect()
    assert [(x.source, x.relation_type) for x in out] == [("Acme", "EMPLOYS"), ("Zed", "X")]
    rep = resolution.resolution_report(m).first()
    assert (rep.mentions, rep.canonical_entities, rep.aliases_merged) == (5, 4, 1)


def test_merge(spark):
    e, r = build(spark, ["Alice", "Acme", "Acme"], [("Alice", "Acme"), ("Alice", "Acme"), ("Acme", "Alice"), ("Alice", "Nobody")])
    rows = {(x.source, x.target): x for x in r.collect()}
    assert set(rows) == {("Alice", "Acme"), ("Acme", "Alice")} and rows["Alice", "Acme"].weight == 2.0 and rows["Alice", "Acme"].n_chunks == 2
    u = graph.undirected(r).collect()
    assert len(u) == 1 and u[0].weight == 3.0
    s = graph.statistics(e, r).first()
    assert (s.entities, s.relations, s.components, s.avg_degree, s.density) == (2, 2, 1, 1.0, 1.0)


def test_neighbors(spark):
    e, r = build(spark, list("abcdz"), [("a", "b"), ("b", "c"), ("d", "c"), ("a", "a")])
    seeds = spark.createDataFrame([("q1", "a"), ("q2", "d"), ("q3", "z")], "q string, name string")
    got = sorted(map(tuple, graph.neighbors(seeds, graph.undirected(r), 2, by=("q",)).select("q", "name", "depth").collect()))
    assert got == [("q1", "b", 1), ("q1", "c", 2), ("q2", "b", 2), ("q2", "c", 1)]
    d = {x.name: x.degree for x in graph.degrees(e, graph.undirected(r)).collect()}
    assert d == {"a": 3, "b": 2, "c": 2, "d": 1, "z": 0}


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    for n, m in ((300, 200), (100, 400), (400, 399)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != n - 1 else [(i, i + 1) for i in range(n - 1)]
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_describe(spark):
    m = spark.createDataFrame([(i, "A", "T", d, 1, "c") for i, d in enumerate(["b ", "a", "b", " ", None] + [f"x{i}" for i in range(20)])] + [(99, "E", "T", "", 1, "c")], EM)
    got = {x.name: x for x in describe.consolidate(m, "name").collect()}
    assert got["A"].n_mentions == 12 and got["A"].description.startswith("b | a | x0") and got["E"].description == ""


def test_prune(spark):
    on = replace(EngineConfig(), prune_enabled=True)
    e, r = build(spark, ["A", "B", "C", "Z"], [("A", "B", 1.0), ("B", "C", 5.0)])
    half = prune.prune(e, r, replace(on, min_edge_weight_percentile=50.0))
    assert half.threshold.first()[0] == 3.0 and half.relations.count() == 1 and half.entities.count() == 4
    lcc = prune.prune(e, r, replace(on, largest_component_only=True))
    assert sorted(x.name for x in lcc.entities.collect()) == ["A", "B", "C"] and lcc.removed.count() == 0
    star, sr = build(spark, ["h", "x", "y", "z"], [("h", "x"), ("h", "y"), ("h", "z")])
    ego = prune.prune(star, sr, replace(on, remove_ego_nodes=True))
    assert [tuple(x) for x in ego.removed.collect()] == [("h", ["ego_node"])] and ego.relations.count() == 0
    rep = prune.prune_report(star, sr, ego).first()
    assert (rep.entities_before, rep.entities_after, rep.relations_before, rep.relations_after, rep.nodes_with_reason) == (4, 3, 3, 0, 1)
    off = prune.prune(e, r, EngineConfig())
    assert off.entities.count() == 4 and off.threshold.first()[0] == 0.0
    tie, tr = build(spark, list("abcd"), [("c", "d"), ("a", "b")])
    assert sorted(x.name for x in graph.largest_component(tie.select("name"), graph.undirected(tr)).collect()) == ["a", "b"]
    assert prune.edge_threshold(r.limit(0), 50.0).first()[0] == 0.0


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_communities(spark, algorithm):
    cliques = [[f"{c}{i}" for i in range(6)] for c in "abcd"]
    edges = [(x, y, 1.0) for c in cliques for i, x in enumerate(c) for y in c[:i]] + [("a0", "b0", 0.5), ("c0", "d0", 0.5)]
    e, r = build(spark, [x for c in cliques for x in c] + ["lone"], edges)
    config = replace(EngineConfig(), community_algorithm=algorithm, max_cluster_size=4, max_community_levels=2)
    rows = community.hierarchy(e, graph.undirected(r), config).collect()
    top = {}
    for x in rows:
        if x.level == 0:
            assert x.name not in top
            top[x.name] = x.id
    assert set(top) == {x for c in cliques for x in c} | {"lone"}
    assert all(len({top[x] for x in c}) == 1 for c in cliques) and len(set(top.values())) == 5
    assert sorted(set(top.values())) == [f"L0_C{i}" for i in range(5)] and top["a0"] == "L0_C0"
    for x in rows:
        if x.level == 1:
            assert top[x.name] == x.parent_id


def test_levels_and_modularity(spark):
    c = spark.createDataFrame([(0,), (2,)], "level int")
    assert [community.choose_level(c, n).first()[0] for n in (1, 3, 0)] == [0, 2, 0]
    assert community.choose_level(c.filter("level = 2"), 1).first()[0] == 2 and community.choose_level(c.limit(0), 1).first()[0] == 0
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    members = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "name string, c string")
    assert community.modularity(edges, members).first()[0] == pytest.approx(0.5)


def test_claims(spark):
    a = spark.createDataFrame([(0, "Acme", "Acme"), (0, "Acme", "ACME Inc"), (1, "Bob", "Bob"), (2, "Other", "acme")], "ord long, name string, alias string")
    lookup = claims.alias_lookup(a)
    assert {x.surface: x.name for x in lookup.collect()} == {"acme": "Acme", "acme inc": "Acme", "bob": "Bob"}
    raw = spark.createDataFrame(
        [(0, "c0", "ACME!", "bob", "EMPLOYS", "true", "first"), (1, "c0", "ACME!", "the moon", "EMPLOYS", "odd", "second"), (2, "c0", "nobody", "bob", "X", None, "third"), (3, "c0", "Bob", None, " ", None, "fourth"), (4, "c0", "Bob", None, "T", None, "  ")],
        "ord long, chunk_id string, subject string, object string, type string, status string, description string")
    got = [(x.subject_id, x.object_id, x.type, x.status) for x in claims.resolve(raw, lookup).orderBy("ord").collect()]
    assert got == [("Acme", "Bob", "EMPLOYS", "TRUE"), ("Acme", "the moon", "EMPLOYS", "UNKNOWN"), ("Bob", None, "FACT", "UNKNOWN")]
    ids = claims.resolve(raw, lookup).withColumn("id", claims.claim_id("text_unit_id", "subject_id", "object_id", "raw_type", "description"))
    assert all(x.id.startswith("claim_") and len(x.id) == 22 for x in ids.collect())


def test_lookups(spark):
    m = spark.createDataFrame([("L0_C1", 0, "a"), ("L1_C0", 1, "a"), ("L0_C0", 0, "b")], "id string, level int, name string")
    assert {x.name: x.id for x in graph.community_of(m).collect()} == {"a": "L0_C1", "b": "L0_C0"}
    both = graph.merge_entities(graph.merge_graphs(ents(spark, ["A", "B"]), ents(spark, ["A"])))
    assert graph.entity(both, "A").first().mention_count == 2
