"""Queries on the table graph: merging, algebra, descriptions, pruning, communities."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import community, describe, graph, prune, reports
from ..operators.components import components
from ..sources.scratch import save, settle
from ..sources.table_graph import entity_mentions, relation_mentions
from .base import GRAPH, ORACLE, QUERIES, entities, longs, query, relations, table


@query(GRAPH + "SELECT name, type, mention_count, n_chunks FROM e")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("name", "type", "mention_count", "n_chunks")


@query(GRAPH + "SELECT * FROM r")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).drop("first_ord")


@query(GRAPH + "SELECT * FROM u")
def undirected_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(relations(spark, sf_dir))


@query(GRAPH + "SELECT * FROM d")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(entities(spark, sf_dir), graph.undirected(relations(spark, sf_dir)))


@query(GRAPH + """, w AS (SELECT u AS a, v AS b FROM u UNION SELECT v, u FROM u),
s AS (SELECT r_name AS seed FROM region), h1 AS (SELECT DISTINCT seed, b AS name FROM s JOIN w ON a = seed WHERE b <> seed),
h2 AS (SELECT DISTINCT seed, w.b AS name FROM h1 JOIN w ON w.a = h1.name WHERE w.b <> seed)
SELECT seed, name, min(depth)::BIGINT AS depth FROM (SELECT seed, name, 1 AS depth FROM h1 UNION ALL SELECT seed, name, 2 FROM h2) GROUP BY ALL""")
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around every region, one search each."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("seed"), F.col("r_name").alias("name"))
    return longs(graph.neighbors(seeds, graph.undirected(relations(spark, sf_dir, True)), 2, by=("seed",)), "depth")


@query(GRAPH + ", n AS (SELECT name FROM e WHERE type IN ('NATION', 'SUPPLIER', 'PART')) SELECT source, target, relation_type, weight FROM r WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = entities(spark, sf_dir).filter(F.col("type").isin("NATION", "SUPPLIER", "PART"))
    return graph.induced(relations(spark, sf_dir), names).select("source", "target", "relation_type", "weight")


#: The smallest name that each node of the whole graph can reach; a node is looked at again only when its root changes.
ROOTS = """, ew AS (SELECT u AS a, v AS b FROM u WHERE u <> v UNION SELECT v, u FROM u WHERE u <> v),
root(name, root) USING KEY (name) AS (SELECT name, name FROM e UNION
  SELECT ew.b, min(root.root) FROM root JOIN ew ON ew.a = root.name JOIN recurring.root k ON k.name = ew.b GROUP BY ew.b HAVING min(root.root) < min(k.root))
"""


@query(GRAPH + ROOTS + "SELECT name, root AS component FROM root WHERE name IN (SELECT a FROM ew)")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by all relations, orders and supplies included."""
    return components(graph.undirected(relations(spark, sf_dir)).select("u", "v")).select(F.col("node").alias("name"), F.col("root").alias("component"))


@query(GRAPH + ROOTS + """, f AS (SELECT count(*) AS entities, sum(mention_count) AS em FROM e), g AS (SELECT count(*) AS relations, coalesce(sum(mention_count), 0) AS rm FROM r), m AS (SELECT count(*) AS edges FROM u)
SELECT entities::BIGINT AS entities, relations::BIGINT AS relations, em::BIGINT AS entity_mentions, rm::BIGINT AS relation_mentions, round(2.0::DOUBLE * edges / entities, 6) AS avg_degree,
  round(2.0::DOUBLE * edges / (entities::DOUBLE * (entities - 1)), 9) AS density, (SELECT count(DISTINCT root) FROM root)::BIGINT AS components FROM f, g, m""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the whole table graph."""
    e = entities(spark, sf_dir)
    s = graph.statistics(e, graph.merge_counts(relation_mentions(spark, sf_dir), e))
    s = s.withColumns({"avg_degree": F.round("avg_degree", 6), "density": F.round("density", 9)})
    return longs(s, "entities", "relations", "entity_mentions", "relation_mentions", "components")


@query(GRAPH + "SELECT name, type, mention_count, n_chunks FROM e")
def graph_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs over halves of the mentions, merged again."""
    m = entity_mentions(spark, sf_dir)
    return graph.merge_entities(graph.merge_graphs(m.filter("ord % 2 = 0"), m.filter("ord % 2 = 1"))).select("name", "type", "mention_count", "n_chunks")


@query(GRAPH + """, f AS (SELECT name, trim(description) AS x, min(ord) AS ord FROM em WHERE trim(description) <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, x) AS i FROM f)
SELECT name, count(*)::BIGINT AS n_mentions, string_agg(x, ' | ' ORDER BY i) AS description FROM k WHERE i <= 12 GROUP BY name""")
def describe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.consolidate(entity_mentions(spark, sf_dir), "name")


@query("""WITH f AS (SELECT user_id, event_type AS x, min(event_id) AS ord FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord, x) AS i FROM f)
SELECT user_id, count(*)::BIGINT AS n_mentions, string_agg(x, ' | ' ORDER BY i) AS description FROM k WHERE i <= 12 GROUP BY user_id""")
def describe_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("description"))
    return describe.consolidate(e, "user_id")


@query(GRAPH + """, f AS (SELECT source, target, relation_type, chunk_id AS x, min(ord) AS ord FROM rm GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source, target, relation_type ORDER BY ord, x) AS i FROM f)
SELECT source, target, relation_type, count(*)::BIGINT AS n_mentions, string_agg(x, ' | ' ORDER BY i) AS description FROM k WHERE i <= 12 GROUP BY ALL""")
def describe_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations described by the orders that mention them, the first twelve."""
    m = relation_mentions(spark, sf_dir).withColumn("description", F.col("chunk_id"))
    return describe.consolidate(m, "source", "target", "relation_type")


STRICT = replace(EngineConfig(), prune_enabled=True, min_node_frequency=2, max_node_frequency_std=2.0, min_node_degree=3, max_node_degree_std=2.0, remove_ego_nodes=True, min_edge_weight_percentile=50.0)
REASONS = """, s AS (SELECT e.name, greatest(mention_count, n_chunks) AS frequency, degree FROM e JOIN d USING (name)),
g AS (SELECT count(*) AS n, avg(frequency) AS fm, stddev_pop(frequency) AS fs, avg(degree) AS dm, stddev_pop(degree) AS ds FROM s),
q AS (SELECT name, concat_ws('|', CASE WHEN frequency < 2 THEN 'min_node_freq' END, CASE WHEN n > 1 AND frequency > fm + 2 * fs THEN 'max_node_freq_std' END, CASE WHEN degree < 3 THEN 'min_node_degree' END,
  CASE WHEN n > 1 AND degree > dm + 2 * ds THEN 'max_node_degree_std' END, CASE WHEN n > 2 AND degree >= n - 1 THEN 'ego_node' END) AS reasons FROM s, g)
"""


@query(GRAPH + REASONS + "SELECT name, reasons FROM q")
def prune_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = prune.node_statistics(entities(spark, sf_dir), relations(spark, sf_dir))
    return prune.node_reasons(stats, STRICT).select("name", F.array_join("reasons", "|").alias("reasons"))


@query(GRAPH + ", t AS (SELECT quantile_cont(weight, 0.5) AS threshold FROM r) SELECT source, target, relation_type, weight, threshold FROM r, t WHERE weight >= threshold")
def prune_edges_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir, True)
    return r.crossJoin(F.broadcast(prune.edge_threshold(r, 50.0))).filter("weight >= threshold").select("source", "target", "relation_type", "weight", "threshold")


@query(GRAPH + ROOTS + ", z AS (SELECT root, count(*) AS n FROM root GROUP BY ALL ORDER BY n DESC, root LIMIT 1) SELECT name FROM root WHERE root = (SELECT root FROM z)")
def prune_lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component by all relations."""
    return graph.largest_component(entities(spark, sf_dir).select("name"), graph.undirected(relations(spark, sf_dir)))


@query(GRAPH + REASONS + """, t AS (SELECT quantile_cont(weight, 0.5) AS threshold FROM r), k AS (SELECT name FROM q WHERE reasons = ''),
a AS (SELECT count(*) AS n FROM r, t WHERE weight >= threshold AND source IN (SELECT name FROM k) AND target IN (SELECT name FROM k))
SELECT (SELECT count(*) FROM e)::BIGINT AS entities_before, (SELECT count(*) FROM r)::BIGINT AS relations_before, (SELECT count(*) FROM k)::BIGINT AS entities_after, (SELECT n FROM a)::BIGINT AS relations_after,
  (SELECT count(*) FROM q WHERE reasons <> '')::BIGINT AS nodes_with_reason, threshold FROM t""")
def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = entities(spark, sf_dir), relations(spark, sf_dir, True)
    return prune.prune_report(e, r, prune.prune(e, r, STRICT))


#: Where an entity is: customers and suppliers in their nation, nations in themselves.
NATIONS = """, mem AS (SELECT source AS name, target AS c FROM r WHERE relation_type = 'LOCATED_IN' UNION SELECT n_name, n_name FROM nation),
pe AS (SELECT least(source, target) AS u, greatest(source, target) AS v, sum(weight) AS weight FROM r WHERE relation_type = 'LOCATED_IN' GROUP BY ALL)
"""


def nation_members(r: DataFrame, nation: DataFrame) -> DataFrame:
    return r.filter("relation_type = 'LOCATED_IN'").select(F.col("source").alias("name"), F.col("target").alias("c")).unionByName(nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("c"))).distinct()


#: Every node in a community: its nation's, else its own.
COVER = ", cov AS (SELECT e.name, coalesce(mem.c, e.name) AS c FROM e LEFT JOIN mem USING (name))"


def cover(e: DataFrame, members: DataFrame) -> DataFrame:
    return e.select("name").join(members, "name", "left").select("name", F.coalesce("c", "name").alias("c"))


@query(GRAPH + NATIONS + COVER + """, x AS (SELECT a.c AS cu, b.c AS cv, weight FROM u JOIN cov a ON a.name = u JOIN cov b ON b.name = v), m AS (SELECT sum(weight) AS m FROM x),
i AS (SELECT cu AS c, sum(weight) AS l FROM x WHERE cu = cv GROUP BY cu), t AS (SELECT c, sum(weight) AS k FROM (SELECT cu AS c, weight FROM x UNION ALL SELECT cv, weight FROM x) GROUP BY c)
SELECT round(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 9) AS q FROM t LEFT JOIN i USING (c), m""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities of the whole graph; parts and regions, in no nation, are communities of their own."""
    e, r = weighed(spark, sf_dir)
    return nations_modularity(spark, sf_dir, e, r, graph.undirected(r))


def weighed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities, and the relations with their weight alone, saved: communities look at nothing else."""
    e = save(entities(spark, sf_dir))
    return e, save(graph.merge_weights(relation_mentions(spark, sf_dir), e))


def nations_modularity(spark: SparkSession, sf_dir: str, e: DataFrame, r: DataFrame, edges: DataFrame) -> DataFrame:
    members = cover(e, nation_members(r, table(spark, sf_dir, "nation")))
    return community.modularity(edges, members).select(F.round("q", 9).alias("q"))


@query()
def louvain_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole table graph; tests hold their invariants and quality."""
    e, r = weighed(spark, sf_dir)
    return community.hierarchy(e, graph.undirected(r))


@query()
def leiden_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = weighed(spark, sf_dir)
    return community.hierarchy(e, graph.undirected(r), replace(EngineConfig(), community_algorithm="leiden"))


def invariants(communities: DataFrame, e: DataFrame, edges: DataFrame, floor: DataFrame) -> DataFrame:
    """(figure, value) of what does not depend on ties: entities covered by level 0, names that stand twice in a level,
    members outside their parent, sizes that are wrong, communities in several parts, and modularity, but no more than floor(q)."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("figure"), "value")
    members = save(communities)
    top = members.filter("level = 0")
    sizes = members.groupBy("id", "size").agg(F.count(F.lit(1)).alias("n"))
    parents = members.select(F.col("id").alias("parent_id"), "name")
    own = members.select("id", "name", F.concat_ws("|", "id", "name").alias("key"))
    ends = lambda end: own.select("id", F.col("name").alias(end), F.col("key").alias(f"{end}_key"))
    inner = edges.join(ends("u"), "u").join(ends("v"), ["id", "v"]).select(F.col("u_key").alias("u"), F.col("v_key").alias("v"))
    linked = components(inner).withColumnRenamed("node", "key").join(own, "key").groupBy("id").agg(F.countDistinct("root").alias("parts"), F.count(F.lit(1)).alias("linked"))
    parts = sizes.join(linked, "id", "left").select(F.coalesce("parts", F.lit(0)) + F.col("n") - F.coalesce("linked", F.lit(0)))
    q = community.modularity(edges, top.select("name", F.col("id").alias("c"))).crossJoin(floor.select(F.col("q").alias("floor")))  # one row each
    rows = [
        one(top.join(e.select("name"), "name", "left_semi").select("name").distinct(), "covered"), one(members.groupBy("level", "name").count().filter("count > 1"), "repeated"),
        one(members.filter("level > 0").join(parents, ["parent_id", "name"], "left_anti"), "outside_parent"), one(sizes.filter("n <> size"), "wrong_size"),
        one(parts.toDF("n").filter("n > 1"), "in_parts"), q.select(F.lit("modularity_up_to_floor").alias("figure"), F.round(F.least("q", "floor"), 6).alias("value")),
    ]
    return reduce(DataFrame.unionByName, rows)


@query(GRAPH + NATIONS + COVER + """, x AS (SELECT a.c AS cu, b.c AS cv, weight FROM u JOIN cov a ON a.name = u JOIN cov b ON b.name = v), m AS (SELECT sum(weight) AS m FROM x),
i AS (SELECT cu AS c, sum(weight) AS l FROM x WHERE cu = cv GROUP BY cu), t AS (SELECT c, sum(weight) AS k FROM (SELECT cu AS c, weight FROM x UNION ALL SELECT cv, weight FROM x) GROUP BY c)
SELECT 'covered' AS figure, count(*)::DOUBLE AS value FROM e UNION ALL SELECT unnest(['repeated', 'outside_parent', 'wrong_size', 'in_parts']), 0
UNION ALL SELECT 'modularity_up_to_floor', round(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 6) FROM t LEFT JOIN i USING (c), m""")
def leiden_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole table graph: cover, nesting, sizes, connectedness, and a modularity that is not below that of the nations."""

    def run() -> DataFrame:
        e, r = weighed(spark, sf_dir)
        edges = save(graph.undirected(r))
        found = community.hierarchy(e, edges, replace(EngineConfig(), community_algorithm="leiden"))
        return invariants(found, e, edges, nations_modularity(spark, sf_dir, e, r, edges))

    return settle(run)


@query("""WITH c AS (SELECT n_regionkey % 2 * 2 AS level FROM nation), q AS (SELECT unnest([0, 1, 3]) AS requested)
SELECT requested::BIGINT AS requested, coalesce(max(level) FILTER (level <= requested), min(level), 0)::BIGINT AS level FROM c, q GROUP BY requested""")
def choose_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").select((F.col("n_regionkey") % 2 * 2).alias("level"))
    out = None
    for n in (0, 1, 3):
        one = longs(community.choose_level(c, n), "level").select(F.lit(n).cast("long").alias("requested"), "level")
        out = one if out is None else out.unionByName(one)
    return out


@query(GRAPH + NATIONS + """, x AS (SELECT c AS id, name, type FROM (SELECT DISTINCT c, name FROM mem) JOIN e USING (name) QUALIFY row_number() OVER (PARTITION BY c ORDER BY name) <= 30),
i AS (SELECT a.c AS id, source, relation_type, target FROM r JOIN mem a ON a.name = r.source JOIN mem b ON b.name = r.target AND a.c = b.c QUALIFY row_number() OVER (PARTITION BY a.c ORDER BY source, target, relation_type) <= 40),
xs AS (SELECT id, string_agg(name || ':' || type, ',' ORDER BY name) AS entities FROM x GROUP BY id), rs AS (SELECT id, string_agg(source || '>' || relation_type || '>' || target, ',' ORDER BY source, target, relation_type) AS relations FROM i GROUP BY id)
SELECT xs.id, entities, coalesce(relations, '') AS relations FROM xs LEFT JOIN rs USING (id)""")
def report_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report on each nation is written from: its first entities and the first relations inside it."""
    r = relations(spark, sf_dir, True)
    members = nation_members(r, table(spark, sf_dir, "nation")).withColumnRenamed("c", "id")
    rows = reports.report_inputs(members, entities(spark, sf_dir).withColumn("description", F.col("type")), r)
    text = lambda c, line: F.coalesce(F.array_join(F.transform(c, line), ","), F.lit(""))
    return rows.select("id", text("es", lambda e: F.concat_ws(":", e["name"], e["type"])).alias("entities"), text("rs", lambda x: F.concat_ws(">", x["source"], x["relation_type"], x["target"])).alias("relations"))


@query(GRAPH + NATIONS + """, i AS (SELECT a.c AS id, count(*) AS n FROM r JOIN mem a ON a.name = r.source JOIN mem b ON b.name = r.target AND a.c = b.c GROUP BY a.c)
SELECT c AS id, count(DISTINCT name)::BIGINT AS n_entities, coalesce(any_value(n), 0)::BIGINT AS n_relations FROM mem LEFT JOIN i ON i.id = mem.c GROUP BY c""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir, True)
    members = nation_members(r, table(spark, sf_dir, "nation")).withColumnRenamed("c", "id")
    return longs(reports.report_counts(members, r), "n_entities", "n_relations")


for _name in ("connected_components", "graph_statistics", "prune_lcc", "modularity"):
    QUERIES[f"{_name}_whole"], ORACLE[f"{_name}_whole"] = QUERIES[_name], ORACLE[_name]
