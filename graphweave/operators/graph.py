"""The graph as tables: merged entities, merged relations and their algebra.

Lists that grow with the corpus (chunks, descriptions, aliases of an entity)
are rows of side tables, not arrays, so an entity that every document mentions
is never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import save
from .components import components


def merge_entities(mentions: DataFrame) -> DataFrame:
    """mentions(ord, name, type, mention_count, chunk_id) -> (name, type, mention_count, n_chunks); the first type wins."""
    return mentions.groupBy("name").agg(
        F.min_by("type", "ord").alias("type"), F.sum("mention_count").alias("mention_count"), F.countDistinct("chunk_id").alias("n_chunks"), F.min("ord").alias("first_ord"))


def merge_relations(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions(ord, source, target, relation_type, weight, chunk_id) with both ends known
    -> (source, target, relation_type, weight, mention_count, n_chunks, first_ord)."""
    keys = ["source", "target", "relation_type"]
    # Dealt by key and chunk first: few mentions share both, so adding up where they are read would only hold a task's whole
    # input in memory. Parts are many, and stay so: joined to parts of the usual size they would be about a GB of memory each.
    # What is left of a chunk is added up again before it goes to its key, so no key is hot.
    spark = mentions.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    own = mentions.repartition(parts, *keys, "chunk_id").groupBy(*keys, "chunk_id").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    r = own.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("n").alias("mention_count"), F.count("chunk_id").alias("n_chunks"), F.min("first_ord").alias("first_ord"))
    return _known(r, entities).select(*keys, "weight", "mention_count", "n_chunks", "first_ord")


def merge_weights(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations of merge_relations() with their weight alone. Without chunks there is nothing to tell apart, so mentions
    are added up where they are read and go to their key as one row a task."""
    return _known(mentions.groupBy("source", "target", "relation_type").agg(F.sum("weight").alias("weight")), entities)


def merge_counts(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations of merge_relations() with how often they are mentioned alone, added up as in merge_weights()."""
    return _known(mentions.groupBy("source", "target", "relation_type").agg(F.count(F.lit(1)).alias("mention_count")), entities)


def _known(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with both ends among the entities."""
    names = entities.select("name")
    return relations.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi").select(*relations.columns)


def provenance(mentions: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk_id), distinct."""
    return mentions.select(*keys, "chunk_id").distinct()


def undirected(relations: DataFrame) -> DataFrame:
    """(u, v, weight), u <= v: parallel and reverse relations added up."""
    return relations.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight): every undirected edge from either end; a loop once."""
    arc = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "weight")
    return edges.select(F.inline(F.when(F.col("u") == F.col("v"), F.array(arc("u", "v"))).otherwise(F.array(arc("u", "v"), arc("v", "u")))))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree): neighbours in the undirected graph, a loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    return entities.select("name").join(ends, "name", "left").select("name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbors(seeds: DataFrame, edges: DataFrame, depth: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """seeds(by.., name) -> (by.., name, depth) of everything within depth hops, the seeds left out. by: keeps searches apart."""
    step = both_ways(edges).select(F.col("a").alias("name"), F.col("b").alias("next"))
    if depth > 1:
        step = save(step)  # every hop reads it
    seen = frontier = seeds.select(*by, "name").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = frontier.join(step, "name").select(*by, F.col("next").alias("name")).distinct()
        frontier = new.join(seen, [*by, "name"], "left_anti").withColumn("depth", F.lit(d))
        if depth > 1:
            frontier = save(frontier)
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def induced(relations: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relations with both ends among names(by.., name)."""
    n = names.select(*by, "name").distinct()
    if not by:
        return relations.join(n.withColumnRenamed("name", "source"), "source", "left_semi").join(n.withColumnRenamed("name", "target"), "target", "left_semi").select(*relations.columns)
    own = relations.join(n.withColumnRenamed("name", "source"), "source")
    return own.join(n.withColumnRenamed("name", "target"), [*by, "target"], "left_semi").select(*by, *relations.columns)


def held_by(names: DataFrame) -> DataFrame:
    """names(name, block, bit) -> (name, block, bits): the searches of a block that a name belongs to, as bits of a long."""
    return names.groupBy("name", "block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "bit")).alias("bits"))


def induced_by(relations: DataFrame, held: DataFrame) -> DataFrame:
    """induced() for many searches at once: relations with (block, bits), the searches of which both ends are held(name, block,
    bits); one row for each block, however many searches of it share a relation."""
    ends = lambda end: held.select(F.col("name").alias(end), "block", F.col("bits").alias(f"{end}_bits"))
    both = relations.join(ends("source"), "source").join(ends("target"), ["target", "block"])
    return both.withColumn("bits", F.col("source_bits").bitwiseAND(F.col("target_bits"))).filter("bits <> 0").select(*relations.columns, "block", "bits")


def statistics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts, average degree, density and number of components."""
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("entity_mentions"))
    # Relations are gone over once: what is left of them is one row for each pair of names.
    pairs = relations.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").alias("mentions"))
    edges = save(pairs)
    r = edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("relation_mentions"))
    roots = components(edges.select("u", "v"), once=True)
    linked = roots.agg(F.count(F.lit(1)).alias("linked"), F.countDistinct("root").alias("parts"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    out = e.crossJoin(r).crossJoin(linked).crossJoin(m)  # one row each
    n = F.col("entities").cast("double")
    return out.select(
        "entities", "relations", "entity_mentions", "relation_mentions",
        F.when(n > 0, 2.0 * F.col("edges") / n).otherwise(0.0).alias("avg_degree"),
        F.when(n > 1, 2.0 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
        (F.col("parts") + F.col("entities") - F.col("linked")).alias("components"),
    )


def merge_graphs(*mentions: DataFrame) -> DataFrame:
    """Entity (or relation) mentions of several graphs as those of one; merge_entities and merge_relations do the rest."""
    out = mentions[0]
    for m in mentions[1:]:
        out = out.unionByName(m)
    return out


def entity(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.col("name") == name)


def community_of(members: DataFrame) -> DataFrame:
    """members(id, level, name) -> (name, id): the first community of each entity, broadest level first."""
    return members.groupBy("name").agg(F.min_by("id", F.struct("level", "id")).alias("id"))


def largest_component(names: DataFrame, edges: DataFrame) -> DataFrame:
    """names(name) of the largest component; of equal ones that with the smallest name. A lone node is a component."""
    inside = edges.join(names.withColumnRenamed("name", "u"), "u", "left_semi").join(names.withColumnRenamed("name", "v"), "v", "left_semi")
    roots = components(inside.select("u", "v"))
    labelled = save(names.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("root")))
    best = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return labelled.join(F.broadcast(best), "root", "left_semi").select("name")
