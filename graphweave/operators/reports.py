"""Community reports, from the deepest level up: a report sees those of the communities inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import prompts
from ..plans.providers import Provider, ask
from ..sources.scratch import save
from .graph import induced

SHOWN_ENTITIES, SHOWN_RELATIONS = 30, 40


def report_counts(members: DataFrame, relations: DataFrame) -> DataFrame:
    """members(id, name) -> (id, n_entities, n_relations): what a community's report is about."""
    inside = induced(relations, members, by=("id",)).groupBy("id").agg(F.count(F.lit(1)).alias("n_relations"))
    n = members.groupBy("id").agg(F.countDistinct("name").alias("n_entities"))
    return n.join(inside, "id", "left").select("id", "n_entities", F.coalesce("n_relations", F.lit(0)).cast("long").alias("n_relations"))


def _first(rows: DataFrame, order: list[str], n: int, columns: list[str], name: str) -> DataFrame:
    """(id, name: the first n rows of each community): no more is ever gathered."""
    r = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("r") <= n)
    return r.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def report_inputs(members: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, es: the first entities by name, rs: the first relations inside): what a report is written from."""
    es = _first(members.join(entities, "name"), ["name"], SHOWN_ENTITIES, ["name", "type", "description"], "es")
    rs = _first(induced(relations, members, by=("id",)), ["source", "target", "relation_type"], SHOWN_RELATIONS, ["source", "relation_type", "target"], "rs")
    return members.select("id").distinct().join(es, "id", "left").join(rs, "id", "left")


def reports(members: DataFrame, entities: DataFrame, relations: DataFrame, provider: Provider, parallel: int | None = None, stream: bool = False) -> DataFrame:
    """members(id, level, parent_id, size, name), entities(name, type, description),
    relations(source, target, relation_type, ..) -> (id, level, parent_id, size, summary)."""
    heads = members.select("id", "level", "parent_id", "size").distinct()
    rows = save(heads.join(report_inputs(members, entities, relations), "id"))
    levels = sorted((r["level"] for r in rows.select("level").distinct().collect()), reverse=True)
    done = None
    no_child = F.array().cast("array<struct<id: string, summary: string>>")
    for level in levels:
        own = rows.filter(F.col("level") == level)
        if done is None:
            own = own.withColumn("children", no_child)
        else:
            inside = done.filter(F.col("summary") != "").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "summary"))).alias("children"))
            own = own.join(inside, "id", "left").withColumn("children", F.coalesce("children", no_child))
        empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
        prompt = prompts.community(
            F.col("id"), F.col("level"), empty("es", "array<struct<name: string, type: string, description: string>>"),
            empty("rs", "array<struct<source: string, relation_type: string, target: string>>"), F.col("children"))
        got = ask(own, provider, F.concat(F.lit("community_summary_"), F.col("id")), prompt, parallel=parallel, stream=stream).withColumn("summary", F.trim("response"))
        got = save(got.withColumn("summary", F.when(F.col("summary") == "", F.raise_error(F.concat(F.lit("empty report for "), F.col("id")))).otherwise(F.col("summary"))).select("id", "level", "parent_id", "size", "summary"))
        done = got if done is None else done.unionByName(got)
    return done if done is not None else rows.select("id", "level", "parent_id", "size", F.lit(None).cast("string").alias("summary"))
