"""Questions around an entity with very many neighbours, and evaluations of which few cases fail."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.operators import graph
from graphweave.plans import evaluate, indexing, modes
from graphweave.plans.embedding import ShaEmbedder
from graphweave.plans.providers import OfflineProvider

N = 20_000


@pytest.fixture(scope="module")
def hub(spark):
    """One entity, `hub`, with N neighbours, N relations and N claims."""
    leaf = F.format_string("leaf %06d", "id")
    leaves = spark.range(N).select(leaf.alias("name"))
    entities = leaves.unionByName(spark.createDataFrame([("hub",)], "name string")).select("name", F.lit("T").alias("type"), F.lit("").alias("description"), F.lit(1).cast("long").alias("mention_count"))
    relations = leaves.select(F.lit("hub").alias("source"), F.col("name").alias("target"), F.lit("R").alias("relation_type"), F.lit(1.0).alias("weight"), F.lit("").alias("description"))
    claims = leaves.select(F.concat(F.lit("c "), "name").alias("id"), F.lit("hub").alias("subject_id"), F.col("name").alias("object_id"), F.lit("").alias("description"), F.lit("TRUE").alias("status"))
    units = spark.createDataFrame([("u", "d", 0, "hub of all")], "chunk_id string, doc_id string, chunk_index int, text string")
    tables = {"entities": entities, "relations": relations, "claims": claims, "text_units": units, "entity_chunks": spark.createDataFrame([("hub", "u")], "name string, chunk_id string"), "reports": spark.createDataFrame([], "id string, summary string")}
    config, embedder = replace(EngineConfig(), max_documents=None), ShaEmbedder(256)
    tables["vectors"] = indexing.embed(tables, config, embedder)
    return indexing.Index(tables, config, embedder)


class Lengths:
    name = "lengths"

    def complete(self, task, prompt):
        return str(sum(x.startswith("- ") for x in prompt.split("\n")))


def asked(spark):
    return spark.createDataFrame([(1, "hub")], "question_id long, query string")


def test_neighbours_of_a_hub_are_rows(spark, hub):
    found = graph.neighbors(spark.createDataFrame([("leaf 000007",)], "name string"), graph.undirected(hub.relations), 2)
    assert {(x.depth, x["count"]) for x in found.groupBy("depth").count().collect()} == {(1, 1), (2, N - 1)}


def test_prompts_and_sources_show_what_the_setting_says(spark, hub):
    few = replace(hub, config=replace(hub.config, shown_items=10))
    got = modes.query(few, asked(spark), "local", top_k=1, provider=Lengths())
    assert got.answers.first().answer == "31"  # ten of each, and a text
    assert got.details["entities"].count() == N + 1 and got.details["claims"].count() == N  # the context has all
    ids = modes.source_ids(got.details, "local", 10).first().source_ids
    assert ids == ["u", "entity:hub", *[f"c leaf {i:06d}" for i in range(10)]]


def test_more_than_a_row_may_hold_is_an_error(spark, hub, monkeypatch):
    assert modes.query(hub, asked(spark), "local", top_k=1, provider=Lengths()).answers.first().answer == str(3 * N + 2)
    monkeypatch.setattr(modes, "LISTED", N - 1)
    with pytest.raises(Exception, match="set shown_items"):
        modes.query(hub, asked(spark), "local", top_k=1, provider=Lengths()).answers.collect()


def test_cases_that_fail_are_found_by_halves(spark, hub, monkeypatch):
    class Failing:
        name = "failing"

        def complete(self, task, prompt):
            if "case 5?" in prompt.split("\n")[1]:
                raise OSError("down")
            return OfflineProvider().complete(task, prompt)

    runs, answered = [], evaluate._answered
    monkeypatch.setattr(evaluate, "_answered", lambda index, cases, *a: runs.append(cases.count()) or answered(index, cases, *a))
    none = F.array().cast("array<string>")
    cases = spark.range(16).select(F.format_string("%02d", "id").alias("id"), F.format_string("case %d?", "id").alias("query"), F.array(F.lit("basic")).alias("modes"), none.alias("expected_source_ids"), none.alias("expected_answer_terms"), F.lit(1).alias("top_k"), F.lit(None).cast("int").alias("community_level"))
    own = replace(hub, config=replace(hub.config, max_retry=0))
    got = {x.case_id: x for x in evaluate.run(own, cases, Failing()).collect()}
    assert len(got) == 16 and [k for k, x in got.items() if not x.success] == ["05"] and "down" in got["05"].error
    assert sorted(runs) == [1, 1, 2, 2, 4, 4, 8, 8, 16]
    assert all(x.latency_ms > 0 for x in got.values())
