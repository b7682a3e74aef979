"""Queries that do the whole job: nothing of the tables is left out."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphweave.queries import ORACLE, QUERIES, retrieval, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index_graph(spark):
    return retrieval.table_graph(spark, SF)


def test_index_has_the_whole_graph(spark, index_graph):
    g = index_graph
    assert {x.type for x in g["entities"].select("type").distinct().collect()} == {"REGION", "NATION", "CUSTOMER", "SUPPLIER", "PART"}
    assert {x[0] for x in g["relations"].select("relation_type").distinct().collect()} == {"LOCATED_IN", "PART_OF", "ORDERED", "SUPPLIES"}
    assert g["relations"].filter("relation_type = 'SUPPLIES'").agg(F.sum("mention_count")).first()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_index_has_all_evidence_and_claims(spark, index_graph):
    g = index_graph
    of = {x[0] for x in g["entity_chunks"].filter("name = 'Customer#000000005'").select("chunk_id").collect()}
    assert of == {x[0] for x in g["text_units"].filter("doc_id = 5").select("chunk_id").collect()} and len(of) > 1
    assert g["entity_chunks"].join(g["entities"].filter("type = 'PART'"), "name").count() > 0
    want = {x[0] for x in text.claim_resolve_dedupe(spark, SF).select("id").collect()}
    assert {x[0] for x in g["claims"].select("id").collect()} == want and want


def test_index_keeps_the_default_levels(spark, index_graph, monkeypatch):
    seen = []

    def hierarchy(entities, edges, config):
        seen.append(config.max_community_levels)
        assert edges.count() > 1000
        return entities.select(F.lit("L0_C0").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).cast("long").alias("size"), "name")

    monkeypatch.setattr("graphweave.operators.community.hierarchy", hierarchy)
    monkeypatch.setattr(retrieval, "table_graph", lambda *_: index_graph)
    retrieval.table_index(spark, SF)
    assert seen == [3]


def by_sql(name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return sorted(map(repr, con.execute(ORACLE[name]).fetchall()))


def by_query(spark, name):
    return sorted(repr(tuple(x)) for x in QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", ["connected_components_whole", "graph_statistics_whole", "prune_lcc_whole", "modularity_whole"])
def test_whole_graph_equals_sql(spark, name):
    assert QUERIES[name] is QUERIES[name.removesuffix("_whole")]
    assert by_query(spark, name) == by_sql(name)


def test_every_event_has_a_fold(spark):
    got = by_query(spark, "drift_folds_whole")
    assert got == by_sql("drift_folds_whole") and len(got) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_leiden_keeps_the_default_levels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("graphweave.operators.community.hierarchy", lambda e, r, config: seen.append(config) or e)
    QUERIES["leiden_hierarchy"](spark, SF)
    assert [(x.community_algorithm, x.max_community_levels) for x in seen] == [("leiden", 3)]
