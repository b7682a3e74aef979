"""Stored indexes: figures of the stages, layout, older versions, and one handle for many questions."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.plans import indexing
from graphweave.plans.service import Service
from graphweave.sources.index_store import IndexStore


class Words:
    """Capitalised words are entities; each comes before the next. One claim for every text."""

    name = "words"

    def complete(self, task, prompt):
        if task == "entity_extraction":
            words = [w.strip(".") for w in prompt.split("Text:\n", 1)[1].split() if w[:1].isupper()]
            es = [{"name": w, "type": "word", "description": f"said {w}"} for w in dict.fromkeys(words)]
            rs = [{"source": a, "target": b, "relation_type": "before", "description": "next"} for a, b in zip(words, words[1:]) if a != b]
            return json.dumps({"entities": es, "relations": rs})
        if task == "claim_extraction":
            return json.dumps({"claims": [{"subject": "Ann", "object": "Bob", "type": "T", "status": "TRUE", "description": "c"}]})
        return "said something"


TEXTS = ["Ann Bob Cid.", "ANN Bob Dan.", "Ann Cid Eve.", "Zoe alone."]
CONFIG = replace(EngineConfig(), prune_enabled=True, min_node_degree=1, claims_enabled=True, keep_payloads=True, max_community_levels=1)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    s = Service(spark, str(tmp_path_factory.mktemp("stored")), CONFIG, Words())
    s.create("a", TEXTS)
    return s


def test_figures_of_every_stage(service):
    q = service.quality("a")
    assert q["resolution"] == {"mentions": 10, "canonical_entities": 6, "aliases_merged": 4}
    p = q["pruning"]
    assert p["enabled"] == 1 and (p["before_entities"], p["after_entities"], p["removed_entities"]) == (6, 5, 1) and p["reason_min_node_degree"] == 1
    assert p["removed_relations"] == p["before_relations"] - p["after_relations"] == 0 and p["edge_weight_threshold"] == 1 and p["before_components"] == 2 and p["after_components"] == 1
    assert q["claims"]["enabled"] == 1 and q["claims"]["count"] == q["claims"]["count"] > 0 and q["entities"] == 5
    removed = IndexStore(service.spark, service.root).load("a")["removed"].collect()
    assert [(r["name"], r["reasons"]) for r in removed] == [("Zoe", ["min_node_degree"])]


def test_all_calls_are_kept_with_the_index(service):
    tasks = {r["task"].split("_of")[0] for r in service.open("a").payloads.select("task").distinct().collect()}
    assert {"entity_extraction", "claim_extraction"} <= tasks and any(t.startswith("community_summary") for t in tasks)
    kept = service.open("a").payloads.filter("task = 'entity_extraction'")
    assert kept.count() == len(TEXTS) and kept.filter(F.length("prompt") != F.col("prompt_length")).isEmpty()


def test_nothing_is_pruned_or_claimed_unless_asked_for(spark):
    docs = spark.createDataFrame([(0, TEXTS[0])], "doc_id long, text string")
    q = indexing.build_index(docs, EngineConfig(), Words()).quality()
    assert q["pruning"] == {"enabled": 0} and q["claims"] == {"enabled": 0, "count": 0}


def test_vectors_lie_by_kind(service):
    plan = service.open("a").vectors.filter("kind = 'chunk'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    assert {r["kind"] for r in service.open("a").vectors.select("kind").distinct().collect()} == {"chunk", "community", "entity"}


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_one_handle_for_many_questions(service, monkeypatch):
    """The second question loads nothing, and no question looks at all vectors to see whether they are complete."""
    loads, checks = [], []
    load, complete = indexing.load, indexing.complete
    monkeypatch.setattr(indexing, "load", lambda *a: loads.append(1) or load(*a))
    monkeypatch.setattr(indexing, "complete", lambda *a: checks.append(1) or complete(*a))
    service._open.clear()
    for _ in range(2):
        answer, sources = service.query("a", "Who is Ann?", "basic")
        assert answer == "said something" and sources
    assert (len(loads), len(checks)) == (1, 0)
    service.create("b", TEXTS[:1])
    first = service.open("b")
    service.create("b", TEXTS[:2], overwrite=True)
    assert service.open("b") is not first and service.open("b").text_units.count() == 2
    assert service.delete("b") and "b" not in service.list()
    with pytest.raises(FileNotFoundError):
        service.open("b")


def test_an_older_index_loads(service, tmp_path):
    """Layout 1: plain tables without figures, claims without dates, a manifest that doesn't know whether vectors are complete."""
    spark, new = service.spark, service.open("a")
    tables = {k: v for k, v in new.tables.items() if k not in ("figures", "removed", "payloads")}
    tables["claims"] = tables["claims"].drop("start_date", "end_date", "source_text")
    tables["vectors"] = tables["vectors"].filter("kind <> 'chunk'").select("kind", "key", "vector")
    store = IndexStore(spark, str(tmp_path))
    store.save("old", tables, indexing.metadata(new.own_embedder))
    path = tmp_path / "old" / "manifest.json"
    m = json.loads(path.read_text())
    path.write_text(json.dumps(m | {"schema_version": 1}))
    (tmp_path / "old" / ".manifest.json.crc").unlink(missing_ok=True)
    got = indexing.load(spark, str(tmp_path), "old", CONFIG)
    assert got.claims.columns[-3:] == ["source_text", "start_date", "end_date"] and got.claims.filter("source_text is null").count() == got.claims.count() > 0
    assert got.vectors.filter("kind = 'chunk'").count() == len(TEXTS) and got.figures.isEmpty() and got.removed.columns == ["name", "reasons"]
    path.write_text(json.dumps(m | {"schema_version": 99}))
    with pytest.raises(ValueError, match="layout 99"):
        indexing.load(spark, str(tmp_path), "old", CONFIG)
