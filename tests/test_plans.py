"""Extraction, indexing, query modes, evaluation, storage, streaming, entry points."""

import json
from dataclasses import dataclass, replace

import pytest

from graphweave.config import EngineConfig
from graphweave.operators import extract
from graphweave.plans import evaluate, indexing, modes
from graphweave.plans.providers import CannedProvider, OfflineProvider, ask
from graphweave.sources.documents import documents_from
from graphweave.streaming.ingest import ingest_chunks

CONFIG = replace(EngineConfig(), claims_enabled=True, max_documents=None, max_characters=None)


@dataclass(frozen=True)
class WordProvider:
    """Capitalised words are entities, neighbours are related: a stand-in for a model."""

    name: str = "words"

    def complete(self, task, prompt):
        if task == "entity_extraction":
            names = [w.strip(".") for w in prompt.rsplit("Text:", 1)[1].split() if w[:1].isupper()]
            return "Sure: " + json.dumps({
                "entities": [{"name": n, "type": "thing", "description": f"{n} is known"} for n in dict.fromkeys(names)],
                "relations": [{"source": a, "target": b, "relation_type": "next", "description": "neighbours"} for a, b in zip(names, names[1:]) if a != b]})
        if task == "claim_extraction":
            return json.dumps({"claims": [{"subject": "ALICE", "object": "Paris", "type": "LIVES", "status": "true", "description": "Alice lives in Paris"}]})
        if task.startswith("drift_followup_"):
            return json.dumps({"answer": f"found for {task}", "confidence": 0.9, "follow_ups": [{"question": "Where is Bob?", "score": 70}, {"question": "where is bob", "score": 99}]})
        if task == "global_map_0":
            return json.dumps({"points": [{"description": "good", "score": 120}, {"description": "none", "score": 0}, {"description": "odd", "score": "x"}]})
        return OfflineProvider().complete(task, prompt)


@pytest.fixture(scope="module")
def index(spark):
    docs = documents_from(spark, "demo", ["Alice knows Bob. Bob knows Carol.", "Alice lives in Paris. Carol lives in Rome.", "ALICE met Dave in Paris."])
    return indexing.build_index(docs, CONFIG, WordProvider())


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q1", "Alice in Paris"), ("q2", "Who is Carol?")], "question_id string, query string")


def test_extraction_checks_whole_answers(spark):
    e = {"name": "A", "type": "T", "description": "d"}
    r = {"source": "A", "target": "A", "relation_type": "R", "description": "d"}
    cases = {
        "ok": json.dumps({"entities": [e], "relations": [r]}), "dangling": json.dumps({"entities": [e], "relations": [r, r | {"target": "B"}]}), "no_key": json.dumps({"entities": [{"name": "A"}], "relations": []}),
        "list": "[1]", "empty": "", "cut": '{"entities": [', "blank": json.dumps({"entities": [e | {"name": " "}, e], "relations": []}), "not_list": json.dumps({"entities": {}, "relations": []}),
    }
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(cases.items())], "ord long, chunk_id string, response string")
    es, rs = extract.mentions(df)
    assert sorted(x.chunk_id for x in es.collect()) == ["blank", "ok"] and [x.chunk_id for x in rs.collect()] == ["ok"]


def test_index(index):
    names = {x.name: x for x in index.entities.collect()}
    assert {"Alice", "Bob", "Carol", "Paris", "Rome", "Dave"} == set(names) and names["Alice"].mention_count == 3 and names["Alice"].type == "THING"
    assert index.claims.select("subject_id", "object_id", "status").distinct().collect()[0][:] == ("Alice", "Paris", "TRUE")
    assert index.communities.filter("level = 0").select("name").distinct().count() == 6
    assert index.reports.filter("summary = ''").count() == 0
    assert {x.kind for x in index.vectors.select("kind").distinct().collect()} == {"entity", "chunk", "community"}
    assert index.statistics.first().entities == 6


def test_default_offline_index(spark):
    got = indexing.build_index(documents_from(spark, "d", ["Some text.", "More text."]))
    assert [(x.name, x.mention_count) for x in got.entities.collect()] == [("Sample Entity", 2)] and got.relations.count() == 0


def test_basic(index, questions):
    got = modes.query(index, questions, "basic", top_k=2)
    assert got.sources.filter("question_id = 'q1' and rank = 1").first().text.startswith("A") and got.answers.count() == 2
    assert got.sources.groupBy("question_id").count().filter("count <> 2").count() == 0


def test_local(index, questions):
    got = modes.query(index, questions, "local", top_k=1)
    kinds = {(x.question_id, x.type) for x in got.sources.collect()}
    assert ("q1", "text_unit") in kinds and ("q1", "entity") in kinds and ("q1", "claim") in kinds
    ends = got.details["relations"].filter("question_id = 'q1'").collect()
    names = {x.name for x in got.details["entities"].filter("question_id = 'q1'").collect()}
    assert ends and all(x.source in names and x.target in names for x in ends)


def test_global(index, questions):
    got = modes.query(index, questions, "global", provider=WordProvider())
    points = got.details["map_points"].filter("question_id = 'q1'").collect()
    assert [(p.text, p.score) for p in points] == [("good", 100.0)]
    assert {x.answer for x in got.answers.collect()} == {OfflineProvider().complete("global_reduce", "")}
    none = replace_reports(index)
    assert {x.answer for x in modes.query(none, questions, "global").answers.collect()} == {modes.NO_REPORTS}
    zero = CannedProvider({"global_map_0": '{"points": [{"description": "x", "score": 0}]}'})
    assert {x.answer for x in modes.query(index, questions, "global", provider=zero).answers.collect()} == {modes.NO_POINTS}


def replace_reports(index):
    return indexing.Index({**index.tables, "reports": index.reports.limit(0)}, index.config)


def test_drift(index, questions):
    got = modes.query(index, questions, "drift", provider=WordProvider())
    ev = got.details["evidence"].filter("question_id = 'q1'").collect()
    assert sorted(x.depth for x in ev) == [1, 2]
    assert {x.parent_id for x in ev if x.depth == 2} == {x.id for x in ev if x.depth == 1}
    assert all(any(s.startswith("entity:") for s in x.source_ids) and any("chunk" in s for s in x.source_ids) for x in ev)
    assert {x.termination for x in got.details["trace"].collect()} == {"max_depth"}
    unsure = CannedProvider({"drift_primer": '{"answer": "a", "follow_ups": [{"question": "Q?", "score": 500}]}', "drift_followup_primer_0_0": '{"answer": "b", "confidence": 0.1, "follow_ups": [{"question": "R?"}]}'})
    got = modes.query(index, questions, "drift", provider=unsure)
    assert {(x.actions, x.termination) for x in got.details["trace"].collect()} == {(1, "no_followups")}
    with pytest.raises(ValueError):
        modes.query(index, questions, "unknown")


def test_points_of_plain_text(spark):
    df = spark.createDataFrame([(1, " plain "), (2, '{"points": []}'), (3, " "), (4, '{"points": [3, {"description": "a", "score": -4}]}')], "k long, response string")
    assert sorted(map(tuple, modes.parse_points(df).collect())) == [(1, "plain", 1.0), (2, '{"points": []}', 1.0), (4, "a", 0.0)]


def test_folds(spark):
    df = spark.createDataFrame([("q", i) for i in (3, 5, 9, 11)] + [("r", 1)], "question_id string, rank long")
    assert sorted((x.question_id, x.rank, x.fold) for x in modes.folds(df, 3).collect()) == [("q", 3, 0), ("q", 5, 1), ("q", 9, 2), ("q", 11, 0), ("r", 1, 0)]


def test_store(spark, index, tmp_path):
    from graphweave.sources.index_store import IndexStore

    root = str(tmp_path / "indexes")
    indexing.persist(index, spark, root, "demo")
    store = IndexStore(spark, root)
    assert store.list() == ["demo"] and store.exists("demo")
    with pytest.raises(FileExistsError):
        indexing.persist(index, spark, root, "demo")
    again = indexing.load(spark, root, "demo", CONFIG)
    assert again.entities.count() == index.entities.count()
    other = indexing.load(spark, root, "demo", replace(CONFIG, embedding_dimension=64))
    assert len(other.vectors.first().vector) == 64
    indexing.persist(again, spark, str(tmp_path / "more"), "demo")
    assert store.delete("demo") and not store.delete("demo") and store.list() == []
    with pytest.raises(FileNotFoundError):
        store.load("demo")


def test_evaluation(spark, index, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "c1", "query": "Alice in Paris", "modes": ["basic", "drift"], "expected_source_ids": ["demo_doc_1_chunk_0"], "expected_answer_terms": ["OFFLINE", "nothing"]}\n\n')
    got = {x["mode"]: x for x in evaluate.run(index, evaluate.read_cases(spark, str(path))).collect()}
    assert got["basic"].source_recall == 1.0 and got["basic"].answer_term_coverage == 0.5 and got["basic"].drift_actions is None and got["drift"].drift_actions == 1
    df = spark.createDataFrame([("basic", True, 0.0, 1.0, 10.0, None), ("basic", False, 1.0, 0.0, 20.0, None)], "mode string, success boolean, source_recall double, answer_term_coverage double, latency_ms double, drift_actions long")
    row = evaluate.by_mode(df).first()
    assert (row.cases, row.success_rate, row.avg_source_recall, row.avg_latency_ms, row.avg_drift_actions) == (2, 0.5, 0.5, 15.0, None)


def test_service_and_report(spark, tmp_path, index):
    from graphweave.plans.service import Service

    s = Service(spark, str(tmp_path / "indexes"), replace(CONFIG, max_documents=5), WordProvider())
    quality = s.create("demo", ["Alice knows Bob.", "Bob lives in Rome."])
    assert quality["entities"] == 3 and s.quality("demo") == quality and s.list() == ["demo"] and s.statistics("demo")["levels"] == [0]
    with pytest.raises(FileExistsError):
        s.create("demo", ["x"])
    with pytest.raises(ValueError):
        s.create("other", ["a"] * 6)
    answer, sources = s.query("demo", "Who knows Bob?", "basic", top_k=1)
    assert answer and [x["type"] for x in sources] == ["text_unit"]
    assert s.delete("demo") and s.list() == []
    rows = spark.createDataFrame([("c1", "basic", True, "a", ["x"], 1.0, 0.5, 3.0, None)], "case_id string, mode string, success boolean, answer string, source_ids array<string>, source_recall double, answer_term_coverage double, latency_ms double, drift_actions long")
    evaluate.write_report(rows, str(tmp_path / "r.json"))
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["summary"][0]["avg_source_recall"] == 1.0 and report["results"][0]["case_id"] == "c1"


def test_embedders(spark):
    from pyspark.sql import functions as F

    from graphweave.plans.embedding import make_embedder

    df = spark.createDataFrame([("ab",), ("c",), (None,)], "t string")
    e = make_embedder("batch", 1, lambda ts: [[float(len(t))] for t in ts])
    assert sorted(x.v[0] for x in df.select(e.embed(F.col("t")).alias("v")).collect()) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        make_embedder("unknown", 1)


def test_ask_tries_again(spark, tmp_path):
    flag = str(tmp_path / "failed")

    class Flaky:
        name = "flaky"

        def complete(self, task, prompt):
            import os

            if not os.path.exists(flag):
                open(flag, "w").close()
                raise OSError("once")
            return prompt.upper()

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a",)], "p string")
    assert ask(df, Flaky(), F.lit("t"), F.col("p"), wait=0.01).first().response == "A"


def test_streaming(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.createDataFrame([(n, "One. " * 300)], "doc_id long, text string").write.mode("append").parquet(src)
        ingest_chunks(spark, src, sink, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(sink)
    assert {x.doc_id for x in got.collect()} == {0, 1} and got.select("doc_id", "chunk_index").distinct().count() == got.count()


def test_entry_points():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "basic_search" in q
