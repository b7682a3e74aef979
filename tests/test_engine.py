"""Bounds, rounds and failures: settings, components, percentiles, communities, providers, embedders, evaluation, storage."""

import json
import os
import random
from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.functions.json_ladder import find_json, has_keys, json_or
from graphweave.functions.text import merge_text
from graphweave.operators import claims, community, components, describe, extract, graph, rank, retrieve
from graphweave.plans import evaluate, indexing, modes
from graphweave.plans.embedding import BatchEmbedder, ShaEmbedder
from graphweave.plans.providers import CannedProvider, OfflineProvider
from graphweave.sources import scratch
from graphweave.sources.documents import documents_from
from graphweave.sources.index_store import IndexStore


def test_settings_name_what_is_wrong():
    for name, value in (("leiden_iterations", 0), ("drift_community_level", -1), ("community_resolution", 0.0), ("entity_resolution", "fuzzy"), ("max_retry", -1), ("shown_items", 0)):
        with pytest.raises(ValueError, match=name):
            replace(EngineConfig(), **{name: value})
    assert EngineConfig().drift_reduce_tokens == 5000 and replace(EngineConfig(), max_documents=None).max_documents is None


def test_a_sorted_path_takes_few_rounds(spark, monkeypatch):
    writes = []
    real = scratch.save
    monkeypatch.setattr(components, "save", lambda df: writes.append(1) or real(df))
    n = 10_000
    got = components.components(spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert got.count() == n and got.select("root").distinct().collect()[0][0] == 0
    assert len(writes) <= 20


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_percentiles_equal_numpy(spark, n):
    r = random.Random(n)
    x = [float(r.randrange(50)) if r.random() < 0.5 else r.random() for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = rank.percentile(df, "x", share)
        assert got is None if not n else got == pytest.approx(np.percentile(x, 100 * share))


def planted(seed, groups=6, size=12, inside=0.6, across=0.03):
    r = random.Random(seed)
    names = [f"{chr(97 + g)}{i:02d}" for g in range(groups) for i in range(size)]
    return names, [(a, b, 1.0) for i, a in enumerate(names) for b in names[:i] if r.random() < (inside if a[0] == b[0] else across)]


def quality(edges, of):
    m = sum(w for *_, w in edges)
    inner, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[of[a]] += w
        total[of[b]] += w
        inner[of[a]] += w * (of[a] == of[b])
    return sum(inner[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def plain_louvain(names, edges):
    """One node after another to the best gain, then communities as nodes, until nothing moves."""
    of, level, nodes = {n: n for n in names}, edges, list(names)
    while True:
        near, k, m = defaultdict(lambda: defaultdict(float)), defaultdict(float), sum(w for *_, w in level)
        for a, b, w in level:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        at, tot, moved, any_move = {n: n for n in nodes}, dict(k), True, False
        while moved:
            moved = False
            for n in nodes:
                to = defaultdict(float)
                for b, w in near[n].items():
                    to[at[b]] += w
                tot[at[n]] = tot.get(at[n], 0.0) - k[n]
                gain = lambda c: to[c] - k[n] * tot.get(c, 0.0) / (2 * m)
                best = max(sorted(to), key=gain, default=at[n])
                if gain(best) > gain(at[n]) + 1e-9:
                    at[n], moved, any_move = best, True, True
                tot[at[n]] = tot.get(at[n], 0.0) + k[n]
        of = {n: at[c] for n, c in of.items()}
        if not any_move:
            return of
        merged = defaultdict(float)
        for a, b, w in level:
            merged[tuple(sorted((at[a], at[b])))] += w
        level, nodes = [(a, b, w) for (a, b), w in merged.items()], sorted(set(at.values()))


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_communities_are_as_good_as_the_sequential_ones(spark, algorithm):
    names, edges = planted(3)
    e = spark.createDataFrame(edges, "u string, v string, weight double")
    config = replace(EngineConfig(), community_algorithm=algorithm, max_community_levels=1)
    got = {x.name: x.id for x in community.hierarchy(spark.createDataFrame([(n,) for n in names], "name string"), e, config).collect()}
    assert set(got) == set(names)
    assert quality(edges, got) >= 0.95 * quality(edges, plain_louvain(names, edges))
    if algorithm == "leiden":
        near = defaultdict(set)
        for a, b, _ in edges:
            near[a].add(b)
            near[b].add(a)
        for c in set(got.values()):
            own = {n for n in names if got[n] == c}
            seen, todo = set(), [min(own)]
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += near[n] & own
            assert seen == own


def test_nodes_are_places_in_order(spark):
    """Ids follow the order of the names, as nodes are places in it and not hashes of names."""
    e = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    got = {x.name: x.id for x in community.hierarchy(spark.createDataFrame([(n,) for n in "abcd"], "name string"), e).filter("level = 0").collect()}
    assert got["a"] == got["b"] == "L0_C0" and got["c"] == got["d"] == "L0_C1"


def test_deep_nesting_is_no_json():
    assert find_json("[" * 100_000) is None and find_json('{"a":' * 100_000) is None
    assert find_json("[" * 50_000 + ' {"a": 1}') == {"a": 1} and find_json("{" * 3_000 + '"a": 1}') == {"a": 1}
    assert json_or("no", 5) == 5 and json_or('x {"a": 1}', keys=("a",)) == {"a": 1} and json_or('{"a": 1}', "d", ("b",)) == "d" and json_or(None, []) == []
    assert has_keys({"a": None}, ("a",)) and not has_keys([], ("a",))


def test_merged_texts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), ("a", ""), ("", ""), ("a | b", "a")], "l string, r string")
    assert [x[0] for x in df.select(merge_text(F.col("l"), F.col("r"))).collect()] == ["a | b", "a", "b", "a", "", "a | b | a"]
    m = spark.createDataFrame([("x", i, d) for i, d in enumerate([" a", "b ", "a", None])], "name string, ord long, description string")
    assert describe.merged_texts(m, "name").first()[:] == ("x", 2, "a | b | a")


@dataclass
class Writer:
    """Describes what it is asked for, fails for one name and says nothing on another."""

    name: str = "writer"

    def complete(self, task, prompt):
        if "Bad" in task:
            raise OSError("down")
        return " " if "Mute" in task else f"written: {task}"


def test_descriptions_are_written_or_joined(spark):
    m = spark.createDataFrame([(n, "T", i, d) for i, (n, d) in enumerate([("One", "x"), ("Two", "x"), ("Two", "y"), ("Bad", "x"), ("Bad", "y"), ("Mute", "x"), ("Mute", "y")])], "name string, type string, ord long, description string")
    got = {x.name: x.description for x in describe.summarise(m, Writer(), "name", "type", retries=0).collect()}
    assert got == {"One": "x", "Two": "written: entity_description_summary_Two", "Bad": "x | y", "Mute": "x | y"}
    assert {x.description for x in describe.summarise(m, OfflineProvider(), "name", "type").collect()} == {"x", "x | y"}
    r = spark.createDataFrame([("a", "b", "R", 0, "x"), ("a", "b", "R", 1, "y")], "source string, target string, relation_type string, ord long, description string")
    assert describe.summarise(r, Writer(), "source", "target", "relation_type").first().description == "written: relation_description_summary_a_R_b"


class Stumbling:
    """The first answers of every chunk cannot be used; one chunk never gets one, and one is never answered."""

    name = "stumbling"

    def __init__(self, folder):
        self.folder = folder

    def complete(self, task, prompt):
        text = prompt.rsplit("Text:", 1)[1].strip()
        if text.startswith("Down"):
            raise OSError("down")
        path = f"{self.folder}/{text[:4]}"
        n = len(open(path).read()) if os.path.exists(path) else 0
        open(path, "a").write("x")
        if n < 2 or text.startswith("Odd"):
            return '{"entities": [{"name": "A"}], "relations": []}'
        return json.dumps({"entities": [{"name": text[:4], "type": "T", "description": "d"}], "relations": []})


def test_extraction_asks_again_and_goes_on(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, f"c{i}", t) for i, t in enumerate(["Good one", "Odd one", "Down one"])], "doc_id long, chunk_index long, chunk_id string, text string")
    config = replace(EngineConfig(), max_retry=2, keep_payloads=True, provider_parallelism=1)
    raw = extract.raw_responses(chunks, Stumbling(str(tmp_path)), config)
    got = {x.chunk_id: x for x in raw.collect()}
    assert got["c2"].response == "" and "Good one" in got["c0"].prompt
    e, _ = extract.mentions(raw.select("ord", "chunk_id", "response"))
    assert [x.name for x in e.collect()] == ["Good"]


def test_claims_carry_dates_and_fail_by_chunk(spark):
    answer = lambda *cs: json.dumps({"claims": list(cs)})
    base = {"subject": "ACME", "object": "Bob", "type": "T", "status": "TRUE"}
    said = {"c0": answer(base | {"description": "d", "start_date": "2020", "source_text": " s "}), "c1": answer(base | {"description": "x"}, base | {"description": "y", "end_date": 5}), "c2": "broken"}

    class ByChunk:
        name = "by chunk"

        def complete(self, task, prompt):
            if "c3" in prompt:
                raise OSError
            return next(v for k, v in said.items() if k in prompt)

    chunks = spark.createDataFrame([(i, 0, f"c{i}", f"text c{i}") for i in range(4)], "doc_id long, chunk_index long, chunk_id string, text string")
    names = spark.createDataFrame([("Acme",), ("Bob",)], "name string")
    lookup = claims.alias_lookup(names.select(F.lit(0).alias("ord"), "name", F.col("name").alias("alias")))
    got = claims.extract_claims(chunks, names, lookup, ByChunk(), replace(EngineConfig(), max_retry=0)).collect()
    assert [(x.text_unit_id, x.subject_id, x.start_date, x.end_date, x.source_text) for x in got] == [("c0", "Acme", "2020", None, "s")]


def test_questions_go_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(40, 4)))], "key long, vector array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(23, 4)))], "question_id long, question array<double>")
    want = sorted(map(tuple, retrieve.rank_named(v, q, 3).collect()))
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 5)
    assert sorted(map(tuple, retrieve.rank_named(v, q, 3).collect())) == want and len(want) == 69


@pytest.fixture(scope="module")
def lengths():
    return BatchEmbedder(lambda ts: [[1.0, float(len(t)), float(t.count("a"))] for t in ts], 3, name="lengths")


def test_embedders_reach_index_and_questions(spark, tmp_path, lengths):
    docs = documents_from(spark, "demo", ["aaaa aaaa aaaa", "bb", "Some other text that is longer."])
    index = indexing.build_index(docs, embedder=lengths)
    assert {len(x.vector) for x in index.vectors.collect()} == {3}
    got = modes.query(index, spark.createDataFrame([("q", "aaaa aaaa aaab")], "question_id string, query string"), "basic", top_k=1)
    assert got.sources.first().id == "demo_doc_0_chunk_0"
    indexing.persist(index, spark, str(tmp_path), "demo")
    meta = IndexStore(spark, str(tmp_path)).metadata("demo")
    assert meta["embedding_provider"] == "lengths" and meta["quality"]["text_units"] == 3
    assert {len(x.vector) for x in indexing.load(spark, str(tmp_path), "demo", embedder=lengths).vectors.collect()} == {3}
    assert {len(x.vector) for x in indexing.load(spark, str(tmp_path), "demo").vectors.collect()} == {256}
    gap = indexing.Index(index.tables | {"vectors": index.vectors.filter("kind <> 'chunk'")}, embedder=lengths)
    assert not indexing.complete(gap.tables, 3) and indexing.complete(index.tables, 3)
    indexing.persist(gap, spark, str(tmp_path), "gap")
    assert indexing.load(spark, str(tmp_path), "gap", embedder=lengths).vectors.filter("kind = 'chunk'").count() == 3
    assert len(spark.createDataFrame([("a b",)], "t string").select(ShaEmbedder(8).embed(F.col("t"))).first()[0]) == 8


def test_overwriting_keeps_the_version_before(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    for n in (1, 2, 3):
        before = store.load("x")["t"] if n > 1 else None
        store.save("x", {"t": spark.range(n)}, {"n": n}, overwrite=True)
        assert store.load("x")["t"].count() == n and store.metadata("x") == {"n": n}
        if before is not None:
            assert before.count() == n - 1  # a reader of the old version still finds it
    assert len([p for p in os.listdir(tmp_path / "x") if p.startswith("v=")]) == 2 and not [p for p in os.listdir(tmp_path / "x") if p.endswith(".tmp")]


def test_payloads_with_and_without_an_envelope(spark, tmp_path):
    from graphweave.sources.index_store import read_payload

    bare = {
        "entities": {"A": {"name": "A", "type": "T", "description": "d", "mention_count": 2, "source_chunk_ids": ["c1", "c2"]}}, "relations": [{"source": "A", "target": "A", "relation_type": "R", "description": "", "weight": 2.5}],
        "communities": [{"id": "L0_C0", "level": 0, "entities": ["A"], "summary": "s", "size": 1}], "text_chunks": [{"id": "c1", "text": "x", "doc_id": "d", "chunk_index": 0}], "entity_embeddings": {"A": [1.0, 0.0]}, "metadata": {"odd": 1}}
    for name, doc in (("new", {"schema_version": "2.3", "index_id": "i", "graph": bare}), ("old", bare)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
        t = read_payload(spark, str(tmp_path / f"{name}.json"))
        assert t["entities"].first()[:] == ("A", "T", 2, 2, "d") and t["relations"].first().weight == 2.5
        assert {x.chunk_id for x in t["entity_chunks"].collect()} == {"c1", "c2"} and t["communities"].first().name == "A" and t["reports"].first().summary == "s"
        assert t["vectors"].first()[:] == ("entity", "A", [1.0, 0.0]) and t["claims"].count() == 0 and t["text_units"].first().chunk_id == "c1"


def test_evaluation_keeps_settings_order_and_errors(spark, tmp_path, lengths):
    docs = documents_from(spark, "demo", ["alpha beta.", "gamma delta.", "epsilon."])
    index = indexing.build_index(docs)
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "a", "index_id": "demo", "query": "gamma", "modes": ["basic", "local"], "top_k": 1, "expected_source_ids": ["entity:Sample Entity"], "expected_answer_terms": [" offline ", " "]}\n\n{"id": "b", "index_id": "demo", "query": "alpha", "modes": ["basic", "drift"], "top_k": 2}\n')
    got = {(x.case_id, x.mode): x for x in evaluate.run(index, evaluate.read_cases(spark, str(path))).collect()}
    assert got["a", "basic"].source_ids == ["demo_doc_1_chunk_0"] and len(got["b", "basic"].source_ids) == 2
    assert got["a", "local"].source_ids[-1] == "entity:Sample Entity" and got["a", "local"].source_recall == 1.0 and got["a", "basic"].source_recall == 0.0
    assert got["a", "basic"].answer_term_coverage == 1.0 and all(x.success and x.error is None and x.latency_ms > 0 for x in got.values())
    assert got["b", "drift"].source_ids[0].startswith("L0_C") and "entity:Sample Entity" in got["b", "drift"].source_ids

    class Failing:
        name = "failing"

        def complete(self, task, prompt):
            if "gamma" in prompt.split("\n")[1]:
                raise OSError("down")
            return OfflineProvider().complete(task, prompt)

    rows = {x.case_id: x for x in evaluate.run(index, evaluate.read_cases(spark, str(path)).filter("array_contains(modes, 'basic')").withColumn("modes", F.array(F.lit("basic"))).withColumn("top_k", F.lit(1)), Failing()).collect()}
    assert not rows["a"].success and rows["a"].error and rows["b"].success
    path.write_text('{"id": "a", "query": "x"}\n\n{"query": "no id"}\n')
    with pytest.raises(ValueError, match="line 3"):
        evaluate.read_cases(spark, str(path))


def test_settle_leaves_only_the_result(spark):
    folder = f"{scratch.shared_dir(spark)}/graphweave"
    scratch.save(spark.range(1))
    before = set(os.listdir(folder))
    out = scratch.settle(lambda: scratch.save(scratch.save(spark.range(5)).filter("id > 1")).filter("id > 2"))
    assert out.count() == 2 and len({p for p in set(os.listdir(folder)) - before if not p.startswith(".")}) == 1
    t = scratch.save_buckets(spark.range(20), "id", 4)
    assert t.count() == 20


def test_graphs_merge(spark):
    g = CannedProvider({})
    assert g.complete("local_query_answer", "") == OfflineProvider().complete("local_query_answer", "")
    m = spark.createDataFrame([(0, "A", "T", "d", 1, "c")], "ord long, name string, type string, description string, mention_count long, chunk_id string")
    assert graph.merge_entities(graph.merge_graphs(m, m, m)).first().mention_count == 3
