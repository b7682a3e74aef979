"""Settings, text units, budgets, JSON out of text, embeddings."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.functions.json_ladder import find_json
from graphweave.functions.text import normalize_question, normalize_surface, normalize_surface_exact, token_count, truncate_tokens
from graphweave.functions.vectors import cosine, hash_features
from graphweave.operators import budget
from graphweave.operators.chunking import chunk_documents, windows
from graphweave.sources.documents import TooLarge, check_index_id, documents_from, guard


def test_settings_are_checked():
    for bad in ({"chunk_overlap": 1000}, {"chunk_size": 0}, {"community_resolution_multiplier": 1.0}, {"min_edge_weight_percentile": 101.0}, {"drift_confidence_gate": 2.0}, {"community_algorithm": "x"}, {"max_node_degree_std": -1.0}):
        with pytest.raises(ValueError):
            replace(EngineConfig(), **bad)


def test_windows():
    text = "Alpha beta gamma. Delta epsilon zeta. Eta theta iota."
    got = windows(text, 30, 5)
    assert 2 <= len(got) <= 9 and all(w["text"] for w in got) and got == windows(text, 30, 5)
    assert [w["chunk_index"] for w in got] == list(range(len(got)))
    assert windows(None, 30, 5) == windows("", 30, 5) == windows(" \n\t", 30, 5) == []
    assert [len(w["text"]) for w in windows("x" * 100, 40, 10)] == [40, 40, 40]
    with pytest.raises(RuntimeError):
        windows("a" * 5 + "." + "b" * 50, 10, 9)


def test_windows_cover_the_text():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab .?\n") for _ in range(r.randrange(400)))
        joined = [w["text"] for w in windows(text, 50, 12)]
        assert all(p in text for p in joined)
        assert sum(len(p) for p in joined) >= len(text.replace(" ", "").replace("\n", ""))


def test_chunk_documents(spark):
    docs = documents_from(spark, "demo", ["One. Two.", " ", "Three." * 400])
    got = chunk_documents(docs).orderBy("chunk_id").collect()
    assert got[0].chunk_id == "demo_doc_0_chunk_0" and got[0].text == "One. Two." and not [g for g in got if g.doc_id == "demo_doc_1"]
    with pytest.raises(ValueError):
        guard(docs, EngineConfig())
    with pytest.raises(TooLarge):
        guard(docs, replace(EngineConfig(), max_documents=2))


@pytest.mark.parametrize("bad", ["", "../escape", "../../etc/passwd", ".x", "a" * 129, "a b"])
def test_index_ids(bad):
    assert check_index_id("demo-1.x_y")
    with pytest.raises(ValueError):
        check_index_id(bad)


def test_surfaces(spark):
    df = spark.createDataFrame([("  ACME! ",), ("A-B  c_d",), ("Straße ﬁ",), (None,)], "x string")
    got = df.select(normalize_surface(F.col("x")).alias("n"), normalize_surface_exact("x").alias("e")).collect()
    assert [g.n for g in got[:2]] == ["acme", "a b c_d"] == [g.e for g in got[:2]]
    assert got[2].e == "strasse fi" and got[3].e is None
    q = spark.createDataFrame([("  What  IS it ?! ",)], "x string").select(normalize_question(F.col("x"))).first()[0]
    assert q == "what is it"


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 2}\n```', {"a": 2}), ('Here: ```\n{"a": 3}``` ok', {"a": 3}), ('noise {"a": {"b": {"c": {"d": 4}}}} tail', {"a": {"b": {"c": {"d": 4}}}}),
    ("{broken", None), ("", None), (None, None), ("no json", None), ("[1, 2]", [1, 2]), ('{not this} {"a": 5}', {"a": 5}), ('{"a": "}"} x', {"a": "}"}),
])
def test_find_json(text, want):
    assert find_json(text) == want
    assert find_json("see [1, 2] there", "[") == [1, 2]


def test_embedding(spark):
    a = hash_features("graph retrieval graph", 128)
    assert np.array_equal(a, hash_features("graph retrieval graph", 128)) and np.linalg.norm(a) == pytest.approx(1)
    assert not hash_features("", 128).any() and not hash_features(None, 128).any()
    q, c = hash_features("knowledge graph retrieval", 256), [hash_features(t, 256) for t in ("a knowledge graph for retrieval", "cooking pasta at home", "weather tomorrow")]
    assert max(range(3), key=lambda i: float(q @ c[i])) == 0
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()[0]
    assert z == 0.0


def greedy_select(counts, limit):
    out, used = [], 0
    for c in counts:
        if used >= limit:
            break
        out.append(min(c, limit - used))
        used += out[-1]
    return out


def test_budget_selection_equals_the_greedy_loop(spark):
    r = random.Random(2)
    lists = [(i, [r.randrange(0, 12) for _ in range(r.randrange(0, 30))]) for i in range(60)]
    rows = [(i, j * (budget.RANGE // 7), "w " * n) for i, ns in lists for j, n in enumerate(ns)]
    got = {}
    for g in budget.select_within(spark.createDataFrame(rows, "list long, rank long, text string"), 40, ["list"]).select("list", "rank", "used", token_count(F.col("text")).alias("n")).orderBy("list", "rank").collect():
        got.setdefault(g[0], []).append(g.used)
        assert g.n == g.used
    for i, ns in lists:
        assert got.get(i, []) == greedy_select(ns, 40)


def test_batches_and_truncation(spark):
    assert budget.next_fit([10, 10, 10], 12) == [1, 2, 3] and budget.next_fit([5, 0, 7, 1, 30], 12) == [1, 0, 1, 2, 3]
    df = spark.createDataFrame([("one two, three",)], "t string")
    assert df.select(truncate_tokens(F.col("t"), 3)).first()[0] == "one two,"
    assert df.select(truncate_tokens(F.col("t"), 0)).first()[0] == ""
