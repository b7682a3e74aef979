"""Steps whose work must not grow faster than their input."""

import json
import random
from dataclasses import replace

from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.functions import vectors
from graphweave.functions.text import features
from graphweave.operators import chunking, community, describe, extract, graph, retrieve
from graphweave.queries import base, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sha_sums_are_the_native_ones(spark):
    docs = spark.createDataFrame([(1, "the cat the cat sat \u00fc"), (2, ""), (3, None), (4, "alone")], "doc_id long, text string")
    own = docs.select("doc_id", F.inline(vectors.sha_sums(F.col("text"), 16))).collect()
    f = docs.select("doc_id", F.explode(features(F.col("text"))).alias("f")).withColumn("n", vectors.sha_number(F.col("f")))
    native = f.groupBy("doc_id", vectors.sha_bucket(F.col("n"), 16).alias("dim")).agg(F.sum(vectors.sha_sign(F.col("n"))).alias("value")).collect()
    assert sorted(map(tuple, own)) == sorted(map(tuple, native))


def test_ranking_makes_vectors_once_and_skips_nulls(spark):
    texts = spark.createDataFrame([("a", "one two"), ("b", "three")], "key string, text string")
    q = texts.filter("key = 'a'").select(F.lit(1).alias("question_id"), vectors.hash_embedding(F.col("text"), 16).alias("question"))
    best = retrieve.rank_named(texts.select("key", vectors.hash_embedding(F.col("text"), 16).alias("vector")), q, 2)
    assert plan(best).count("ArrowEvalPython") == 1 and best.count() == 2
    some = spark.createDataFrame([("a", [1.0] * 16), ("n", None)], "key string, vector array<double>")
    assert [r["key"] for r in retrieve.rank_named(some, q, 2).collect()] == ["a"]


def test_each_hop_reads_the_edges_that_were_saved(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "c", 2.0), ("c", "d", 1.0)], "u string, v string, weight double")
    assert plan(graph.both_ways(edges)).count("LogicalRDD") == 1
    assert sorted(map(tuple, graph.both_ways(edges).filter("a = 'c' or b = 'c'").collect())) == [("b", "c", 1.0), ("c", "b", 1.0), ("c", "c", 2.0), ("c", "d", 1.0), ("d", "c", 1.0)]
    seeds = spark.createDataFrame([("a",)], "name string")
    around = graph.neighbors(seeds, edges, 2)
    assert sorted((r["name"], r["depth"]) for r in around.collect()) == [("b", 1), ("c", 2)]
    assert plan(around).count("LogicalRDD") <= 1  # the seeds


def test_descriptions_read_mentions_once(spark):
    m = spark.createDataFrame([("x", 2, "b"), ("x", 1, " a "), ("x", 3, "a"), ("y", 1, " "), ("z", 1, None), ("x", 4, "")], "name string, ord int, description string")
    out = describe.listed(m, "name", cap=2)
    assert plan(out).count("LogicalRDD") == 1
    assert {r["name"]: r["ds"] for r in out.collect()} == {"x": ["a", "b"], "y": [], "z": []}


def test_merging_long_lists_is_not_quadratic(spark):
    said = {"same": ["a", "a", " a "], "again": ["a", "", "b", "b"], "whole": ["a", "b", "a | b", "c"], "none": ["", " "]}
    rows = [(k, i, d) for k, ds in said.items() for i, d in enumerate(ds)] + [("hub", i, f"text {i} " + "x" * 200) for i in range(20_000)]
    got = {r["k"]: r["description"] for r in describe.merged_texts(spark.createDataFrame(rows, "k string, ord int, description string"), "k").collect()}
    assert got.pop("hub") == " | ".join(d for k, _, d in rows if k == "hub")
    assert got == {"same": "a", "again": "a | b | b", "whole": "a | b | c", "none": ""}


def test_answers_are_parsed_once_and_by_the_ladder(spark):
    entity = lambda name, said="d": {"name": name, "type": "t", "description": said}
    good = json.dumps({"entities": [entity("a"), entity("b", None)], "relations": [{"source": "a", "target": "b", "relation_type": "r", "description": "d"}]})
    number = '{"entities": [{"name": "n", "type": "t", "description": 1.50}, {"name": 5, "type": "t", "description": {"x" :1}}], "relations": [{"source": "5", "target": "n", "relation_type": "r", "description": true}]}'
    half = json.dumps({"entities": [entity("h", "\ud83d")], "relations": []})
    said = {"plain": good, "fenced": f"```json\n{good}\n```", "behind a list": f"[] {good}", "empty first": f"{{}}\n```json\n{good}\n```", "no text": number, "half": half, "broken": good[:40], "dangling": good.replace('"target": "b"', '"target": "c"'), "null": None}
    responses = spark.createDataFrame(list(said.items()), "chunk_id string, response string").withColumn("ord", F.col("chunk_id"))
    e, r = extract.mentions(responses)
    assert [plan(x).count("ArrowEvalPython") for x in (e, r)] == [1, 1] and "VariantExpression" not in plan(r)
    names = {}
    for x in e.orderBy("ord").collect():
        names.setdefault(x["chunk_id"], []).append((x["name"], x["description"]))
    assert set(names) == {"plain", "fenced", "behind a list", "empty first", "no text", "half"}
    assert names["plain"] == names["behind a list"] == names["empty first"] == [("a", "d"), ("b", None)]
    assert names["no text"] == [("n", "1.5"), ("5", '{"x":1}')]
    assert sorted((x["chunk_id"], x["source"], x["target"], x["description"]) for x in r.collect()) == [(c, "a", "b", "d") for c in ("behind a list", "empty first", "fenced")] + [("no text", "5", "n", "true"), ("plain", "a", "b", "d")]


def test_weights_alone_are_those_of_merged_relations_without_chunks(spark):
    rows = [(i, "ab"[i % 2], "bcx"[i % 3], "r", float(i), f"c{i % 4}") for i in range(24)]
    m = spark.createDataFrame(rows, "ord int, source string, target string, relation_type string, weight double, chunk_id string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    alone, keys = graph.merge_weights(m, names), ["source", "target", "relation_type", "weight"]
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, graph.merge_relations(m, names).select(keys).collect()))
    assert alone.columns == keys and "chunk_id" not in plan(alone).split("LogicalRDD")[0] and "RepartitionByExpression" not in plan(alone)


def test_modularity_goes_over_the_edges_once(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 3.0), ("d", "d", 1.0)], "u string, v string, weight double")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "name string, c int")
    q = community.modularity(edges, members)
    assert plan(q).count("LogicalRDD") == 3 and abs(q.first()["q"] - (2 / 7 - (5 / 14) ** 2 + 4 / 7 - (9 / 14) ** 2)) < 1e-12
    assert community.modularity(edges.limit(0), members).first()["q"] == 0


def test_windows_of_many_documents_are_made_in_slices(spark, monkeypatch):
    def by_sign(text, size, overlap):
        at, out = 0, []
        while True:
            stop = min(at + size, len(text))
            if stop < len(text):
                stop = next((i + 1 for i in range(stop - 1, at + size // 2 - 1, -1) if text[i] in chunking.MARKS), stop)
            out += [p] if (p := text[at:stop].strip()) else []
            if stop == len(text):
                return out
            at = stop - overlap

    r = random.Random(3)
    texts = ["".join(r.choices("ab c.?。\n", [20, 20, 5, 5, 1, r.random(), r.random(), r.random()], k=r.randrange(1, 400))) for _ in range(300)]
    monkeypatch.setattr(chunking, "SLICE", 7)
    config = replace(EngineConfig(), chunk_size=100, chunk_overlap=20)
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, " ")], "doc_id int, text string")
    own = chunking.chunk_documents(docs, config)
    assert plan(own).count("MapInArrow") == 1 and "Generate" not in plan(own)
    got = {}
    for x in own.orderBy("doc_id", "chunk_index").collect():
        got.setdefault(x["doc_id"], []).append(x["text"])
    assert got == {i: w for i, t in enumerate(texts) if not t.isspace() and (w := by_sign(t, 100, 20))}


def test_relations_that_questions_are_asked_of_are_merged_by_weight_alone(spark):
    sf_dir = "/root/testdata/sf0.001"
    own, keys = retrieval.table_graph(spark, sf_dir)["relations"], ["source", "target", "relation_type", "weight"]
    assert own.columns == [*keys, "description"]
    merged = base.relations(spark, sf_dir).select(keys)
    assert own.count() == merged.count() > 0 and own.select(keys).exceptAll(merged).isEmpty()
