"""Ranking in bounded memory: tiles, batches and blocks change nothing; ties go by key."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweave.operators import retrieve


def brute(v, q, k):
    unit = lambda x: [c / n if (n := sum(y * y for y in x) ** 0.5) else 0.0 for c in x]
    out = []
    for i, x in q:
        s = sorted((-round(sum(a * b for a, b in zip(unit(x), unit(y))), 9), key) for key, y in v)
        out += [(i, n + 1, key, -score) for n, (score, key) in enumerate(s[:k])]
    return out


def make(seed, n, m, d=4):
    r = random.Random(seed)
    v = [(f"k{i:04d}", [float(r.choice([-1, 0, 0, 1, 2])) for _ in range(d)]) for i in range(n)]  # many ties, some zero vectors
    q = [(i, [float(r.choice([-1, 0, 1])) for _ in range(d)]) for i in range(m)]
    r.shuffle(v)
    return v, q


@pytest.mark.parametrize(("tile", "block", "k"), [(16 << 20, 32 << 20, 3), (64, 32 << 20, 5), (900, 96, 1), (900, 32 << 20, 400)])
def test_tiles_and_blocks(spark, monkeypatch, tile, block, k):
    monkeypatch.setattr(retrieve, "QUESTION_BYTES", block)
    v, q = make(1, 300, 11)
    vectors = spark.createDataFrame(v, "key string, vector array<double>").repartition(3)
    questions = spark.createDataFrame(q, "question_id long, question array<double>")
    got = [(r.question_id, r["rank"], r.key, r.score) for r in retrieve.rank_named(vectors, questions, k).collect()]
    assert sorted(got) == sorted(brute(v, q, k))
    best = retrieve.Best(np.array([[0.5, 0.5, 0.5, 0.5]]), k)
    monkeypatch.setattr(retrieve, "TILE_BYTES", tile)
    for at in range(0, len(v), 7):
        best.add(pa.array([x for x, _ in v[at : at + 7]]), np.array([y for _, y in v[at : at + 7]]))
    (rows,) = best.slices()
    assert list(zip(rows[1].to_pylist(), rows[2].tolist())) == [(key, s) for _, _, key, s in brute(v, [(0, [1.0] * 4)], k)]


def test_what_a_task_holds_does_not_grow(monkeypatch):
    """With every score equal, thousands of batches leave k rows a question and never hold many more."""
    best = retrieve.Best(np.ones((50, 2)) / 2**0.5, 4)
    most = 0
    for i in range(400):
        best.add(pa.array([f"{i:03d}{j:03d}" for j in range(200)]), np.ones((200, 2)))
        most = max(most, best.n)
    assert most <= max(1 << 16, 2 * 50 * 4) + 50 * 4
    (rows,) = best.slices()
    assert rows[1].to_pylist() == [f"000{j:03d}" for j in range(4)] * 50


def test_50_000_questions_of_256_dimensions(spark):
    """Over 100 MB of questions against all vectors, with what a task holds bounded by blocks and tiles."""
    n, m, d = 600, 50_000, 256
    vector = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.pmod(F.hash(F.col("id"), i), F.lit(1000)) / 500 - 1))
    vectors = spark.range(n).select(F.format_string("v%05d", "id").alias("key"), vector.alias("vector"))
    questions = spark.range(m).select(F.col("id").alias("question_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.pmod(F.hash(F.col("id") % n, i), F.lit(1000)) / 500 - 1)).alias("question"))
    blocks = retrieve.question_blocks(questions)
    assert len(blocks) == 4 and sum(b.count() for b in blocks) == m
    got = retrieve.rank_named(vectors, questions, 2)
    first = got.filter("rank = 1").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.substring("key", 2, 9).cast("long") == F.col("question_id") % n) & (F.col("score") == 1.0)).alias("own")).first()
    assert (first["n"], first["own"]) == (m, m) and got.count() == 2 * m
