"""Scores of pairs: a vector goes to its task once, whoever asks for it."""

import numpy as np

from graphweave.operators import retrieve


def test_pairs_are_scored_by_matrix_and_vectors_are_not_copied(spark):
    r = np.random.default_rng(1)
    v = {f"k{i}": r.integers(-3, 4, 8).tolist() for i in range(30)} | {"zero": [0] * 8}
    q = {i: r.integers(-3, 4, 8).tolist() for i in range(4)} | {9: [0] * 8}
    pairs = [(i, k) for i in q for n, k in enumerate(v) if (n + i) % 2]
    df = lambda d, names: spark.createDataFrame([(a, list(map(float, b))) for a, b in d.items()], names)
    vectors, questions = df(v, "key string, vector array<double>"), df(q, "question_id long, question array<double>")
    scored = retrieve.score_pairs(spark.createDataFrame(pairs, "question_id long, key string"), vectors, questions)
    got = {(x.question_id, x.key): x.score for x in scored.collect()}
    assert set(got) == set(pairs)
    for i, k in pairs:
        a, b = np.array(q[i]), np.array(v[k])
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert abs(got[i, k] - (a @ b / size if size else 0)) < 1e-9
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
