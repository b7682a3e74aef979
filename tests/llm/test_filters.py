"""The filter audit against brute force."""

import random
import re
from itertools import permutations

import pytest

from graphweave.llm import filters

DOCS = "doc_id long, text string, source string, n int, key string, mask int, part string"


def brute(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        rows.append((s or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def make(seed, n=150):
    r = random.Random(seed)
    texts = ["", None, " \t\n", "One #tag", "été " * 300, "ALL CAPS " * 150, "a\x0bb\x1cc " * 120, " ".join(f"w{i}" for i in range(40_000))]
    for _ in range(n // 3):
        texts.append(" ".join(r.choice(["w", "W", "x|y"][: r.randrange(1, 4)]) + str(r.randrange(r.choice([5, 400]))) for _ in range(r.randrange(150, 260))))
    docs = [(r.choice([i, i, i, i // 2, None]), r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(n)]
    docs += [(1000 + i, "copied by many " * 60, "hot") for i in range(200)] + [docs[0], docs[0]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize(("seed", "block", "cells"), [(1, 3 << 20, 1 << 22), (2, 4_000, 64), (3, 4_000, 4)])
def test_audit_equals_brute_force(spark, monkeypatch, seed, block, cells):
    """Small ranges of counters: nearly every text is a possible repeat, and results are the same."""
    monkeypatch.setattr(filters, "BLOCK_BYTES", block)
    docs, labels = make(seed)
    df = spark.createDataFrame([(*d, 1, "k", 2, "p") for d in docs], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filters.audit(filters.mask_counts(df, marks, range_cells=cells)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_unique_texts_are_cleared(spark):
    """What is shuffled with its text: all repeats, few others, one row for each text of a block."""
    docs = [(i, f"text {i} " * 20, "a") for i in range(3000)] + [(5000 + i, "same", "a") for i in range(500)]
    df = spark.createDataFrame([(*d, 1, "k", 2, "p") for d in docs], DOCS).repartition(3)
    rows = filters.possible(filters.pack(df, "doc_id", "text", "source")).collect()
    assert sum(r["n"] for r in rows if r["text"] == b"same") == 500 and len([r for r in rows if r["text"] == b"same"]) == 3
    assert len(rows) < 3 + 200


def test_no_documents(spark):
    docs, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(filters.mask_counts(docs, marks)).count() == 0
    one = spark.createDataFrame([(7, None, None, 1, "k", 2, "p")], DOCS)
    rows = filters.audit(filters.mask_counts(one, marks)).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r["part"], r["kept"], r["removed"], r["shapley"]) for r in rows] == [("", 0, 1, 120)] + [("", 0, 0, 0)] * 4
