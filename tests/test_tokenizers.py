"""Tokenizers behind budgets: words and byte pairs."""

import base64
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphweave.config import EngineConfig
from graphweave.functions.tokenizers import WORDS, BytePairTokenizer, tokenizer_for
from graphweave.operators import budget
from graphweave.plans import indexing, modes

RANKS = {bytes([i]): i for i in range(256)}
for n_, pair in enumerate(["th", "he", "the", " the", "an", "and", " and", "in", "ing", "er", "é", "éé"]):
    RANKS[pair.encode()] = 256 + n_


def merged(piece, ranks=RANKS):
    """The lowest pair first, one at a time."""
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_byte_pairs_are_merged_by_rank():
    t = BytePairTokenizer(RANKS)
    r = random.Random(1)
    for _ in range(200):
        piece = "".join(r.choice(["th", "e", "an", "d", "in", "g", "é", "er"]) for _ in range(r.randrange(1, 12)))
        assert t.tokens(piece) == merged(piece.encode())
    text = "the thing and  the éé\n\nend, 123's"
    assert t.encoding.decode(t.tokens(text)) == text and t.first(text, 10_000) == text and t.first(text, 0) == "" and t.first("", 3) == ""
    with pytest.raises(ValueError, match="single byte"):
        BytePairTokenizer({b"a": 0})


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ranks") / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in RANKS.items()))
    return BytePairTokenizer.from_file(spark, str(path), "own")


def test_ranks_from_a_file(pairs):
    assert pairs.ranks == RANKS and pairs.name == "own"


def rows(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "thing", "and", "éé", "x,y", "erring", "12", "\n"])
    return [(q, i, " ".join(word() for _ in range(r.randrange(0, 40)))) for q in range(3) for i in range(1, n + 1)]


@pytest.mark.parametrize("kind", ["words", "pairs"])
@pytest.mark.parametrize("most", [1, 37, 400])
def test_budgets_hold(spark, pairs, kind, most):
    t = WORDS if kind == "words" else pairs
    df = spark.createDataFrame(rows(most, 30), "q long, rank int, text string")
    n = {(x.q, x["rank"]): x.n for x in df.select("q", "rank", t.count(F.col("text")).alias("n")).collect()}
    got = budget.select_within(df, most, ["q"], tokenizer=t).withColumn("n", t.count(F.col("text"))).collect()
    for q in range(3):
        own = sorted((x for x in got if x.q == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1)) and sum(x.used for x in own) <= most
        assert sum(x.used for x in own) == min(most, sum(n[q, i] for i in range(1, 31)))
        assert all(x.n == n[q, x["rank"]] for x in own[:-1])
    packed = budget.batches(df, most, ["q"], tokenizer=t).withColumn("n", t.count(F.col("text"))).collect()
    sums = {}
    for x in packed:
        sums[x.q, x.batch] = sums.get((x.q, x.batch), 0) + min(n[x.q, x["rank"]], most)
    assert max(sums.values()) <= most and sum(sums.values()) == sum(min(v, most) for v in n.values())


def test_counts_and_cuts_of_nulls(spark, pairs):
    df = spark.createDataFrame([(None,), ("",), ("the thing",)], "t string")
    got = df.select(pairs.count(F.col("t")).alias("n"), pairs.truncate(F.col("t"), 2).alias("t2")).collect()
    assert [tuple(x) for x in got] == [(0, None), (0, ""), (len(pairs.tokens("the thing")), pairs.first("the thing", 2))]


def test_unknown_models_fall_back(pairs):
    known = {"gpt": WORDS, "gpt-own": pairs}
    assert tokenizer_for("gpt-own-2", known) is pairs and tokenizer_for("gpt-4", known) is WORDS
    assert tokenizer_for("other", known) is WORDS and tokenizer_for("other", known, pairs) is pairs


def test_modes_take_the_index_own_tokenizer(spark, pairs):
    """A local context under a small budget holds as many tokens as the index's tokenizer allows."""
    docs = spark.createDataFrame([(i, f"The thing number {i} and the other thing, erring in the end. " * 12) for i in range(6)], "doc_id long, text string")
    index = indexing.build_index(docs, replace(EngineConfig(), max_community_levels=1), tokenizer=pairs)
    q = spark.createDataFrame([(1, "the thing")], "question_id long, query string")
    for t in (pairs, WORDS):
        index.tokenizer = t
        units = modes.local_context(index, q, 5, 60)["text_units"]
        used = units.agg(F.sum("used")).first()[0]
        assert used == 60
    assert index.own_tokenizer is WORDS
