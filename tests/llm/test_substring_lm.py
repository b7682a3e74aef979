"""Substring dedup and LM scoring against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphweave.llm import blocks, lm, substring

SCHEMA = "doc_id long, text string, lo string, block int"


def brute_repeats(rows, window):
    docs = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for k, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def make_docs(seed, n=60, words=300, vocab=40):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocab)}"
    passages = [[word() for _ in range(r.randrange(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(0, words))]
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(0, len(w) + 1)
            w[at:at] = r.choice(passages)
        rows.append((i, " ".join(w)))
    return rows


EDGES = [
    (None, "a b c"), (1000, None), (1001, ""), (1002, " \t\n "), (1003, "same " * 80), (1004, "x " * 34), (1005, "y " * 36),
    (1006, "ab cd " * 40), (1007, "nul\0in a word " * 12), (1008, " ".join(f"long{i}" for i in range(60_000))),
    (1009, " ".join(f"long{i}" for i in range(500, 560))), (1010, "été ñ Ünï " * 30), (1009, " ".join(f"long{i}" for i in range(500, 560))),
]


@pytest.mark.parametrize(("seed", "block"), [(1, 4 << 20), (2, 4 << 20), (1, 3_000), (2, 3_000)])
def test_substring_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(blocks, "RANGE_ENTRIES", 4_000)
    rows = make_docs(seed, vocab=40 if seed == 1 else 3) + EDGES
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in substring.repeated(df).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows, substring.WINDOW)


def test_substring_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = substring.repeated(df)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 0


def block_of(texts):
    """Texts of small numbers as one block."""
    out = object.__new__(blocks.Tokens)
    out.words, out.tokens = np.unique(blocks.mix64(np.concatenate(texts).astype(np.uint64) + np.uint64(7)), return_inverse=True)
    out.lengths = np.array([len(t) for t in texts])
    out.ends = np.cumsum(out.lengths)
    out.first = out.ends - out.lengths
    return out


def by_hand(seen):
    """Names as Spark gives them, from the counts of the hashes."""
    return lambda r, own: np.array([i + 1 if seen is None or seen[r][int(h)] > 1 else 0 for i, h in enumerate(own)], np.uint64)


def test_symbols_are_consistent():
    """A passage that stands in two texts has the same decided symbols in both, on every level."""
    r = np.random.default_rng(3)
    part = r.integers(0, 5, 200)
    b = block_of([np.concatenate([r.integers(0, 5, 50), part, r.integers(0, 5, 70)]), np.concatenate([part, r.integers(0, 5, 20)])])
    p = substring.Parse(b, 35, 3, by_hand(None))
    for x in p.levels[1:]:
        found = []
        for at in (50, 320):
            inside = (x.lo >= at) & (x.hi <= at + 200)
            found.append({(int(s), int(y) - at, int(z) - at) for s, y, z in zip(x.names[inside], x.lo[inside], x.hi[inside])})
        assert found[0] == found[1] and len(found[0]) > 10


def test_windows_are_written_in_symbols():
    """Equal windows are written alike and others are not; names decide, so without the higher ones the writings differ."""
    r = np.random.default_rng(4)
    part = r.integers(0, 9, 120)
    texts = [np.concatenate([r.integers(0, 9, 40), part, r.integers(0, 9, 30)]), np.concatenate([part[20:], r.integers(0, 9, 50)]), part[5:60], np.zeros(80, int)]
    b = block_of(texts)
    row = np.concatenate(texts)
    written = []
    for rounds in (1, 2, 4):
        p, h, g = substring.Parse(b, 35, rounds, by_hand(None)).written()
        same = {}
        for i, x, y in zip(p.tolist(), h.tolist(), g.tolist()):
            same.setdefault((x, y), set()).add(tuple(row[i : i + 35].tolist()))
        assert all(len(v) == 1 for v in same.values()) and len(same) == len({tuple(row[i : i + 35].tolist()) for i in p.tolist()})
        written.append({i: x for i, x in zip(p.tolist(), h.tolist())})
    assert np.mean([written[0][i] != written[2][i] for i in written[0]]) > 0.8  # all but those inside the run


def test_a_symbol_that_stands_once_ends_its_windows(spark, monkeypatch):
    """Every step of naming takes part: were all names of one level withheld, no window would be found."""
    rows = make_docs(1)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    true = sum(r.n_removed for r in substring.repeated(df).collect())
    assert true > 0
    for level in range(substring.ROUNDS + 1):
        from graphweave.llm import substring as module

        real = module.named
        monkeypatch.setattr(module, "named", lambda pdf, kind, block, level=level, real=real: real(pdf, kind, block) * np.uint64(kind != level))
        assert sum(r.n_removed for r in substring.repeated(df).collect()) < true / 4
        monkeypatch.setattr(module, "named", real)


def brute_model(rows):
    """The automaton in plain dicts: (arcs: state -> word -> (weight, state), failures: state -> (weight, state)), and the base."""
    docs = [(k, [*(t or "").encode().lower().split(), None]) for k, t in rows]
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in docs if k is not None}
    train = [["<s>", *w] for k, w in docs if not held.get(k, False)]
    c1 = Counter(x for w in train for x in w[1:])
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    c2 = Counter(b for w in train for b in zip(w, w[1:]))
    c3 = Counter(b for w in train for b in zip(w, w[1:], w[2:]))
    h1 = Counter(c1) + Counter({"<s>": len(train)})
    cls = lambda c: c if c <= 4 else 3 + c.bit_length()

    def new(grams, history):
        seen, novel = Counter(), Counter()
        for g, c in grams.items():
            seen[cls(history[g[:-1]])] += c
            novel[cls(history[g[:-1]])] += c == 1
        return lambda c: (novel[cls(c)] + 0.5) / (seen[cls(c)] + 1)

    k2, k3 = new(c2, {(u,): c for u, c in h1.items()}), new(c3, c2)
    p2 = lambda u, w: (1 - k2(h1[u])) * c2[u, w] / h1[u] + k2(h1[u]) * p1(w)
    p3 = lambda t, u, w: (1 - k3(c2[t, u])) * c3[t, u, w] / c2[t, u] + k3(c2[t, u]) * p2(u, w)
    arcs, failures = {(): {w: (math.log10(p1(w)), (w,)) for w in c1}}, {}
    for u in h1:
        if u is not None:
            arcs[u,], failures[u,] = {}, (math.log10(k2(h1[u])), ())
    for u, w in c2:
        arcs[u,][w] = (math.log10(p2(u, w)), (u, w))
        arcs[u, w], failures[u, w] = {}, (math.log10(k3(c2[u, w])), (w,))
    for t, u, w in c3:
        arcs[t, u][w] = (math.log10(p3(t, u, w)), (u, w))
    return docs, held, arcs, failures, c1, n, p1


def brute_lm(rows):
    docs, held, arcs, failures, c1, n, p1 = brute_model(rows)
    out = []
    for k, words in docs:
        state, total = ("<s>",) if ("<s>",) in arcs else (), 0.0
        for w in words:
            while w not in arcs[state] and state:
                total, state = total + failures[state][0], failures[state][1]
            if w in arcs[state]:
                total, state = total + arcs[state][w][0], arcs[state][w][1]
            else:
                total, state = total + math.log10(p1(w)), ()
        out.append((k, held.get(k, False), len(words), sum(c1[x] > 0 for x in words), n, sum(math.log10(p1(w)) for w in words), total))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2_000, 4 << 20])
def test_lm_equals_brute_force(spark, monkeypatch, block):
    """Also over many blocks and ranges, and lanes that begin inside a text."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(blocks, "RANGE_ENTRIES", 5_000)
    monkeypatch.setattr(lm, "LANE", 16)
    rows = make_docs(5, n=80, words=120) + EDGES + [(2000 + i, f"rare{i} word rare{i} word") for i in range(40)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=repr)
    want = brute_lm(rows)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) >= sum(g[5] for g in held)


def test_weights_of_a_state_add_up_to_one():
    _, _, arcs, failures, c1, _, p1 = brute_model(make_docs(5, n=30, words=60))
    words = list(c1)

    def probability(state, w):
        if w in arcs[state]:
            return 10 ** arcs[state][w][0]
        return 10 ** failures[state][0] * probability(failures[state][1], w) if state else p1(w)

    for state in list(arcs)[::37]:
        if state and state[-1] is not None:
            total = sum(probability(state, w) for w in words) + probability(state, "a word never seen")
            assert total == pytest.approx(1.0, abs=1e-6)


def test_twice_seen_texts_score_apart(spark):
    r = random.Random(12)
    text = lambda: " ".join(f"v{r.randrange(400)}" for _ in range(80))
    rows = [(i, text()) for i in range(400)]
    rows += [(1000 + k, t) for k, t in rows[:60]]
    got = lm.score(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA)).collect()
    twice = {k for k in range(60) if zlib.crc32(str(k).encode()) % 10 and zlib.crc32(str(1000 + k).encode()) % 10}
    gain = {g.doc_id: (g.score - g.base_score) / g.n_tokens for g in got if not g.held_out}
    assert min(gain[k] for k in twice) > max(g for k, g in gain.items() if 60 <= k < 400)


def test_counts_have_64_bits():
    big = np.array([5_000_000_000, 7, 2**40], np.uint64)
    assert blocks.get(blocks.put(big), "<u8").tolist() == big.tolist()
    keys = np.array([1, 5, 9], np.uint64)
    total, n, where = blocks.added([keys, keys[1:]], [big, big[1:]])
    assert total.tolist() == [5_000_000_000, 14, 2**41] and n.tolist() == [1, 2, 2] and where.tolist() == [0, 1, 2, 1, 2]


def test_lm_empty(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
