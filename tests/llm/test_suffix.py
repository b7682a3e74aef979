"""Suffix-array dedup against brute force, and its merge against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphweave.llm import suffix

SCHEMA = "doc_id long, text string, block long, n int, kind string"


def brute(rows, window):
    docs = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + window] for _, t in docs for i in range(len(t) - window + 1))
    out = []
    for k, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((k, len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def make(seed, n, alphabet, length):
    r = random.Random(seed)
    text = lambda k: "".join(r.choices(alphabet, k=k))
    passages = [text(r.randrange(20, 900)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(r.randrange(length))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            p = r.choice(passages)
            t = t[:at] + p[r.randrange(3) :] + t[at:]
        rows.append((i, t))
    near = text(900)
    rows += [(1000 + i, near[: 90 * i] + "!" + near[90 * i :]) for i in range(8)]
    return rows


EDGES = [
    (None, "a" * 700), (2000, None), (2001, ""), (2002, "ab" * 600), (2003, "abc" * 70), (2004, "x" * 199), (2005, "y" * 200), (2006, "z" * 201), (2007, "x" * 199),
    (2008, "été ñ Ünï " * 40), (2009, "\0" * 500 + "q"), (2010, "".join(chr(0x400 + i % 900) for i in range(3000))), (2010, "".join(chr(0x400 + i % 900) for i in range(3000))),
    (2011, "".join(chr(0x400 + (i + 7) % 900) for i in range(200))), (2012, " ".join(f"long{i}" for i in range(30_000))), (2013, " ".join(f"long{i}" for i in range(500, 560))),
]


@pytest.mark.parametrize(("seed", "alphabet", "window", "gram", "block", "hot", "ranges"), [
    (1, "abcdefgh ", 200, 56, 3 << 20, 4096, 1 << 16), (2, "ab", 200, 56, 9_000, 4096, 300), (3, "ab", 24, 8, 5_000, 50, 40), (4, "abc", 32, 16, 5_000, 4096, 64), (5, "abc", 200, 56, 9_000, 1, 64),
])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet, window, gram, block, hot, ranges):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "RANGE_ROWS", ranges)
    monkeypatch.setattr(suffix, "MOST_BYTES", block)
    rows = make(seed, 60, alphabet, 1500) + EDGES
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA).repartition(4)
    got = suffix.removed(df, window=window, gram=gram, hot=hot).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_no_documents(spark):
    out = suffix.removed(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and out.count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interleave_is_the_order_of_all_texts(seed):
    """Shards' transforms, merged, give the order and the common prefixes that sorting all texts gives."""
    r = np.random.default_rng(seed)
    shards = [r.integers(0, 3, size=(n, 32)).astype(np.uint8) for n in (40, 1, 25, 33)]
    shards[2][:20] = shards[0][:20]
    sent = []
    for x in shards:
        words = x.view(">u8").astype(np.uint64)
        sent.append(np.stack(suffix.transforms(list(words.T), np.zeros(len(x), np.int64))))
    rows, common = suffix.interleave(np.concatenate(sent, axis=1), np.repeat(np.arange(4), [len(x) for x in shards]))
    texts = [t.tobytes() for x in shards for t in x]
    assert [texts[i] for i in rows] == sorted(texts)
    lcp = lambda a, b: next((i for i in range(32) if a[i] != b[i]), 32)
    assert common[1:].tolist() == [lcp(texts[a], texts[b]) for a, b in zip(rows, rows[1:])]


@pytest.mark.parametrize("chunk", [50, 333, 1 << 18])
def test_rows_across_chunks(monkeypatch, chunk):
    """Rows are the runs of windows of one anchor within a text, however the block is cut for hashing."""
    r = random.Random(chunk)
    texts = ["".join(r.choices("ab", k=k)).encode() for k in (0, 30, 24, 23, 900, 0, 200, 24)] + [b"c" * 90]
    data = b"".join(texts)
    text = suffix.Text(data, 24, 8)
    every = text.anchors(0, len(data) - 23)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    first, windows, anchor = text.rows(np.array([len(t) for t in texts]))
    want, start = [], 0
    for t in texts:
        for p in range(start, start + len(t) - 23):
            if want and want[-1][2] == every[p] and want[-1][0] + want[-1][1] == p and p > start:
                want[-1][1] += 1
            else:
                want.append([p, 1, every[p]])
        start += len(t)
    assert [list(x) for x in zip(first.tolist(), windows.tolist(), anchor.tolist())] == want


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    p = "".join(r.choices("ab", k=400)).encode()
    text = suffix.Text(b"x" * 77 + p + b"yy" * 150 + p, 200, 56)
    a = text.anchors(0, text.n - 199)
    assert (a[77 : 77 + 201] - 77 == a[777 : 777 + 201] - 777).all()
