"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text becomes a short vector of statistics (sizes, shares of kinds of bytes
and words, repetition). Trees are grown on the driver from a bounded sample of
labelled rows, level by level over histograms of TRAIN_BINS quantile bins, and
flattened into arrays: node i of a tree has the children 2i+1 and 2i+2, so a
batch of rows goes down all trees with a few numpy gathers. The arrays are a
few kB and travel with the tasks; every row of the table is scored.

Defined cases: a null text is scored as an empty one, whose statistics are all
zero; a label that is null or neither 0 nor 1 is left out; a key labelled
several times counts once, as 1 if at least half of its labels are; a labelled
key that stands in several rows is learnt from one of them; without training
rows every score is 0.5, with one class it is near that class; equal rows get
equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many labelled rows at most are learnt from: a seeded share of the
#: labels where there are more. It bounds the driver's memory at about 8 MB.
TRAIN_ROWS = 20_000
TRAIN_BINS = 64
TREES, DEPTH, RATE, LAMBDA, LEAST = 60, 4, 0.15, 1.0, 10
FOLDS, HELD = 4, 2
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "newline", "period", "comma", "mark", "symbol",
    "high", "other_byte", "byte_entropy", "distinct_words", "repeat_next", "capital_words", "distinct_lines", "mean_line",
)


def _kinds() -> np.ndarray:
    """The kind of each byte, an index into the shares below."""
    kind = np.full(256, 10)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?;:'\"()-")):
        kind[list(chars)] = i
    kind[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 8
    kind[128:] = 9
    return kind


KINDS = _kinds()


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(KINDS, counts, 11) / len(data)
    p = counts[counts > 0] / len(data)
    words = data.split()
    n = len(words) or 1
    lines = data.split(b"\n")
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), (len(data) - counts[32] - counts[10]) / n, *shares.tolist(),
        float(-(p * np.log2(p)).sum()), len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
        sum(w[:1].isupper() for w in words) / n,
        len(set(lines)) / len(lines), float(np.log1p(len(data) / len(lines))),
    ]


@dataclass(frozen=True)
class Trees:
    """Flat trees: inner nodes have a feature and a threshold, all paths end at the same depth."""

    start: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting on the logistic loss; every level's histograms come from one bincount."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, TRAIN_BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    own = binned + np.arange(k) * TRAIN_BINS
    raw = np.full(n, start)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            cell = (own + (node - (width - 1))[:, None] * (k * TRAIN_BINS)).ravel()
            size = width * k * TRAIN_BINS
            hist = [np.bincount(cell, np.repeat(w, k), size).reshape(width, k, TRAIN_BINS).cumsum(axis=2) for w in (g, h, np.ones(n))]
            total = [a[:, :, -1:] for a in hist]
            gain = hist[0] ** 2 / (hist[1] + LAMBDA) + (total[0] - hist[0]) ** 2 / (total[1] - hist[1] + LAMBDA) - total[0] ** 2 / (total[1] + LAMBDA)
            gain[(hist[2] < LEAST) | (total[2] - hist[2] < LEAST)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for i in range(width):
                if flat[i, best[i]] > 1e-6:
                    j, b = divmod(int(best[i]), TRAIN_BINS)
                    if b < len(edges[j]):
                        f[width - 1 + i], t[width - 1 + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + LAMBDA)
        raw += v[leaf]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Trees(start, np.stack(fs), np.stack(ts), np.stack(vs))


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    own = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("y in (0, 1) and k is not null").filter(fold(F.col("k")) != HELD)
    own = own.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    share = min(1.0, rows / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    x = F.pandas_udf(lambda s: pd.Series([features(t) for t in s]), "array<double>")
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(own), "k").select("k", "y", x("t").alias("x"))
    got = found.groupBy("k", "y").agg(F.min("x").alias("x")).select("y", "x").toPandas()
    order = np.lexsort(np.array(got["x"].tolist()).T) if len(got) else []  # the sums don't depend on the order of arrival
    return grow(np.array(got["x"].tolist()).reshape(-1, len(FEATURES))[order], got["y"].to_numpy(np.float64)[order])


def with_score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the column name added (or replaced)."""
    score = F.pandas_udf(lambda s: pd.Series(trees.score(np.array([features(t) for t in s]).reshape(-1, len(FEATURES)))), "double")
    return docs.withColumn(name, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(rows, train(docs, labels, key, text)).drop("text")
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    return with_score(docs, train(docs, labels, key, text), text, "graphweave_score").filter(F.col("graphweave_score") >= threshold).drop("graphweave_score")
