"""Whitening of embeddings with exact sums of products.

Components become whole numbers, floor(256 * c). The fit list has each distinct
vector once. Its sums of products are found bit by bit: a dimension's values,
less their minimum, are cut into bit planes, a plane is packed across rows into
words of 64 bits, and the product of two dimensions is the sum over their
planes a, b of 2^(a+b) times the set bits of both. A task adds up its rows in
blocks of bounded size, Spark adds up the tasks, in limbs of 16 bits that can't
overflow, and n times the sums of products less the products of the sums, the
covariance times n squared, is a matrix of whole numbers: nothing is rounded
before it is divided, once, for eigh. Only this matrix, whose size follows from
the dimension, comes to the driver.

Defined cases: a null vector or one with a null, NaN or infinite entry takes no
part; neither does an empty vector, nor one of another length than most (the
longer one, if two lengths are equally common); entries beyond 64 bits are the
nearest long; repeated rows are rows of the result and count once in the fit; a
deviation beyond 64 bits is null; where a component has no variance (fewer
distinct vectors than dimensions, say), whitened is null, and identity_error is
over the others, 0 if there are none; explained is null if the variance is 0
altogether; an empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE = 256
COMPONENTS = 4
#: Bytes of bit planes that a task has at a time, about; rows in them at most.
PLANE_BYTES, BLOCK_ROWS = 8 << 20, 1 << 16
LIMB = 16
#: Variance below this share of the largest is rounding.
NO_VARIANCE = 1e-12


@dataclass
class Fit:
    """n, sums by dimension, the eigenvalues and unit eigenvectors (columns) of the first components, the covariance's
    trace, and the largest absolute value of n * x - S."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    reach: int


def whole(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key, x array<long>) of the rows that take part, and their length."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.filter(finite & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.transform(c, lambda v: F.floor(v * SCALE).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.filter(F.size("x") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Of rows of whole numbers below 2^bits: (dimension, bit, word) with a row in each bit of a word."""
    rows = -(-len(x) // 64) * 64
    padded = np.zeros((x.shape[1], rows), np.uint64)
    padded[:, : len(x)] = x.T
    out = np.empty((x.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits((padded >> np.uint64(b)).astype(np.uint8) & 1, axis=1).view(np.uint64)
    return out


def scatter(p: np.ndarray, products: np.ndarray, sums: np.ndarray) -> None:
    """Add what the planes hold: products[i, j >= i, limb] and sums[i, limb]; a limb counts units of 2^(16 * limb)."""
    d, bits, _ = p.shape
    for i in range(d):
        rest = p[i:].reshape(-1, p.shape[2])
        for a in np.flatnonzero(p[i].any(axis=1)).tolist():
            both = np.bitwise_count(p[i, a] & rest).sum(axis=1, dtype=np.int64).reshape(d - i, bits)
            sums[i, a // LIMB] += int(np.bitwise_count(p[i, a]).sum()) << a % LIMB
            for b in range(bits):
                products[i, i:, (a + b) // LIMB] += both[:, b] << (a + b) % LIMB


def fit(x: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """x: a table of distinct vectors of length d, which is read twice."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for m in (matrix(b.column(0), d) for b in batches if b.num_rows):
            low, high = (m.min(0), m.max(0)) if low is None else (np.minimum(low, m.min(0)), np.maximum(high, m.max(0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = x.mapInArrow(bounds, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not found:
        return None
    low, high = [r["low"] for r in found], [r["high"] for r in found]
    bits = max(1, max(h - lo for lo, h in zip(low, high)).bit_length())
    shift = np.array(low, np.int64).view(np.uint64)
    limbs, rows = (2 * bits - 2) // LIMB + 1, max(64, min(BLOCK_ROWS, PLANE_BYTES * 8 // (d * bits)) // 64 * 64)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = np.zeros((d, d, limbs), np.int64), np.zeros((d, limbs), np.int64), 0
        for b in batches:
            m = matrix(b.column(0), d).view(np.uint64) - shift  # below 2^64: differences don't overflow
            n += len(m)
            for at in range(0, len(m), rows):
                scatter(planes(m[at : at + rows], bits), products, sums)
        i, j, k = np.nonzero(products)
        s, t = np.nonzero(sums)
        zero = np.zeros(len(s), np.int64)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, s, [-1]]).astype(np.int32)), pa.array(np.concatenate([j, zero - 1, [-1]]).astype(np.int32)), pa.array(np.concatenate([k, t, [0]]).astype(np.int32)), pa.array(np.concatenate([products[i, j, k], sums[s, t], [n]]))],
                ["i", "j", "limb", "total"])

    added = x.mapInArrow(cross, "i int, j int, limb int, total long").groupBy("i", "j", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    product, total, n = np.zeros((d, d), object), [0] * d, 0
    for r in added:
        value = int(r["total"]) << LIMB * r["limb"]
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            total[r["i"]] += value
        else:
            product[r["i"], r["j"]] += value
    s = np.array(total, object)
    product = np.triu(product) + np.triu(product, 1).T
    centred = n * product - np.outer(s, s)  # a shift leaves it as it is
    # Whole numbers are divided as such: each entry is rounded once.
    values, vectors = np.linalg.eigh((centred / (n * n)).astype(np.float64))
    own = [t + n * lo for t, lo in zip(total, low)]
    reach = max(max(abs(n * lo - t), abs(n * h - t)) for lo, h, t in zip(low, high, own))
    k = min(components, d)
    return Fit(n, own, values[::-1][:k], vectors[:, ::-1][:, :k], float(sum(centred[i, i] for i in range(d)) / (n * n)), reach)


def projected(x: np.ndarray, f: Fit, use: np.ndarray) -> np.ndarray:
    """The components that have variance, each divided by its standard deviation."""
    mean = np.array([t / f.n for t in f.sums])
    return (x - mean) @ (f.vectors[:, use] / np.sqrt(f.values[use]))


def deviations(x: np.ndarray, f: Fit) -> pa.Array:
    d = x.shape[1]
    if f.reach * f.reach * d < 1 << 63:
        # The differences fit, so it does no harm if what they are the difference of wraps around.
        sums = np.array([t % (1 << 64) for t in f.sums], np.uint64)
        return pa.array(((x.view(np.uint64) * np.uint64(f.n) - sums).view(np.int64) ** 2).sum(axis=1))
    wide = [sum((f.n * v - t) ** 2 for v, t in zip(row, f.sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in wide], pa.int64())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    rows, d = whole(embeddings, key, vector)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = save(rows.select("x").distinct())
    f = fit(x, d, components)
    if f is None:
        return rows.select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in schema.split(", ")[1:])]).limit(0)
    use = f.values > NO_VARIANCE * max(f.values[0], 0)
    k, m = len(f.values), int(use.sum())

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, centre = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            w = projected(matrix(b.column(0), d), f, use)
            out, centre = out + w.T @ w, centre + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m + m)), pa.array(np.concatenate([out.ravel(), centre]))], ["at", "total"])

    error = 0.0
    if m:
        got = np.array([r["total"] for r in x.mapInArrow(squares, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()]) / f.n
        error = float(np.abs(got[: m * m].reshape(m, m) - np.outer(got[m * m :], got[m * m :]) - np.eye(m)).max())
    explained = [float(v / f.trace) if f.trace > 0 else None for v in f.values]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), d)
            white = np.full((len(v), k), np.nan)
            white[:, use] = projected(v, f, use)
            each = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))), pa.array(np.full(len(each), f.n)), deviations(v, f).take(pa.array(each)),
                 pa.array(white.ravel(), mask=np.tile(~use, len(v))), pa.array(explained * len(v), pa.float64()), pa.array(np.full(len(each), error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(finish, schema)
