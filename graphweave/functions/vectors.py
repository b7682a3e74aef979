"""Vector functions in double precision, inside code generation."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def _blake(features: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each: its place, from the digest's first 8 bytes, and whether it counts plus, from the next."""
    d = np.frombuffer(b"".join([hashlib.blake2b(f, digest_size=16).digest() for f in features]), ">u8").reshape(-1, 2)
    return (d[:, 0] % np.uint64(dim)).astype(np.int64), (d[:, 1] >> np.uint64(56)).astype(np.int64) & 1


def _sha(features: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as sha_bucket() and sha_sign() have it: place from the first eight hex digits, sign from the ninth."""
    d = np.frombuffer(b"".join([hashlib.sha256(f).digest() for f in features]), ">u4").reshape(-1, 8).astype(np.int64)
    return d[:, 0] % dim, d[:, 1] >> 28 & 1


def signed_counts(text: str, dim: int, hashed: Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(dim, 2): how often words and neighbouring pairs with minus and with plus fall to each place. Each distinct feature
    is hashed once; text is in lower case."""
    words = [w.encode() for w in re.findall(r"\w+", text)]
    counts = Counter(words)
    counts.update(map(b"::".join, zip(words, words[1:])))
    place, plus = hashed(list(counts), dim)
    return np.bincount(2 * place + plus, np.fromiter(counts.values(), float, len(counts)), 2 * dim).reshape(dim, 2)


def _unit(counts: np.ndarray) -> np.ndarray:
    v = counts[:, 1] - counts[:, 0]
    n = np.linalg.norm(v)
    return v / n if n else v


def hash_features(text: str | None, dim: int) -> np.ndarray:
    """Signed feature hashing of words and neighbouring pairs, to length 1."""
    return _unit(signed_counts((text or "").casefold(), dim, _blake)).astype(np.float32)


def sha_features(text: str | None, dim: int) -> np.ndarray:
    """The same with SHA-256 and lower case, as sha_bucket() and sha_sign() have it: what other engines can compute too."""
    return _unit(signed_counts((text or "").lower(), dim, _sha))


def _embedding(text: Column, dim: int, features: Callable[[str | None, int], np.ndarray], kind: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        rows = np.empty((len(texts), dim), np.float64 if kind == "double" else np.float32)
        for i, t in enumerate(texts):
            rows[i] = features(t.as_py(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(rows.reshape(-1)))

    return F.arrow_udf(run, f"array<{kind}>")(text)


def sha_embedding(text: Column, dim: int) -> Column:
    return _embedding(text, dim, sha_features, "double")


def hash_embedding(text: Column, dim: int) -> Column:
    return _embedding(text, dim, hash_features, "float")


def sha_sums(text: Column, dim: int) -> Column:
    """array<struct<dim, value>>: the sum of signs at each place that a feature of the text falls to, zero or not."""

    def run(texts: pa.Array) -> pa.Array:
        starts, at, sums = [0], [], []
        for t in texts:
            counts = signed_counts((t.as_py() or "").lower(), dim, _sha)
            own = np.flatnonzero(counts.any(axis=1))
            at.append(own)
            sums.append(counts[own, 1] - counts[own, 0])
            starts.append(starts[-1] + len(own))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(at or [np.zeros(0, np.int64)])), pa.array(np.concatenate(sums or [np.zeros(0)]))], ["dim", "value"])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)

    return F.arrow_udf(run, "array<struct<dim: bigint, value: double>>")(text)


def sha_number(feature: Column) -> Column:
    """The first nine hex digits of the feature's SHA-256: eight for its place, the last bit for its sign."""
    return F.conv(F.substring(F.sha2(feature, 256), 1, 9), 16, 10).cast("long")


def sha_bucket(number: Column, dim: int) -> Column:
    return F.pmod(F.shiftright(number, 4), F.lit(dim))


def sha_sign(number: Column) -> Column:
    return F.when(number % 2 == 1, 1.0).otherwise(-1.0)
