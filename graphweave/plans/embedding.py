"""Embedders: a name, a dimension, and a column of texts to a column of vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding, sha_embedding


class Embedder(Protocol):
    """name and dimension (and model, if it has one) say with which other vectors its vectors can be compared."""

    name: str
    dimension: int

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Feature hashing: deterministic, no model, no network."""

    dimension: int = 256
    name: str = "hash"

    def embed(self, text: Column) -> Column:
        return hash_embedding(text, self.dimension)


@dataclass(frozen=True)
class ShaEmbedder:
    """The same idea with SHA-256, in double precision."""

    dimension: int = 256
    name: str = "sha"

    def embed(self, text: Column) -> Column:
        return sha_embedding(text, self.dimension)


@dataclass(frozen=True)
class BatchEmbedder:
    """Any function of a list of texts to vectors, called in batches from within tasks and tried again on errors."""

    call: Callable[[list[str]], list[list[float]]]
    dimension: int
    name: str = "batch"
    model: str = ""
    batch: int = 64
    retries: int = 3
    wait: float = 0.5

    def embed(self, text: Column) -> Column:
        import time

        def one(texts: list[str]) -> list[list[float]]:
            for turn in range(self.retries + 1):
                try:
                    return self.call(texts)
                except Exception:
                    if turn == self.retries:
                        raise
                    time.sleep(self.wait * 2**turn)
            raise AssertionError

        def run(s: pd.Series) -> pd.Series:
            texts = s.fillna("").tolist()
            out = [v for i in range(0, len(texts), self.batch) for v in one(texts[i : i + self.batch])]
            return pd.Series([np.asarray(v, np.float32) for v in out], dtype=object)

        return F.pandas_udf(run, "array<float>").asNondeterministic()(text)


def make_embedder(name: str, dimension: int, call: Callable | None = None) -> Embedder:
    if name in ("hash", "sha"):
        return HashEmbedder(dimension) if name == "hash" else ShaEmbedder(dimension)
    if name == "batch" and call is not None:
        return BatchEmbedder(call, dimension)
    raise ValueError(f"unknown embedding provider: {name}")
