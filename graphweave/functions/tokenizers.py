"""Tokenizers: how many tokens a text has, and its first n. Budgets, modes and
indexes take any; words and signs, counted in the JVM, are the default.

A byte-pair tokenizer is made from a file of ranks (a line for each token: the
token in base 64 and its rank), which is read by Spark, wherever it lies, and
travels with the function: some MB at most, and the number of its lines is
checked. Merging itself is left to the public tiktoken library, inside tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import token_count, truncate_tokens

#: Fixed value: how byte-level vocabularies cut a text before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_RANKS = 1_000_000


class Tokenizer(Protocol):
    name: str

    def count(self, text: Column) -> Column: ...

    def truncate(self, text: Column, n: Column | int) -> Column: ...


@dataclass(frozen=True)
class WordTokenizer:
    """Words and single signs, each with the white space before it."""

    name: str = "words"

    def count(self, text: Column) -> Column:
        return token_count(text)

    def truncate(self, text: Column, n: Column | int) -> Column:
        return truncate_tokens(text, n)


WORDS = WordTokenizer()


@dataclass(frozen=True)
class BytePairTokenizer:
    """Pairs of the lowest rank are merged first. A cut within a character leaves a replacement sign, as decoders do."""

    ranks: Mapping[bytes, int] = field(repr=False)
    name: str = "byte pairs"
    pattern: str = PATTERN

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, name: str = "byte pairs", pattern: str = PATTERN) -> BytePairTokenizer:
        lines = spark.read.text(path).filter("trim(value) <> ''").limit(MOST_RANKS + 1).collect()
        if len(lines) > MOST_RANKS:
            raise ValueError(f"over {MOST_RANKS} ranks are no vocabulary")
        parts = (x["value"].split() for x in lines)
        return cls({base64.b64decode(token): int(rank) for token, rank in parts}, name, pattern)

    def __post_init__(self) -> None:
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"every single byte needs a rank; {len(missing)} have none")

    def __getstate__(self) -> dict:
        return {"ranks": dict(self.ranks), "name": self.name, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=dict(self.ranks), special_tokens={})

    def tokens(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def first(self, text: str, n: int) -> str:
        own = self.tokens(text) if n > 0 else []
        return text if 0 < len(own) <= n else self.encoding.decode(own[: max(0, n)])

    def count(self, text: Column) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([len(self.tokens(x)) if x else 0 for x in s], dtype="int64")

        return F.pandas_udf(run, "long")(text)

    def truncate(self, text: Column, n: Column | int) -> Column:
        def run(s: pd.Series, most: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else self.first(x, int(k)) for x, k in zip(s, most)], dtype=object)

        return F.pandas_udf(run, "string")(text, F.lit(n) if isinstance(n, int) else n)


def tokenizer_for(model: str, known: Mapping[str, Tokenizer], fallback: Tokenizer = WORDS) -> Tokenizer:
    """The tokenizer of a model: under its name, or under the longest known beginning of it; else the fallback."""
    own = [name for name in known if model == name or model.startswith(name)]
    return known[max(own, key=len)] if own else fallback
