"""Vector retrieval for a set of questions at once.

Questions go to the tasks in blocks of bounded rows and bytes. Each task ranks
its own vectors: it works in tiles of bounded size, carries the k best of every
question from batch to batch, and only these leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import dot, doubles, norm
from ..sources.scratch import BROADCAST_ROWS, save
from .rank import global_rank


DIGITS = 9
#: Bytes of the questions of a block, and of the scores that a task has at a time.
QUESTION_BYTES, TILE_BYTES = 32 << 20, 16 << 20


def with_norm(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    return vectors.withColumn("norm", norm(F.col(vector)))


def question_blocks(questions: DataFrame) -> list[DataFrame]:
    """questions in saved parts of at most BROADCAST_ROWS rows and QUESTION_BYTES of vectors each, or of one row."""
    own = save(questions)
    n, longest = own.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("question")), F.lit(0))).first()
    rows = max(1, min(BROADCAST_ROWS, QUESTION_BYTES // (8 * max(1, longest))))
    if n <= rows:
        return [own]
    placed = save(global_rank(own, [F.xxhash64("question_id"), F.col("question_id")], "nth_"))
    return [placed.filter(F.floor(F.col("nth_") / rows) == i).drop("nth_") for i in range(-(-n // rows))]


def score(vectors: DataFrame, questions: DataFrame, vector: str = "vector") -> DataFrame:
    """Every vector of vectors(.., vector) with every question(question_id, question): adds score, the cosine."""
    parts = question_blocks(questions)
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [score(vectors, p, vector) for p in parts])
    q = F.broadcast(with_norm(questions, "question").withColumnRenamed("norm", "q_norm"))
    both = with_norm(vectors, vector).join(q)
    size = F.col("norm") * F.col("q_norm")
    return both.withColumn("score", F.when(size > 0, dot(F.col(vector), F.col("question")) / size).otherwise(0.0)).drop("norm", "q_norm", "question", vector)


def rank_top(scored: DataFrame, k: Column | int, *ties: Column | str, by: tuple[str, ...] = ("question_id",), digits: int | None = None) -> DataFrame:
    """scored with rank, 1 .. k in each list: best score first, then by ties."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy(*by).orderBy(F.desc(s), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_pairs(pairs: DataFrame, vectors: DataFrame, questions: DataFrame, name: str = "key", vector: str = "vector") -> DataFrame:
    """pairs(question_id, key) with score, rounded to DIGITS digits. A vector goes to its task once for all questions of a
    block that ask for it, and is multiplied with their matrix there."""
    parts = question_blocks(questions.select("question_id", "question"))
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [score_pairs(pairs.join(p.select("question_id"), "question_id", "left_semi"), vectors, p, name, vector) for p in parts])
    rows = parts[0].select("question_id", doubles(F.col("question")).alias("question")).collect()  # one block
    spark, id_type = pairs.sparkSession, questions.schema["question_id"].dataType
    q = np.array([r["question"] for r in rows], np.float64).reshape(len(rows), -1)
    size = np.linalg.norm(q, axis=1)
    told = spark.sparkContext.broadcast((q, size))
    nth = spark.createDataFrame([(r["question_id"], i) for i, r in enumerate(rows)], StructType([StructField("question_id", id_type), StructField("nth", IntegerType())]))
    own = pairs.select("question_id", name).join(F.broadcast(nth), "question_id").groupBy(name).agg(F.collect_list("nth").alias("nths"))
    both = own.join(vectors.select(name, doubles(F.col(vector)).alias("v")), name).filter("v is not null").select(name, "nths", "v")
    kind = to_arrow_type(vectors.schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_size = told.value
        tile = max(1, TILE_BYTES // (8 * max(1, len(q))))
        for b in batches:
            for start in range(0, b.num_rows, tile):
                t = b.slice(start, tile)
                x = t.column(2).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                col = t.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column(1)).to_numpy())
                both_ = np.linalg.norm(x, axis=1)[row] * q_size[col]
                s = np.divide((x @ q.T)[row, col], both_, out=np.zeros(len(row)), where=both_ > 0)
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(row)).cast(kind), pa.array(col), pa.array(np.rint(s * 10**DIGITS) / 10**DIGITS)], [name, "nth", "score"])

    schema = StructType([vectors.schema[name], StructField("nth", IntegerType()), StructField("score", DoubleType())])
    return both.mapInArrow(run, schema).join(F.broadcast(nth), "nth").select("question_id", name, "score")


class Best:
    """The k best of each question so far: by score, then by key. Scores are whole numbers of the last digit kept."""

    def __init__(self, unit: np.ndarray, k: int):
        self.unit, self.k = unit, k
        self.least = np.full(len(unit), np.iinfo(np.int64).min)  # a question's k-th score, once it has k
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, keys: pa.Array, x: np.ndarray) -> None:
        order = pc.sort_indices(keys)
        keys, x = keys.take(order), x[order.to_numpy()]
        size, n, k = np.linalg.norm(x, axis=1), len(x), min(self.k, len(x))
        bits = n.bit_length()
        earlier = (1 << bits) - 1 - np.arange(n)  # of equal scores the smaller key is greater
        tile = max(1, TILE_BYTES // (8 * n))
        for t in range(0, len(self.unit), tile):
            s = np.divide(self.unit[t : t + tile] @ x.T, size, out=np.zeros((len(self.unit[t : t + tile]), n)), where=size > 0)
            s = (np.rint(s * 10**DIGITS).astype(np.int64) << bits) | earlier
            j = np.argpartition(s, n - k, axis=1)[:, n - k :]
            score_ = np.take_along_axis(s, j, axis=1) >> bits
            row, col = np.nonzero(score_ >= self.least[t : t + tile, None])
            self.found.append((row + t, score_[row, col], keys.take(pa.array(j[row, col]))))
            self.n += len(row)
            if self.n > max(1 << 16, 2 * len(self.unit) * self.k):
                self.settle()

    def settle(self) -> None:
        if not self.found:
            return
        t = pa.table({"q": np.concatenate([f[0] for f in self.found]), "s": np.concatenate([f[1] for f in self.found]), "key": pa.chunked_array([f[2] for f in self.found])})
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("s", "descending"), ("key", "ascending")]))
        q = t["q"].to_numpy()
        head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        t = t.filter(pa.array(place < self.k))
        q, s = t["q"].to_numpy(), t["s"].to_numpy()
        last = place[place < self.k] == self.k - 1
        self.least[q[last]] = s[last]
        self.found, self.n = [(q, s, t["key"].combine_chunks())], len(q)

    def slices(self, rows: int = 1 << 14) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        self.settle()
        for q, s, key in self.found:
            key = pa.concat_arrays(key.chunks) if isinstance(key, pa.ChunkedArray) else key
            for at in range(0, len(q), rows):
                yield q[at : at + rows], key.slice(at, rows), s[at : at + rows] / 10**DIGITS


def rank_named(vectors: DataFrame, questions: DataFrame, k: int, name: str = "key", vector: str = "vector") -> DataFrame:
    """(question_id, rank, key, score): score descending, name ascending. Scores are rounded to DIGITS digits, so that
    equal vectors tie wherever they are computed.

    A task multiplies its batches of vectors with the matrix of the questions, tile by tile, and carries the k best of
    each question along, so what it holds and what is shuffled depends neither on the vectors' number nor on their
    dimension, and ties cost nothing. Questions go in blocks, each against all vectors.
    """
    parts = question_blocks(questions)
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [rank_named(vectors, p, k, name, vector) for p in parts])
    rows = questions.select("question_id", doubles(F.col("question")).alias("question")).collect()  # one block
    fields = [questions.schema["question_id"], vectors.schema[name], StructField("score", DoubleType())]
    schema = StructType([StructField("question_id", fields[0].dataType), StructField("key", fields[1].dataType), fields[2]])
    if not rows:
        return vectors.sparkSession.createDataFrame([], StructType([*schema.fields[:1], StructField("rank", IntegerType()), *schema.fields[1:]]))
    ids = [r["question_id"] for r in rows]
    q = np.array([r["question"] for r in rows], np.float64).reshape(len(rows), -1)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    unit = np.divide(q, size, out=np.zeros_like(q), where=size > 0)

    told = vectors.sparkSession.sparkContext.broadcast(unit)
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(told.value, k)
        for b in batches:
            # Nulls go here: a filter before would have Spark make the vectors twice where they are a function of a text.
            b = b.filter(b.column(1).is_valid())
            if b.num_rows:
                best.add(b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
        for q, key, score_ in best.slices():
            yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n in q], kind), key, pa.array(score_)], ["question_id", "key", "score"])

    best = vectors.select(F.col(name).alias("key"), doubles(F.col(vector)).alias("v")).mapInArrow(run, schema)
    return rank_top(best, k, "key").select("question_id", "rank", "key", "score").withColumnRenamed("key", name)
