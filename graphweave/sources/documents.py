"""Document sources and their guards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import is_blank
from ..operators.rank import global_rank

#: Fixed value: what an index may be called.
INDEX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


class TooLarge(ValueError):
    """More documents or characters than the settings allow."""


def check_index_id(index_id: str) -> str:
    if not INDEX_ID.fullmatch(index_id):
        raise ValueError(f"not an index id: {index_id!r}")
    return index_id


def read_documents(spark: SparkSession, path: str, format: str = "parquet", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Any source Spark reads, as (doc_id, text, ..)."""
    return spark.read.format(format).load(path).withColumnsRenamed({key: "doc_id", text: "text"})


def documents_from(spark: SparkSession, index_id: str, texts: list[str]) -> DataFrame:
    """A request's own list of texts; its position is a text's identity."""
    return spark.createDataFrame([(f"{index_id}_doc_{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def with_ids(docs: DataFrame, index_id: str) -> DataFrame:
    """docs with doc_id: as they have it, or else {index_id}_doc_{place in the order of the texts}. A table has no order of
    its own; equal texts have places one after the other, and the same table has the same ids every time."""
    if "doc_id" in docs.columns:
        return docs
    placed = global_rank(docs, [F.col("text").asc_nulls_first()], "nth_id_")
    return placed.select(F.concat(F.lit(f"{index_id}_doc_"), F.col("nth_id_").cast("string")).alias("doc_id"), *docs.columns)


def caps(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row: docs, chars, over_cap."""
    n = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
    over = F.lit(False)
    if config.max_documents is not None:
        over = over | (F.col("docs") > config.max_documents)
    if config.max_characters is not None:
        over = over | (F.col("chars") > config.max_characters)
    return n.withColumn("over_cap", over)


def without_blanks(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_blank(F.col(text)))


def guard(docs: DataFrame, config: EngineConfig) -> DataFrame:
    """docs, if they are within the caps and none is blank."""
    if caps(docs, config).first()["over_cap"]:
        raise TooLarge("too many documents or characters for one index")
    if not docs.filter(is_blank(F.col("text"))).isEmpty():
        raise ValueError("blank documents cannot be indexed")
    return docs
