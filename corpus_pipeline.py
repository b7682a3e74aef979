"""The corpus pipeline: documents of low quality go, repeated lines go, one
document of each near-duplicate group stays, documents that hold a benchmark
passage go, and what is left is mixed to the sources' target weights.

Every stage reads the Parquet output of the one before and works on all of it.
All stages but the last return the columns of documents, extra ones too, under
whatever names: the columns that a stage adds for itself live apart from these.

Cases that hold for every stage: a null text counts as an empty one and stays
null where its row stays; a null doc_id is a document of its own, told from
others by its text; equal rows are judged alike; an empty table gives an empty
table with the same columns; without labels, or without benchmark items, the
stages that read them drop nothing or judge all documents alike (a score of 0.5
is rejected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import decontam, linededup, mixing, quality, simhash
from graphweave.llm.common import table
from graphweave.sources.scratch import release, settle


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that the documents of this stage have."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a later window of three covers go, and documents of which nothing is left; n_chars, if there is one,
    follows the text."""
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    out = linededup.dedup_lines(docs.select(F.col("doc_id").alias("own_id"), "text", row.alias("row")), "own_id")
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    follows = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[follows.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _apart(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, own_id, own_t: a hash of the text): names of the input can't clash with a stage's."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_t"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group: of several texts under that id one, of equal rows one. A row
    without an id goes if its group has one with an id, and else stays once for each text. Empty and null texts are one
    group, as they have one fingerprint."""
    groups = simhash.near_duplicates(docs)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("k", F.coalesce(F.col("doc_id"), F.col("t")))
    stay = stay.groupBy("k", "doc_id", "root").agg(F.min("t").alias("stay_t")).select("k", F.col("doc_id").alias("stay_id"), "stay_t").distinct()
    own = _apart(docs).withColumn("own_k", F.coalesce("own_id", "own_t"))
    same = (F.col("own_k") == F.col("k")) & (F.col("own_t") == F.col("stay_t")) & F.col("own_id").eqNullSafe(F.col("stay_id"))
    # One row for each key and text, the same one at every run: columns of any type can be written as JSON, not all compared.
    place = F.sha2(F.to_json("row"), 256)
    return own.join(stay.hint("merge"), same).groupBy("own_k", "own_t").agg(F.min_by("row", place).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; one without words stays."""
    hits = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t")).distinct()
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_t") == F.col("hit_t"))
    return _apart(docs).join(hits.hint("merge"), same, "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, repeats, extra, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate), ("source mixing", source_mix),
]
#: SimHash groups and trained trees are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(docs)
        docs = done
    return docs
