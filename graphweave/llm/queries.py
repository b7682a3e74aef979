"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filters, html, linededup, lm, mixing, mtree, quality, simhash, substring, suffix, whitening
from ..sources.scratch import settle
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settle(lambda: simhash.near_duplicates(table(spark, sf_dir, "documents")))
    return out.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: substring.repeated(table(spark, sf_dir, "documents")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: lm.score(table(spark, sf_dir, "documents")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settle(lambda: decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode("item_ids", "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("loss_spans", F.array_join(F.transform("loss_spans", span), ","))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(settle(lambda: filters.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: suffix.removed(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_substring_dedup, op4_lm_scoring, op5_html_extraction, op6_exact_top_k, op7_decontamination, op8_source_mix, op9_quality, op10_chat_rotation, op11_filter_audit, op12_whitening, op13_suffix_dedup)}
ORACLE = {"op1_line_dedup": linededup.ORACLE_SQL, "op3_substring_dedup": substring.ORACLE_SQL, "op6_exact_top_k": mtree.ORACLE_SQL, "op7_decontamination": decontam.ORACLE_SQL, "op10_chat_rotation": chat.ORACLE_SQL, "op11_filter_audit": filters.ORACLE_SQL, "op13_suffix_dedup": suffix.ORACLE_SQL}
