"""Evaluation: cases are rows, a run is a join, the summary an aggregate."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.rank import global_rank
from ..sources.lines import numbered_lines
from ..sources.scratch import save
from .indexing import Index
from .modes import MODES, query, source_ids
from .providers import Provider

CASES = "id string, index_id string, query string, modes array<string>, expected_source_ids array<string>, expected_answer_terms array<string>, top_k int, community_level int"
RESULTS = "case_id string, mode string, success boolean, answer string, source_ids array<string>, source_recall double, answer_term_coverage double, latency_ms double, error string, drift_actions long"
TOP_K = 5


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped. A line that is no case (broken, without id or query, with a mode that
    is none or numbers out of bounds) is an error that names it."""
    lines = numbered_lines(spark, path).filter(F.trim("text") != "")
    rows = save(lines.withColumn("c", F.from_json("text", f"{CASES}, broken string", {"columnNameOfCorruptRecord": "broken"})))
    c = lambda name: F.col(f"c.{name}")
    some = lambda name: F.coalesce(c(name) != "", F.lit(False))
    good = F.col("c").isNotNull() & c("broken").isNull() & some("id") & some("query")
    good = good & F.coalesce(F.forall(c("modes"), lambda m: F.coalesce(m.isin(*MODES), F.lit(False))), F.lit(True))
    good = good & F.coalesce(c("top_k").between(1, 50), F.lit(True)) & F.coalesce(c("community_level").between(0, 16), F.lit(True))
    bad = rows.filter(~good).orderBy("file", "line").first()
    if bad is not None:
        raise ValueError(f"line {bad['line']} of {bad['file']} is no evaluation case")
    none = F.array().cast("array<string>")
    return rows.select(
        "c.id", "c.index_id", "c.query", F.coalesce("c.modes", F.array(*map(F.lit, MODES))).alias("modes"), F.coalesce("c.expected_source_ids", none).alias("expected_source_ids"),
        F.coalesce("c.expected_answer_terms", none).alias("expected_answer_terms"), F.coalesce("c.top_k", F.lit(TOP_K)).alias("top_k"), "c.community_level")


def source_recall(expected: Column, actual: Column) -> Column:
    """The share of the expected, distinct and not empty, that is there; 1 if nothing is expected."""
    want = F.array_distinct(F.filter(expected, lambda x: x != ""))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, actual)) / F.size(want)).otherwise(F.lit(1.0))


def answer_term_coverage(terms: Column, answer: Column) -> Column:
    """The share of the terms, stripped, repeats included, that the answer holds in any case."""
    want = F.filter(F.transform(terms, strip), lambda t: t != "")
    found = F.filter(want, lambda t: F.contains(F.lower(answer), F.lower(t)))
    return F.when(F.size(want) > 0, F.size(found) / F.size(want)).otherwise(F.lit(1.0))


def by_mode(results: DataFrame) -> DataFrame:
    """results(mode, success, source_recall, answer_term_coverage, latency_ms, drift_actions) -> one row for each mode."""
    return results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("source_recall").alias("avg_source_recall"),
        F.avg("answer_term_coverage").alias("avg_answer_term_coverage"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("drift_actions").alias("avg_drift_actions"))


def write_report(results: DataFrame, path: str) -> None:
    """The summary of each mode and every case's result, as indented JSON. A set has a few hundred cases."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    kept = save(results)
    report = {"summary": rows(by_mode(kept).orderBy("mode")), "results": rows(kept.orderBy("case_id", "mode"))}
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")


def _options(mode: str, top_k: int | None, level: int | None, provider: Provider | None) -> dict:
    """What a case says about a mode, as the mode takes it."""
    found: dict = {"provider": provider}
    if mode in ("basic", "local", "global"):
        found["top_k"] = top_k or TOP_K
    if mode in ("global", "drift"):
        found["level"] = level
    return found


def _answered(index: Index, cases: DataFrame, mode: str, options: dict) -> DataFrame:
    """(case_id, answer, source_ids, drift_actions), all computed when this returns."""
    got = query(index, cases.select(F.col("id").alias("question_id"), "query"), mode, **options)
    rows = got.answers.join(source_ids(got.details, mode, index.config.shown_items), "question_id", "left")
    if mode == "drift":
        rows = rows.join(got.details["trace"].select("question_id", F.col("actions").cast("long").alias("drift_actions")), "question_id", "left")
    else:
        rows = rows.withColumn("drift_actions", F.lit(None).cast("long"))
    return save(rows.select(F.col("question_id").alias("case_id"), "answer", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "drift_actions"))


def _tried(index: Index, cases: DataFrame, mode: str, options: dict) -> DataFrame:
    """cases(id, query, nth) -> (case_id, answer, source_ids, drift_actions, error, latency_ms) of all of them."""
    began = time.perf_counter()
    lo, hi, n, name = cases.agg(F.min("nth"), F.max("nth"), F.count(F.lit(1)), F.min("id")).first()
    try:
        rows = _answered(index, cases, mode, options).withColumn("error", F.lit(None).cast("string"))
    except Exception as e:
        if n > 1:
            middle = (lo + hi) // 2
            return _tried(index, cases.filter(F.col("nth") <= middle), mode, options).unionByName(_tried(index, cases.filter(F.col("nth") > middle), mode, options))
        rows = cases.sparkSession.createDataFrame([(name, "", [], None, str(e) or type(e).__name__)], "case_id string, answer string, source_ids array<string>, drift_actions long, error string")
    return rows.withColumn("latency_ms", F.lit(1000 * (time.perf_counter() - began) / n))


def run(index: Index, cases: DataFrame, provider: Provider | None = None) -> DataFrame:
    """One row for each case and mode. Cases of one mode, top_k and level are answered together, and each gets its share
    of the time until their answers are there. Where that fails, halves are tried, down to the case that fails alone and
    has its error: of n cases, one that fails costs about 2 log2(n) more runs."""
    spark, out = cases.sparkSession, None
    cases = save(cases)
    asked = cases.select(F.explode("modes").alias("mode"), "top_k", "community_level").distinct().orderBy("mode", "top_k", "community_level").collect()
    for mode, top_k, level in asked:  # settings, not rows
        own = cases.filter(F.array_contains("modes", mode) & F.col("top_k").eqNullSafe(F.lit(top_k)) & F.col("community_level").eqNullSafe(F.lit(level).cast("int")))
        rows = _tried(index, global_rank(own, [F.col("id")], "nth"), mode, _options(mode, top_k, level, provider))
        none = F.array().cast("array<string>")
        answer = F.coalesce("answer", F.lit(""))
        rows = own.join(rows, own["id"] == rows["case_id"], "left").select(
            F.col("id").alias("case_id"), F.lit(mode).alias("mode"), (F.col("error").isNull() & F.col("answer").isNotNull()).alias("success"), answer.alias("answer"), F.coalesce("source_ids", none).alias("source_ids"),
            source_recall(F.coalesce("expected_source_ids", none), F.coalesce("source_ids", none)).alias("source_recall"),
            answer_term_coverage(F.coalesce("expected_answer_terms", none), answer).alias("answer_term_coverage"), "latency_ms", "error", "drift_actions")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], RESULTS)
