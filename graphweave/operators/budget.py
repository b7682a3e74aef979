"""Token budgets over ranked lists.

A list is (list keys.., rank, id, text). Selection is a running sum; it is
taken in two levels, over ranges of ranks and then within a range, so one long
list is no single task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import WORDS, Tokenizer

#: Ranks that one task adds up.
RANGE = 4096


def running_before(rows: DataFrame, by: list[str], rank: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the smaller ranks of the list."""
    r = rows.withColumn("range_", F.floor(F.col(rank) / RANGE))
    sums = r.groupBy(*by, "range_").agg(F.sum(value).alias("sum_"))
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).drop("sum_")
    inner = Window.partitionBy(*by, "range_").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inner_", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return r.join(starts, [*by, "range_"]).withColumn(name, F.col("start_") + F.col("inner_")).drop("range_", "start_", "inner_")


def select_within(rows: DataFrame, budget: Column | int, by: list[str], rank: str = "rank", text: str = "text", tokenizer: Tokenizer = WORDS) -> DataFrame:
    """The first rows of each list whose texts fit into the budget, the last one cut; adds used, the tokens taken of it."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    counted = running_before(rows.withColumn("tokens_", tokenizer.count(F.col(text))), by, rank, "tokens_", "before_")
    fits = counted.filter(F.col("before_") < budget).withColumn("used", F.least(F.col("tokens_"), budget - F.col("before_")))
    cut = F.when(F.col("used") < F.col("tokens_"), tokenizer.truncate(F.col(text), F.col("used"))).otherwise(F.col(text))
    return fits.withColumn(text, cut).drop("tokens_", "before_")


def next_fit(tokens: list[int], budget: int) -> list[int]:
    """The batch of each text; 0 for empty texts, which join none."""
    out, batch, used = [], 1, 0
    for t in tokens:
        cost = min(t, budget)
        if cost and used and used + cost > budget:
            batch, used = batch + 1, 0
        used += cost
        out.append(batch if cost else 0)
    return out


def batches(rows: DataFrame, budget: int, by: list[str], rank: str = "rank", text: str = "text", tokenizer: Tokenizer = WORDS) -> DataFrame:
    """rows with batch: each list packed in order, every text cut to the budget. Where a batch ends depends on all
    before it, so a list goes through one task; lists are the ranked reports of one question, and short."""
    counted = rows.withColumn("tokens", tokenizer.count(F.col(text)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        return pdf.assign(batch=next_fit(pdf["tokens"].tolist(), budget))

    slim = counted.select(*by, rank, "tokens")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    packed = slim.groupBy(*by).applyInPandas(pack, f"{schema}, batch int").filter("batch > 0")
    return rows.join(packed, [*by, rank]).withColumn(text, tokenizer.truncate(F.col(text), budget))
