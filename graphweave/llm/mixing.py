"""Mixing sources to target weights: capped water-filling.

Every source has a weight and shares the total size by it; a source whose
share exceeds `max_epochs` times its own size is clamped there, and the excess
goes to the others in proportion to their weights, until none is above. The
targets are then met by whole repetitions of every document and one more,
partial pass in a seeded order, whose last document is taken in part.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, ordered last; equal rows are separate documents; an empty
table gives no rows. Only the key, text and source columns are read, so other
columns may have any name. Nothing depends on the partitioning: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from .common import save, small, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240501
#: Documents that one bucket of the seeded order holds on average, in a table of one source.
ROWS_PER_BUCKET = 5_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, s_size) -> (source, s_size, weight, target). No task sorts all sources; each round of water-filling is one aggregate."""
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = ranked.select("source", "s_size", w.alias("weight"), (F.col("s_size") * max_epochs).cast("double").alias("cap"))
    total, weight = s.agg(F.coalesce(F.sum("s_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = total / weight if weight else 0.0
    while total:
        over = F.col("cap") < F.col("weight") * rate
        capped, free = s.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        new = (total - capped) / free if free else rate
        if new <= rate:
            break
        rate = new
    return s.select("source", "s_size", "weight", F.least(F.col("cap"), F.col("weight") * rate).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target,
    repeats (whole passes), extra (words of the partial pass), taken."""
    slim = save(docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).alias("h"),
    ))
    sizes = save(slim.groupBy("source").agg(F.sum("size").alias("s_size"), F.count(F.lit(1)).alias("n")))
    n_sources, n_docs = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(64, n_docs // ROWS_PER_BUCKET)
    targets = source_targets(sizes.select("source", "s_size"), weights, max_epochs)
    whole = F.when(F.col("s_size") > 0, F.floor(F.col("target") / F.col("s_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("repeats", whole).withColumn("budget", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("repeats") * F.col("s_size")))
    slim = slim.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    heights = slim.groupBy("source", "bucket").agg(F.sum("size").alias("height"))
    below = F.sum("height").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    at = heights.withColumn("below", F.coalesce(below, F.lit(0)))
    at = at.withColumnRenamed("source", "at_source").join(small(plan, n_sources), F.col("at_source").eqNullSafe(F.col("source")))
    cut = at.filter("below < budget and below + height >= budget").select("at_source", F.col("bucket").alias("cut"), "below")
    plan = save(plan.join(small(cut, n_sources), F.col("source").eqNullSafe(F.col("at_source")), "left")
                .select(F.col("source").alias("p_source"), "s_size", "target", "repeats", "budget", F.coalesce("cut", F.lit(-1)).alias("cut"), "below"))
    rows = slim.join(small(plan, n_sources), F.col("source").eqNullSafe(F.col("p_source")))
    # Only the bucket in which the budget ends needs an order among its rows.
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("bucket = cut").withColumn("used", F.coalesce(F.sum("size").over(w), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("below") - F.col("used"))))
    rest = rows.filter("bucket <> cut").withColumn("used", F.lit(0).cast("long")).withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    return rest.unionByName(last).select(
        "doc_id", "source", "size", F.col("s_size").alias("source_size"), "target", "repeats",
        F.col("extra").cast("long").alias("extra"), (F.col("repeats") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )
