"""Places in a global order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save


def _ranged(rows: DataFrame, order: list[Column], size: Column, before: str) -> DataFrame:
    """rows, saved, with before: the sizes of all rows that come first, added up. Parts of a range partitioning are
    added up on their own; the driver sees a number for each part."""
    ranges = rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    w = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = save(ranges.withColumn("size_", size.cast("long")).withColumn("place_", F.coalesce(F.sum("size_").over(w), F.lit(0))))
    start, starts = 0, []
    for part, n in sorted((x["part_"], x["n"]) for x in own.groupBy("part_").agg(F.sum("size_").alias("n")).collect()):
        starts.append((part, start))
        start += n
    offsets = rows.sparkSession.createDataFrame(starts, "part_ int, start_ long")
    return own.join(F.broadcast(offsets), "part_").withColumn(before, F.col("start_") + F.col("place_")).drop("part_", "place_", "start_", "size_")


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows (saved) with name: 0, 1, .. in the order."""
    return _ranged(rows, order, F.lit(1), name)


def percentile(rows: DataFrame, value: str, share: float) -> float | None:
    """The value at a share (0 to 1) of the ordered rows, interpolated between neighbours; None without rows. Equal
    values meet first, and no task sees more than its range of them."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    placed = _ranged(counts, [F.col("x")], F.col("n"), "before")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = share * (total - 1)
    low = int(at)
    ends = placed.filter((F.col("before") <= min(low + 1, total - 1)) & (F.col("before") + F.col("n") > low)).select("x", "before", "n").orderBy("x").collect()
    lo, hi = (next(r["x"] for r in ends if r["before"] <= i < r["before"] + r["n"]) for i in (low, min(low + 1, total - 1)))
    return lo + (hi - lo) * (at - low)
