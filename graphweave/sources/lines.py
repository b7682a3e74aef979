"""Lines of text files with their numbers, however many tasks read a file.

A file is read in splits. Rows of a split come in order from one task, so a
line's place in its split is known there; the splits' counts, added up in the
order of their first byte, say how many lines are before. No file is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import save


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line: from 1, text), without line ends; saved."""
    read = spark.read.option("lineSep", "\n").text(path)
    rows = save(read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text")))
    # Ids of a task's rows follow one another, and a split is in one task.
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")
