"""Where lineage is cut: tables in the folder that driver and executors share.

What save() and save_buckets() write lives until release(), until the settle()
around it ends, or at the latest until the driver's JVM ends. Buckets are known
to the catalog by a name, which goes with the files.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many short rows are broadcast by hint; beyond it the join is
#: left to Spark, which shuffles and splits skewed keys.
BROADCAST_ROWS = 50_000
#: The paths written inside the innermost settle().
_inside: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("graphweave_inside", default=None)
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: The catalog's names of what save_buckets() wrote, by path.
_names: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="graphweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphweave/{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    fs, p = _files(spark, path)
    fs.deleteOnExit(p)
    _paths[df] = path
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    if name := _names.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    fs, p = _files(spark, path)
    fs.delete(p, True)


@atexit.register
def _drop_names() -> None:
    """What nobody released, if the session is still there: a catalog may outlive it."""
    spark = SparkSession.getActiveSession()
    for name in _names.values() if spark is not None else ():
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def save(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and
    a lost executor costs no more than the tasks that read these files."""
    spark, path = df.sparkSession, _new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return _kept(spark, spark.read.schema(df.schema).parquet(path), path)


def save_buckets(df: DataFrame, key: str | list[str], buckets: int) -> DataFrame:
    """The same, dealt by key into buckets as it is written: groups and joins by the key don't shuffle it."""
    spark, path = df.sparkSession, _new_path(df.sparkSession)
    name = f"graphweave_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(name)
    _names[path] = name
    return _kept(spark, spark.table(name), path)


def release(*tables: DataFrame) -> None:
    """Delete what was saved under these; whatever still reads it must be done."""
    for df in tables:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, saved; everything that was saved on the way is deleted."""
    inside: list[str] = []
    token = _inside.set(inside)
    try:
        out = save(make())
    finally:
        _inside.reset(token)
    kept = _paths[out]
    for path in inside:
        if path != kept:
            _delete(out.sparkSession, path)
    if (outer := _inside.get()) is not None:
        outer.append(kept)
    return out


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes in fewer than four parts for each of them: a table that small may lie in one row
    group, which one task would read and work on, and a few parts more than cores leave most cores idle at the end.
    Larger inputs stay as they are."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= limit else df
