"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, save


def _to_roots(hook: DataFrame) -> DataFrame:
    """hook(v, p), p < v -> saved (v, p: the end of v's path, moved). Pointers jump to where theirs lead, two jumps a write, so a
    path of n nodes takes log2(n) / 2 writes."""
    hook = save(hook)
    while True:
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        once = hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        twice = save(once.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        release(hook)
        if twice.filter("moved").isEmpty():
            return twice
        hook = twice


def components(edges: DataFrame, once: bool = False) -> DataFrame:
    """Connected components of edges(u, v) over any ordered type: (node, root),
    root the smallest node that can be reached. Nodes without an edge to
    another node are left out. once: edges are saved, u <= v, and no two are
    alike, so the first round reads them where they are.

    Each round every node is hooked to its smallest neighbour if that is smaller,
    pointers jump to the roots of the trees so made, and trees become nodes.
    Of two neighbours one is no root, so a round at least halves the nodes that
    have edges: there are at most log2(n) rounds whatever the order of the names.
    """
    e = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    e = e if once else save(e.distinct())
    labels = save(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not e.isEmpty():
        jumped = _to_roots(e.groupBy("v").agg(F.min("u").alias("p")))
        hook = jumped.select("v", "p")
        lo = hook.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        old_e, old_labels = e, labels
        e = save(
            e.join(lo, "u", "left").join(hook, "v", "left")
            .select(F.coalesce("pu", "u").alias("a"), F.coalesce("p", "v").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        labels = save(
            labels.join(hook.withColumnRenamed("v", "root"), "root", "left")
            .select("node", F.coalesce("p", "root").alias("root"))
        )
        release(old_e, old_labels, jumped)
    return labels
