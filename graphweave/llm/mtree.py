"""Exact top-k search by inner product: an M-tree, best first.

Vectors are floor(256 * x) and so integers; the metric is the Euclidean
distance, and the inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2. A node is
a page: a pivot, its covering radius, the largest norm below it, and for every
entry the distance to the pivot. A query takes pages from a heap by the best
score that the radius allows; with d(q, pivot) known, the triangle inequality
on the stored distances rules entries out before anything is computed for
them. Ties go to the smaller id, so only entries that are strictly worse than
the k-th are skipped.

Spark deals the vectors evenly, by hash, into trees of about TREE_ROWS. Trees
lie in groves and queries in blocks; a grove meets a block in a task of its own,
which hands a query's k best on from tree to tree, and only these leave it.
Groves are looked into in rounds, each of as many as all before it: a round
starts from the k-th scores that are known, so a query gets some k rows a round
from all groves together, and not k from each. Groves and blocks grow with the
table up to fixed bounds, so that a small one still has work for all cores and
a large one copies a tree and a query seldom.

Defined cases: a null vector, or one with a null, NaN or infinite component,
and a row without an id take no part; vectors of another length than the
query's are not its candidates; rows of one id are separate rows, and such a
row may find the other; fewer than k candidates: all of them; an empty table
gives no rows. Bounds are in double precision, with a slack far beyond their
error; scores are products of whole numbers at every size, of 64 bits or, where
these might not fit, of any length. A score among the k best that is no long
is an error, since the result could not hold it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release
from .common import save, small

SCALE = 256
K = 5
PAGE = 256
TREE_ROWS = 8192
#: Queries of a block: at least and at most, about 0.5 and 8 MB at 64 dimensions.
QUERY_ROWS, MOST_QUERY_ROWS = 1024, 16384
#: Trees of a grove at most, about 64 MB at 64 dimensions; there are FIRST_GROVES before groves get larger than a tree,
#: and so many are looked into in the first round.
GROVE_TREES, FIRST_GROVES = 16, 64
#: Relative to the squared lengths: far above the error of a bound, a sum of some thousand rounded terms, below 1e-11.
SLACK = 1e-9


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=1))


class Page:
    """rows (leaf) or children (inner), with distances to the pivot."""

    __slots__ = ("children", "far", "norm", "parent", "pivot", "pivots", "radius", "rows", "to_pivot")

    def __init__(self, x: np.ndarray, rows: np.ndarray, norms: np.ndarray, page: int):
        centre = x[rows].mean(axis=0)
        self.pivot = x[rows[np.argmin(_distances(x[rows], centre))]]
        self.to_pivot = _distances(x[rows], self.pivot)
        self.radius, self.norm = float(self.to_pivot.max()), float(norms[rows].max())
        self.rows, self.children = rows, None
        if len(rows) <= page:
            return
        # Up to a page of children around spread-out rows; equal vectors are cut evenly.
        fan = min(page, -(-len(rows) // page) * 2)
        picked, near = [int(np.argmax(self.to_pivot))], np.full(len(rows), np.inf)
        own = np.zeros(len(rows), np.int64)
        for i in range(fan):
            d = _distances(x[rows], x[rows[picked[-1]]])
            own[d < near] = i
            near = np.minimum(near, d)
            picked.append(int(np.argmax(near)))
            if near.max() == 0:
                break
        groups = [rows[own == i] for i in np.unique(own)]
        if len(groups) == 1 or max(map(len, groups)) > 0.9 * len(rows):
            groups = [g for g in np.array_split(rows[np.argsort(near, kind="stable")], fan) if len(g)]
        self.children = [Page(x, g, norms, page) for g in groups]
        self.pivots = np.stack([c.pivot for c in self.children])
        self.to_pivot = _distances(self.pivots, self.pivot)
        self.far = np.array([c.radius for c in self.children])
        self.norm = max(c.norm for c in self.children)
        self.rows = None


def search(root: Page, x: np.ndarray, ids: np.ndarray, uids: np.ndarray, norms: np.ndarray, q: np.ndarray, q_uid: int, k: int, work: list[int], exact: np.ndarray | None = None, known: Iterable[tuple[int, int, int]] = (), floor: float = -np.inf) -> list[tuple[int, int, int]]:
    """The k best (score, id, uid) under the root and among the known ones, without the query's own row and without
    scores below the floor. exact: x in whole numbers, of any length."""
    exact = x.astype(np.int64) if exact is None else exact
    qq, q_exact = float(q @ q), whole(q, exact.dtype == object)
    slack = SLACK * (qq + root.norm) + 1e-6
    best = [(s, -i, -u) for s, i, u in known]  # a heap of (score, -id, -uid)
    heapq.heapify(best)
    kth = max(floor, best[0][0]) if len(best) == k else floor
    d0 = float(np.sqrt(((q - root.pivot) ** 2).sum()))
    bound = lambda d, norm: (qq + norm - np.maximum(d, 0) ** 2) / 2 + slack
    heap = [(-float(bound(d0 - root.radius, root.norm)), 0, d0, root)]
    made = 0
    while heap:
        top, _, d, page = heapq.heappop(heap)
        if -top < kth:
            break
        if page.children is None:
            rows = page.rows
            if kth > -np.inf:  # stored distances alone
                rows = rows[bound(np.abs(d - page.to_pivot), norms[rows]) >= kth]
            if not len(rows):
                continue
            work[0] += len(rows)
            rows = rows[x[rows] @ q >= kth - slack]
            for r, s in zip(rows.tolist(), (exact[rows] @ q_exact).tolist()):
                if uids[r] == q_uid or s < kth:
                    continue
                item = (s, -int(ids[r]), -int(uids[r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(floor, best[0][0])
            continue
        norm = np.array([c.norm for c in page.children])
        near = np.flatnonzero(bound(np.abs(d - page.to_pivot) - page.far, norm) >= kth) if kth > -np.inf else np.arange(len(page.children))
        if not len(near):
            continue
        work[0] += len(near)
        dist = _distances(page.pivots[near], q)
        ub = bound(dist - page.far[near], norm[near])
        for i, j in enumerate(near.tolist()):
            if ub[i] >= kth:
                made += 1
                heapq.heappush(heap, (-float(ub[i]), made, float(dist[i]), page.children[j]))
    return [(s, -i, -u) for s, i, u in sorted(best, reverse=True)]


def whole(x: np.ndarray, any_length: bool) -> np.ndarray:
    """x, which holds whole numbers, as 64-bit integers or as Python's."""
    return np.vectorize(int, otypes=[object])(x) if any_length else x.astype(np.int64)


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS, first_groves: int = FIRST_GROVES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query holds for, its k best other rows."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = save(rows.select(F.col(key).cast("long").alias("id"), is_query.alias("q"), ints.alias("v"), F.monotonically_increasing_id().alias("uid")))
    # One row for each length of vector: how many trees, groves and blocks of queries it has.
    parts = lambda n, per: F.greatest(F.lit(1), F.ceil(n / per)).cast("long")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(parts(F.count(F.lit(1)), tree_rows).alias("trees"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)).alias("asked"))
    sizes = sizes.withColumn("per_grove", F.least(F.lit(GROVE_TREES), parts(F.col("trees"), first_groves)))
    per_block = F.least(F.lit(MOST_QUERY_ROWS), F.greatest(F.lit(query_rows), parts(F.col("asked"), first_groves)))
    sizes = save(sizes.select("dim", "trees", "per_grove", parts(F.col("trees"), F.col("per_grove")).alias("groves"), parts(F.col("asked"), per_block).alias("blocks")))
    n_sizes, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("groves"), F.lit(0))).first()
    rows = rows.withColumn("dim", F.size("v")).join(small(sizes, n_sizes), "dim")
    keyed = rows.select("id", "uid", "v", "dim", "per_grove", F.pmod(F.xxhash64("uid"), "trees").alias("tree"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
        norms = (x**2).sum(axis=1)
        data = pickle.dumps((Page(x, np.arange(len(x)), norms, PAGE), x, pdf["id"].to_numpy(), pdf["uid"].to_numpy(), norms))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "grove": pdf["tree"].iloc[:1] // pdf["per_grove"].iloc[:1], "data": [data]})

    trees = save(keyed.groupBy("dim", "tree").applyInPandas(build, "dim int, grove long, data binary"))
    trees_blocks = trees.join(small(sizes.select("dim", "blocks"), n_sizes), "dim")
    asked = save(rows.filter("q").select("id", "uid", "v", "dim", F.pmod(F.xxhash64("uid"), "blocks").alias("block"), "groves"))

    def look(grove: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(queries))]
        floors = [float("-inf") if f is None else int(f) for f in queries["floor"]]
        qs = np.array(queries["v"].tolist(), np.float64).reshape(len(queries), -1)
        for data in grove["data"] if len(queries) else ():
            root, x, ids, uids, norms = pickle.loads(data)
            exact = whole(x, np.abs(x).max(initial=0) * np.abs(qs).max(initial=0) * max(1, x.shape[1]) >= 2.0**62)
            for n, (q, quid) in enumerate(zip(qs, queries["uid"])):
                best[n] = search(root, x, ids, uids, norms, q, quid, k, [0], exact, best[n], floors[n])
        out = [(qid, quid, i, u, s) for qid, quid, b in zip(queries["id"], queries["uid"], best) for s, i, u in b]
        if any(not -(2**63) <= s < 2**63 for *_, s in out):
            raise OverflowError("a score among the best does not fit 64 bits")
        return pd.DataFrame(out, columns=["query_id", "query_uid", "vec_id", "uid", "score"]).astype("int64")

    by = ["dim", "grove", "block"]
    ranks = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    best, lo, hi = None, 0, first_groves
    while best is None or lo < most:
        own = trees_blocks.filter(F.col("grove").between(lo, hi - 1)) if lo or hi < most else trees_blocks
        left = own.select("dim", "grove", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        # Text, since no column of pandas holds both whole numbers and nulls.
        floor = F.lit(None).cast("string")
        right = asked.filter(F.col("groves") > lo)
        if best is not None:
            floors = best.filter(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").cast("string").alias("floor"))
            right, floor = right.join(floors, "uid", "left"), F.col("floor")
        right = right.select("dim", "block", "id", "uid", "v", floor.alias("floor"), F.explode(F.sequence(F.lit(lo).cast("long"), F.least(F.lit(hi), F.col("groves")) - 1)).alias("grove"))
        got = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(look, "query_id long, query_uid long, vec_id long, uid long, score long")
        if best is not None:
            got = got.unionByName(best.drop("rank"))
        before, best = best, got.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
        lo, hi = hi, 2 * hi
        if lo < most:
            best = save(best)
        if before is not None and lo < most:
            release(before)
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
