"""Line dedup: overlapping three-line windows.

A window is three consecutive lines of one document. Where the same three
lines stand at several places of the corpus, the first place (by document key,
then line) stays, and the lines that any later window covers go. A document of
fewer lines has no window and stays as it is.

Defined cases: a null text has no lines and stays null; an empty text is one
empty line; equal rows (same key and text) count as one document and keep the
same lines; different texts under one key are ordered by a hash of the text;
an empty table gives no rows. All columns of the input pass through; the two
counts take the names n_lines and n_removed, replacing columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    keyed = docs.select(F.col(key).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.split(F.col(text), "\n", -1).alias("lines"))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(1), F.size("lines") - (window - 1)))
    at = lambda i: [F.element_at("lines", i + k) for k in range(window)]
    # Two hashes of 64 bits: as many windows as a cluster can hold stay apart.
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit("w"), *at(i)).alias("h2")))
    windows = keyed.select("d", "t", F.explode(each).alias("w")).select("d", "t", "w.pos", "w.h1", "w.h2")
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "pos")).alias("first")).filter("n > 1")
    later = windows.join(first, ["h1", "h2"]).filter(~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
    hit = save(later.groupBy("d", "t").agg(F.collect_set("pos").alias("hits")))
    own = docs.columns
    rest = [c for c in own if c not in (text, "n_lines", "n_removed")]
    out = docs.select(*[F.col(c).alias(f"in_{c}") for c in own])
    # The same plan at every size: both sides are dealt by document, which Spark can split where one is hot.
    out = out.join(hit.hint("merge"), F.col(f"in_{key}").eqNullSafe(F.col("d")) & (F.xxhash64(F.col(f"in_{text}")) == F.col("t")), "left")
    lines = F.split(F.col(f"in_{text}"), "\n", -1)
    covered = F.flatten(F.transform("hits", lambda i: F.sequence(i, i + (window - 1))))
    keep = F.array_except(F.sequence(F.lit(1), F.size(lines)), covered)
    kept = F.when(F.col("hits").isNull(), F.col(f"in_{text}")).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at(lines, i)), "\n"))
    n_lines = F.when(F.col(f"in_{text}").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("hits").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return out.select(*[F.col(f"in_{c}").alias(c) for c in rest], kept.alias(text), n_lines.alias("n_lines"), gone.alias("n_removed")).select(
        *[c for c in own if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM l),
w AS (SELECT doc_id, pos, md5(lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2]) AS h FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l),
k AS (SELECT u.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
  coalesce(string_agg(CASE WHEN c.pos IS NULL THEN u.line END, chr(10) ORDER BY u.pos), '') AS kept
  FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.kept END AS text,
  coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
