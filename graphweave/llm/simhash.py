"""SimHash near-dedup by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint of its word shingles. For radius r each
bit i has a code c(i) in {0,1}^(r+1); table v (1 .. 2^(r+1)-1) keeps the bits
whose code has an odd product with v. The codes of at most r differing bits
span at most r dimensions, so some v is orthogonal to all of them: that table
masks every difference out, and the pair collides there. No pair within the
radius is lost. Codes are dealt so that every table keeps about half the bits.

A bucket of more than BUCKET fingerprints is split by the same masks once more,
on bits dealt in another order: a pair of it agrees under some second mask too,
so no link is lost, and Spark deals the parts to several tasks.

Inside a bucket no pairs are emitted: a breadth-first walk over the distances
finds the bucket's components, and a tree of fan-out 8 over each of them is
passed on. Fingerprints are made distinct first, so a bucket holds at most the
distinct fingerprints around one point, however many copies a group has.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; fewer words than a shingle: the whole
sequence is the one shingle; equal rows share fingerprint and component; a
component is named by its smallest key (null keys are passed over, and a
component of null keys alone is null); an empty table gives no rows. Only the
key and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, save, small

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Fingerprints of a bucket that one task compares without a second mask.
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: bit i is set in over half the hashes."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space alone
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    h = xxhash.xxh64_intdigest
    lists = [words[i:] for i in range(shingle)]
    hashes = np.fromiter((h(b" ".join(w), SEED) for w in zip(*lists)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS, bits: int = 64, stride: int = 1) -> list[int]:
    """One mask for each table; together they cover the radius. stride: deals the codes to the bits in another order."""
    size = 1 << (radius + 1)
    # Codes 1 .. 2^(r+1)-1 in turn: every nonzero v is odd with half of them.
    codes = [1 + i * stride % bits % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, t: a hash of the text, fp: the fingerprint's bits as a signed number)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], ["doc_id", "t", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id", "t", F.lit(0).cast("long").alias("fp")).schema)


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Tree edges over the components of distinct fps under the radius."""
    out, rest = [], np.arange(len(fps))
    u = fps.view(np.uint64)
    while len(rest) > 1:
        group, todo, rest = [rest[0]], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(u[rest] ^ u[todo.pop()]) <= radius
            if near.any():
                found = rest[near].tolist()
                group += found
                todo += found
                rest = rest[~near]
        out += [(int(fps[group[(i - 1) // 8]]), int(fps[group[i]])) for i in range(1, len(group))]
    return out


def _keys(family: list[int], t: str, k: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias(t), F.col("fp").bitwiseAND(F.lit(signed(m))).alias(k)) for i, m in enumerate(family)])).alias("x")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fps(fp) distinct -> edges(u, v) whose components are those of the pairs within the radius."""
    first = fps.select("fp", _keys(masks(radius), "t", "k")).select("x.t", "x.k", "fp")
    # A bucket of more than one task's share is found by counting; there can't be many: at most rows / bucket.
    hot = save(first.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("t", "k"))
    some = small(hot, hot.count())
    split = first.join(some, ["t", "k"]).select("t", "k", "fp", _keys(masks(radius, stride=37), "t2", "k2")).select("t", "k", "x.t2", "x.k2", "fp")
    keyed = first.join(some, ["t", "k"], "left_anti").select("t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp").unionByName(split)
    by = ["t", "k", "t2", "k2"]
    sorted_ = keyed.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the open bucket, which may go on in the next batch
        for b in _then_none(batches):
            if b is None:
                cols = kept
                ends = [len(cols[0])] if cols else []
            else:
                new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
                cols = [np.concatenate(x) for x in zip(kept, new)] if kept else new
                if not len(cols[0]):
                    continue
                ends = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1).tolist()
            starts = [0, *ends[:-1]] if ends else []
            edges = [e for s, t in zip(starts, ends) if t - s > 1 for e in bucket_links(cols[4][s:t], radius)]
            if b is not None:
                kept = [x[ends[-1] if ends else 0 :] for x in cols]
            if edges:
                uv = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

    return sorted_.mapInArrow(run, "u long, v long")


def _then_none(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, t, fp, root: the component's name among fingerprints, component_id) for every row of docs."""
    rows = save(fingerprints(docs, key, text, shingle))
    fps = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(named.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "t", "fp", "root", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
