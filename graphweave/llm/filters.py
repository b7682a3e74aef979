"""What filters do to a corpus and to each other, in every order.

Five filters look at whole texts: A under 200 words, B too few distinct words,
C too many capitals, D a sign that prose seldom has, E a text that a smaller id
has as well. The first four are decided where a text is read. For E a counting
Bloom filter goes first: every document adds one to CELLS of a range of
counters, both chosen by the digest of its text; the blocks' sketches are merged, a range to a
task, and a document with a counter that stayed at one has a text of its own.
Only the others, the possible repeats, are shuffled with their texts, to find
the smallest id of each. The flags then become counts by mask of failed
filters, at most 32 for a part, and everything that is reported, for all 120
orders, is a sum over these counts.

Texts lie in blocks, in buckets by block, so that the merged sketch comes to
the texts and not the other way round. A block adds up its own counters first
and hands on one row for each repeated text: copies in any number cost a row a block.

Defined cases: a null text is an empty one; a null source is the part '';
words are separated by ASCII white space; a null id is no smaller and no larger
than any other, so such a row never fails E and makes none fail; rows of one id
and text don't repeat each other; several labels of one id: any of them counts;
an empty table gives no rows. Only key, text and source are read. A text's
smallest id comes back to its documents by a digest of 128 bits; the texts
themselves are compared in full.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import save_buckets
from .blocks import BLOCKS_PER_TASK, TASKS, get, get_sorted, mix64, put, put_sorted, squeeze, unsqueeze
from .common import save

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that go on with a character that another began.
CONTINUED = bytes(range(0x80, 0xC0))
#: Of texts in a block, and of documents, since texts may be empty.
BLOCK_BYTES, BLOCK_DOCS = 3 << 20, 1 << 14
#: Counters that a document adds to; counters for each document, about: one in forty unique texts is taken for a
#: possible repeat; counters in a range, a byte each, in one task.
CELLS, CELLS_PER_DOC, RANGE_CELLS = 4, 8, 1 << 22


def failed(text: bytes) -> int:
    """The mask of failed filters among A to D."""
    words = text.split()
    capitals, length = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, CONTINUED))
    return (
        (len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT * len(words))
        + 4 * (100 * capitals > MAX_CAPITALS * length) + 8 * (len(text.translate(None, SIGNS)) < len(text)))


def pack(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(block, keys, parts, masks, digests, texts), saved, in buckets by block."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)) + F.lit(1)), F.lit(0))).first()[0]
    buckets = min(TASKS, max(8, n_bytes // (BLOCK_BYTES * BLOCKS_PER_TASK)))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right"))
                end = min(max(end, at + 1), at + BLOCK_DOCS)
                own = b.slice(at, end - at)
                texts = own.column(2).to_pylist()
                masks = np.fromiter(map(failed, texts), np.uint8, len(texts))
                digests = b"".join(map(xxhash.xxh3_128_digest, texts))
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.concat_arrays([a]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), one(own.column(0)), one(own.column(1)), pa.array([squeeze(masks.tobytes())]), pa.array([digests]), one(own.column(2))], ["block", "keys", "parts", "masks", "digests", "texts"])
                number, at = number + 1, end

    return save_buckets(rows.mapInArrow(run, f"block long, keys array<{kind}>, parts array<string>, masks binary, digests binary, texts array<binary>"), "block", buckets)


def cells_of(digests: bytes, ranges: int, size: int) -> np.ndarray:
    """A row for each document: the counters it adds to, all in one range of the sketch."""
    d = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    first = (((d[:, 0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) * np.uint64(size)
    return np.stack([first + mix64(d[:, 1] + np.uint64(i)) % np.uint64(size) for i in range(CELLS)], axis=1)


def sketch(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's counters that are not zero, and their counts, 2 for any more; a document adds one to a counter."""
    cells = np.sort(cells, axis=1)
    fresh = np.ones(cells.shape, bool)
    fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
    own, counts = np.unique(cells[fresh], return_counts=True)
    return own, np.minimum(counts, 2).astype(np.uint8)


def possible(packed: DataFrame, size: int = RANGE_CELLS) -> DataFrame:
    """(text, key, n, digest) of what may be a repeat, one row for each text of a block: key is its smallest id there, n its documents."""
    n_docs = packed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    ranges = max(1, -(-n_docs * CELLS_PER_DOC // size))

    def send(t: pa.Table) -> pa.Table:
        out = []
        for row in t.to_pylist():
            own, counts = sketch(cells_of(row["digests"], ranges, size))
            of = own // np.uint64(size)
            cuts = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64)).tolist()
            out += [(i, row["block"], put_sorted(own[s:e]), put(counts[s:e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        return pa.Table.from_pydict({c: list(x) for c, x in zip(SENT.names, zip(*out))} if out else {c: [] for c in SENT.names}, SENT)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counters, base = np.zeros(size, np.uint8), np.uint64(int(pdf["range"].iloc[0]) * size)
        own = [get_sorted(x) - base for x in pdf["cells"]]
        for at, n in zip(own, pdf["counts"]):
            counters[at] = np.minimum(counters[at] + get(n, "|u1"), 2)
        return pd.DataFrame({"range": pdf["range"], "block": pdf["block"], "repeats": [squeeze(np.packbits(counters[at] > 1).tobytes()) for at in own]})

    merged = save(packed.select("block", "digests").groupBy("block").applyInArrow(send, "range long, block long, cells binary, counts binary").groupBy("range").applyInPandas(merge, "range long, block long, repeats binary"))
    schema = packed.select(F.lit(b"").alias("text"), F.col("keys")[0].alias("key"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("digest")).schema
    arrow = to_arrow_schema(schema)

    def pick(left: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in arrow.names}
        answers = sorted(got.to_pylist(), key=lambda r: r["range"])
        for row in left.to_pylist():
            cells = cells_of(row["digests"], ranges, size)
            own, _ = sketch(cells)
            of = own // np.uint64(size)
            again = np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(a["repeats"]), np.uint8), count=int((of == a["range"]).sum())) for a in answers])
            stay = (again[np.searchsorted(own, cells)] > 0).all(axis=1)
            found: dict[bytes, list] = {}
            for i in np.flatnonzero(stay).tolist():
                k = row["keys"][i]
                one = found.setdefault(row["texts"][i], [k, 0, row["digests"][16 * i : 16 * i + 16]])
                one[0], one[1] = k if one[0] is None or (k is not None and k < one[0]) else one[0], one[1] + 1
            out["text"] += list(found)
            for c, x in zip(("key", "n", "digest"), zip(*found.values())):
                out[c] += x
        return pa.Table.from_pydict(out, arrow)

    return packed.select("block", "keys", "digests", "texts").groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(pick, schema)


SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", range_cells: int = RANGE_CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the set of filters that they fail."""
    packed = pack(docs, key, text, source)
    first = possible(packed, range_cells).groupBy("text").agg(F.min("key").alias("first_id"), F.sum("n").alias("n"), F.first("digest").alias("digest")).filter("n > 1").select("digest", "first_id")

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                masks = np.frombuffer(unsqueeze(b.column(2)[i].as_py()), np.uint8)
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(masks), [None, pa.py_buffer(b.column(3)[i].as_py())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(masks.astype(np.int32)), digests], ["key", "part", "mask", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    each = packed.select("keys", "parts", "masks", "digests").mapInArrow(flags, f"key {kind}, part string, mask int, digest binary")
    each = each.join(first, "digest", "left").select("key", "part", (F.col("mask") + F.when(F.col("first_id") < F.col("key"), 16).otherwise(0)).alias("mask"))
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).filter("good = 1 OR toxic = 1")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return each.join(marks, "key", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, ...) from the counts of mask_counts()."""
    steps = [
        {"filter_order": "".join(p), "step": i + 1, "bit": 1 << LETTERS.index(f), "before": sum(1 << LETTERS.index(x) for x in p[:i])}
        for p in permutations(LETTERS) for i, f in enumerate(p)]
    step = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")).alias("s")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32
    rows = parts.select("part", "counts", step).select("part", "counts", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(name: str, of) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + of(c)).alias(name)

    def where(test, value: str = "n"):
        return lambda c: F.when(test(c["mask"]), c[value]).otherwise(F.lit(0).cast("long"))

    removed = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    # In 120 / |mask| of the orders a filter comes before all others that the document fails.
    share = lambda c: F.when(c["mask"].bitwiseAND(bit) != 0, c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("kept", where(lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0)), total("removed", where(removed)),
        total("redundant", where(lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0))), total("unique_fails", where(lambda m: m == bit)),
        total("good_lost", where(removed, "good")), total("toxic_lost", where(removed, "toxic")), total("shapley", share))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bs FROM x x1, x x2, x x3, x x4, x x5
  WHERE x1.b | x2.b | x3.b | x4.b | x5.b = 31),
s AS (SELECT filter_order, step::INT AS step, bs[step] AS bit, coalesce(list_sum(bs[1 : step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) t(step))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
