"""Blocks of texts, and counts of hashes exchanged between them.

tokenise() turns the rows of a table into blocks of a few MB, each one row: the
keys, the block's distinct words as hashes, and every token as an index into
them. Later passes read these and never a text again. A pass hands numpy arrays
of 64-bit hashes, sorted and distinct within the block, to parcels(); totals()
adds them up over the corpus, a range of hashes to a task, and answers every
block in the order in which it asked. A block has at most one entry for each
hash, so a hash that fills the corpus costs one entry a block: there are no hot
keys. Counts have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import save_buckets
from .common import save

#: Bytes of text in a block; a longer text is a block of its own. Blocks in one
#: task of a later pass, about, and the tasks at most: beyond, they get more.
BLOCK_BYTES = 3 << 20
BLOCKS_PER_TASK, TASKS = 4, 50_000
#: Hashes that one task adds up, about.
RANGE_ENTRIES = 1 << 20
#: Stands for the end of a text among its words; no word is empty.
END = b""


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put(a: np.ndarray) -> bytes:
    """Whole numbers: their bytes by place, compressed; places that are all zero cost nothing."""
    kind = a.dtype.newbyteorder("<")
    return squeeze(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes())


def get(data: bytes, kind: str) -> np.ndarray:
    kind_ = np.dtype(kind)
    d = np.frombuffer(unsqueeze(data), np.uint8).reshape(kind_.itemsize, -1)
    return np.ascontiguousarray(d.T).reshape(-1).view(kind_)


def put_sorted(a: np.ndarray) -> bytes:
    return put(np.diff(a, prepend=np.uint64(0)))


def get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(get(data, "<u8"), dtype=np.uint64)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", flag: Column | None = None, lower: bool = False, end: bool = False, spell: bool = False) -> DataFrame:
    """(block, n_tokens, keys, flags, lengths, words, tokens, spelling), saved, in buckets by block: later passes bring
    answers to the blocks and don't shuffle these. words: the sorted hashes of the distinct words;
    tokens: for each token its place among them. Words are what stands between ASCII white space; end: every text has
    one more token, its end; flag: a boolean column that travels with the keys; spell: the words themselves go
    along."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    buckets = min(TASKS, max(8, n_bytes // (BLOCK_BYTES * BLOCKS_PER_TASK)))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        flags: list[pa.Array] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            places: dict[bytes, int] = {}
            lengths = np.zeros(len(texts), np.uint32)
            tokens: list[int] = []
            for i, t in enumerate(texts):
                own = (t.lower() if lower else t).split()
                if end:
                    own.append(END)
                lengths[i] = len(own)
                tokens += [places.setdefault(w, len(places)) for w in own]
            h = hashed(list(places))
            order = np.argsort(h)
            place = np.empty(len(h), np.uint32)
            place[order] = np.arange(len(h), dtype=np.uint32)
            n = len(tokens)
            at = place[np.fromiter(tokens, np.int64, n)] if n else np.zeros(0, np.uint32)
            words = list(places)
            spelling = pa.array([squeeze(b"\n".join(words[i] for i in order)) if spell else None], pa.binary())
            one = lambda parts: pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([n]), one(keys), one(flags), pa.array([put(lengths)]), pa.array([put_sorted(h[order])]), pa.array([put(at)]), spelling],
                ["block", "n_tokens", "keys", "flags", "lengths", "words", "tokens", "spelling"])

        for b in batches:
            since = 0
            for i, t in enumerate(b.column(2)):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    keys.append(b.column(0)[since : i + 1])
                    flags.append(b.column(1)[since : i + 1])
                    yield flush()
                    keys, flags, texts, size, seq, since = [], [], [], 0, seq + 1, i + 1
            if since < b.num_rows:
                keys.append(b.column(0)[since:])
                flags.append(b.column(1)[since:])
        if texts:
            yield flush()

    schema = f"block long, n_tokens long, keys array<{kind}>, flags array<boolean>, lengths binary, words binary, tokens binary, spelling binary"
    return save_buckets(rows.mapInArrow(run, schema), "block", buckets)


class Tokens:
    """One block, unpacked: the tokens of its texts in one row."""

    def __init__(self, row) -> None:
        self.block, self.keys = int(row["block"]), list(row["keys"])
        self.flags = np.array(list(row["flags"]), bool)
        self.lengths = get(row["lengths"], "<u4").astype(np.int64)
        self.words = get_sorted(row["words"])
        self.tokens = get(row["tokens"], "<u4").astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.first = self.ends - self.lengths
        self.spelling = unsqueeze(row["spelling"]).split(b"\n") if row.get("spelling") else []


def each(batches: Iterator[pa.RecordBatch] | pa.Table) -> Iterator[Tokens]:
    for b in batches.to_batches() if isinstance(batches, pa.Table) else batches:
        for i in range(b.num_rows):
            yield Tokens(b.slice(i, 1).to_pylist()[0])


def ranges_for(entries: int) -> int:
    return max(1, -(-entries // RANGE_ENTRIES))


PARCEL = "kind int, bucket long, block long, hashes binary, counts binary, classes binary, more binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary()), ("more", pa.binary())])


def parcels(kind: int, block: int, hashes: np.ndarray, counts: np.ndarray, ranges: int, classes: np.ndarray | None = None, more: np.ndarray | None = None) -> dict[str, list]:
    """The rows that a block sends: one for each range that it has hashes in. more: 32 more bits of each hash."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(ranges + 1, dtype=np.uint64)).tolist()
    own = [(i, s, t) for i, (s, t) in enumerate(zip(cuts, cuts[1:])) if t > s]
    return {
        "kind": [kind] * len(own), "bucket": [i for i, _, _ in own], "block": [block] * len(own),
        "hashes": [put_sorted(hashes[s:t]) for _, s, t in own], "counts": [put(counts[s:t].astype(np.uint64)) for _, s, t in own],
        "classes": [None if classes is None else put(classes[s:t].astype(np.uint8)) for _, s, t in own],
        "more": [None if more is None else put(more[s:t]) for _, s, t in own],
    }


def class_sums(kind: int, block: int, novel: np.ndarray, seen: np.ndarray, ranges: int) -> dict[str, list]:
    """A row of sums by class that a block knows by itself; totals() adds these up under the kind -kind."""
    return {"kind": [-kind], "bucket": [block % ranges], "block": [block], "hashes": [put(novel.astype(np.uint64))], "counts": [put(seen.astype(np.uint64))], "classes": [None], "more": [None]}


def added(parts: list[np.ndarray], counts: list[np.ndarray], more: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes' totals, in how many parts each stands, and where each entry's hash is among them."""
    keys, n = np.concatenate(parts), np.concatenate(counts)
    rest = np.concatenate(more) if more is not None else None
    order = np.argsort(keys, kind="stable") if rest is None else np.lexsort((rest, keys))
    s = keys[order]
    fresh = s[1:] != s[:-1] if rest is None else (s[1:] != s[:-1]) | (rest[order][1:] != rest[order][:-1])
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), fresh]))
    total = np.add.reduceat(n[order], head) if len(s) else n
    where = np.empty(len(s), np.int64)
    where[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(s))))
    return total, np.diff(np.append(head, len(s))), where


#: novel and seen: of each class, the hashes counted once, and all counts.
ANSWER = "kind int, bucket long, block long, totals binary, sum long, present long, novel array<long>, seen array<long>"


def totals(sent: DataFrame, classes: int = 0, name: bool = False, more: bool = False) -> DataFrame:
    """Answers, saved: totals in the order of the parcel's hashes; with name, names instead of totals: a number from 1
    for each hash that is counted twice or more, else 0, no two in a kind alike. sum, present
    (hashes with a count) and the sums by class stand in one answer of each range and are 0 or null in its others."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] < 0:  # sums by class, already made
            novel, seen = (np.sum([get(x, "<u8") for x in pdf[c]], axis=0).astype(np.int64) for c in ("hashes", "counts"))
            return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "bucket": 0, "block": -1, "totals": None, "sum": 0, "present": 0, "novel": [novel], "seen": [seen]})
        pdf = pdf.sort_values("block")
        parts = [get_sorted(x) for x in pdf["hashes"]]
        total, n_blocks, where = added(parts, [get(x, "<u8") for x in pdf["counts"]], [get(x, "<u4") for x in pdf["more"]] if more else None)
        if name:
            shared = total > 1
            own = np.where(shared, (np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32)) + np.cumsum(shared).astype(np.uint64), np.uint64(0))
        else:  # the lowest bit says whether the hash stands in this block alone
            own = (total << np.uint64(1)) | (n_blocks == 1).astype(np.uint64)
        out, s = [], 0
        for p in parts:
            out.append(put(own[where[s : s + len(p)]]))
            s += len(p)
        novel = seen = None
        if classes:
            of = np.zeros(len(total), np.uint8)
            of[where] = np.concatenate([get(x, "|u1") for x in pdf["classes"]])
            # Sums of whole numbers, exact below 2^53 within a range.
            novel, seen = np.bincount(of, total == 1, classes).astype(np.int64), np.bincount(of, total.astype(np.float64), classes).astype(np.int64)
        first = [i == 0 for i in range(len(out))]
        return pd.DataFrame({
            "kind": pdf["kind"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "block": pdf["block"].to_numpy(), "totals": out,
            "sum": [int(total.sum()) if x else 0 for x in first], "present": [int((total > 0).sum()) if x else 0 for x in first],
            "novel": [novel if x else None for x in first], "seen": [seen if x else None for x in first]})

    return save(sent.groupBy("kind", "bucket").applyInPandas(add, ANSWER))


def named(pdf: pd.DataFrame, kind: int, block: int) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted hashes."""
    own = pdf[(pdf["kind"] == kind) & (pdf["block"] == block)].sort_values("bucket")
    return np.concatenate([get(x, "<u8") for x in own["totals"]]) if len(own) else np.zeros(0, np.uint64)


def answer(pdf: pd.DataFrame, kind: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and which of the hashes stand in no other block."""
    got = named(pdf, kind, block)
    return (got >> np.uint64(1)).astype(np.int64), (got & np.uint64(1)).astype(bool)
