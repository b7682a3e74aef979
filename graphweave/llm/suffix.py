"""Suffix-array dedup: byte strings that stand twice, by merging Burrows-Wheeler transforms.

Every window of 200 bytes has an anchor: of its strings of 56 bytes the one of
the smallest hash, the leftmost if it stands there twice. Equal windows have
equal anchors at equal places, so a window only has to be compared with those
of its anchor. Neighbouring windows of one anchor are one row: the text to
the right of the anchor's start and, read backwards, the text to the left.

Rows of anchors that stand twice anywhere are dealt by anchor to ranges. A block
of texts is a shard: it sends a range the positional Burrows-Wheeler transforms
of its rows' right and left texts: the symbols, 8 bytes each, of a column in the
order of what follows them. A task merges the shards of a range, and never sorts a
text: the interleave of the shards begins as one after the other and is refined
from the last column to the first, each time by the next unread symbol of the
shard that stands there; shards stay in their order. Neighbours in the last
interleave give the common prefixes, byte by byte, a common prefix cuts the order into
intervals of equal beginnings, and a window repeats if another row is in its
interval on the right and on the left, at the lengths that the window has there.

An anchor that stands more than HOT times (a line that a third of all texts
hold, say) would fill a range, so its windows are counted one by one instead, as
hashes of 96 bits that spread over all ranges: that is the only part that
rests on hashes of windows. Rows that are equal within a block are sent once.

Defined cases: a null text is empty; strings are bytes, and may begin within a
character; matches never cross texts, may overlap and may be in one text; equal
rows repeat each other; runs and periods of any length are like any other text; an
empty table gives no rows. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import save_buckets
from .blocks import BLOCKS_PER_TASK, PARCEL, SCHEMA, TASKS, get, mix64, named, parcels, put, ranges_for, squeeze, totals, unsqueeze
from .common import save

#: Bytes of a window and of its anchor; multiples of 8.
WINDOW, GRAM = 200, 56
#: An anchor of more rows is hot.
HOT = 4096
#: Rows that a range has, about, before those go whose anchors stand once.
RANGE_ROWS = 1 << 16
#: Of texts in a block: the least, and the most, for corpora that would make too many blocks.
BLOCK_BYTES, MOST_BYTES, BLOCKS = 2 << 20, 12 << 20, 1 << 22
#: Positions that are hashed at a time.
CHUNK = 1 << 18
ANCHORS, MERGED, COUNTED = 0, 1, 2
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: The first k bytes of a symbol.
FIRST = np.array([((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(9)], np.uint64)


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """The least of every k neighbours."""
    n = len(v)
    rows = np.append(v, np.full(-n % k, np.iinfo(v.dtype).max, v.dtype)).reshape(-1, k)
    ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - k + 1], ahead[k - 1 : n])


class Text:
    """Texts of a block, one after the other, with room for a window before and after."""

    def __init__(self, data: bytes, window: int, gram: int):
        self.window, self.gram, self.n, self.pad = window, gram, len(data), window + 8
        buffer = b"\0" * self.pad + data + b"\0" * self.pad
        self.eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))  # 8 bytes from every byte on
        self.bytes = np.frombuffer(buffer, np.uint8)[self.pad : self.pad + self.n]

    def folded(self, at: np.ndarray | slice) -> np.ndarray:
        """A hash of the gram at each place."""
        h = np.uint64(0)
        for j in range(0, self.gram, 8):
            h = (h ^ self.eight[slice(at.start + j + self.pad, at.stop + j + self.pad) if isinstance(at, slice) else at + (j + self.pad)]) * np.uint64(BASES[0])
            h ^= h >> np.uint64(29)
        return mix64(h)

    def anchors(self, s: int, e: int) -> np.ndarray:
        """Of the windows that begin in [s, e), also of those that cross texts."""
        span = self.window - self.gram + 1
        low = np.uint64((1 << (CHUNK + span).bit_length()) - 1)
        place = np.arange(e - s + span - 1, dtype=np.uint64)
        return s + (sliding_min(self.folded(slice(s, e + span - 1)) & ~low | place, span) & low).astype(np.int64)

    def rows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, anchor of each row."""
        whole = np.ones(self.n, bool)  # a window begins here and ends in the same text
        cut = np.minimum(lengths, self.window - 1)
        whole[np.repeat(np.cumsum(lengths) - cut, cut) + ramp(cut)] = False
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        before = (-2, -1)  # the window before this chunk and its anchor
        for s in range(0, self.n - self.window + 1, CHUNK):
            e = min(self.n - self.window + 1, s + CHUNK)
            p = np.flatnonzero(whole[s:e])
            if not len(p):
                continue
            a, p = self.anchors(s, e)[p], p + s
            head = np.ones(len(p), bool)
            head[0] = before != (p[0] - 1, a[0])
            head[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
            at = np.flatnonzero(head)
            parts.append((p[at], a[at]))
            before = int(p[-1]), int(a[-1])
        first, anchor = (np.concatenate(x) for x in zip(*parts))
        # A row ends where the next begins or its text has no more windows.
        stop = np.cumsum(lengths) - self.window + 1
        return first, np.minimum(np.append(first[1:], self.n), stop[np.searchsorted(stop, first, side="right")]) - first, anchor


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(docs: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """(block, keys, lengths, text, n_rows, first, windows, anchor), saved, in buckets by block."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    most = max(BLOCK_BYTES, min(MOST_BYTES, n_bytes // BLOCKS))
    rows = docs.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            data = b"".join(texts)
            lengths = np.array([len(t) for t in texts], np.uint64)
            first, windows, anchor = Text(data, window, gram).rows(lengths.astype(np.int64))
            own = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([put(lengths)]), pa.array([squeeze(data)]), pa.array([len(first)]),
                 pa.array([put(np.diff(first.astype(np.uint64), prepend=np.uint64(0)))]), pa.array([put(windows.astype(np.uint16))]), pa.array([put((anchor - first).astype(np.uint16))])],
                ["block", "keys", "lengths", "text", "n_rows", "first", "windows", "anchor"])

        for b in batches:
            at = 0
            for i, n in enumerate(pc.binary_length(b.column(1)).to_pylist(), 1):
                size += n
                if size >= most or i == b.num_rows:
                    keys.append(b.column(0)[at:i])
                    texts += b.column(1)[at:i].to_pylist()
                    at = i
                if size >= most:
                    yield block()
                    number, keys, texts, size = number + 1, [], [], 0
        if texts:
            yield block()

    return save_buckets(rows.mapInArrow(run, f"block long, keys array<{kind}>, lengths binary, text binary, n_rows long, first binary, windows binary, anchor binary"), "block", min(TASKS, max(8, n_bytes // (most * BLOCKS_PER_TASK))))


class Shard(Text):
    """A block and its rows."""

    def __init__(self, row: dict, window: int, gram: int):
        super().__init__(unsqueeze(row["text"]), window, gram)
        self.block, self.keys = row["block"], row["keys"]
        self.lengths = get(row["lengths"], "<u8").astype(np.int64)
        self.first = np.cumsum(get(row["first"], "<u8")).astype(np.int64)
        self.windows = get(row["windows"], "<u2").astype(np.int64)
        self.anchor = self.first + get(row["anchor"], "<u2")
        # Anchors have small hashes; mixed again, they spread over all ranges.
        self.grams, self.gram_of = np.unique(mix64(self.folded(self.anchor) * np.uint64(BASES[1])), return_inverse=True)

    def of(self, got: pd.DataFrame, ranges: int, hot: int) -> None:
        """Which rows are merged: sent[i] is one of each, in the order of ranges, row_of the place of every merged row among these."""
        total = (named(got, ANCHORS, self.block) >> np.uint64(1)).astype(np.int64)[self.gram_of]
        self.hot = np.flatnonzero(total > hot)
        own = self.merged = np.flatnonzero((total > 1) & (total <= hot))
        self.range_of = (((self.grams[self.gram_of[own]] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        h = [np.full(len(own), b, np.uint64) + (self.windows[own] * 1024 + self.anchor[own] - self.first[own]).astype(np.uint64) for b in BASES]
        for x in self.columns(own):
            h = [mix64(h[0] * np.uint64(BASES[0]) + x), mix64(h[1] ^ x) * np.uint64(BASES[1])]
        order = np.lexsort((h[1], h[0], self.range_of))
        head = np.ones(len(own), bool)
        head[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
        self.sent, self.sent_range = own[order][head], self.range_of[order][head]
        self.row_of = np.empty(len(own), np.int64)
        self.row_of[order] = np.cumsum(head) - 1

    def columns(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Symbols by column, right texts and then left texts; 0 where no window reaches."""
        anchor = self.anchor[rows]
        right, left = self.first[rows] + self.windows[rows] - 1 + self.window - anchor, anchor - self.first[rows]
        for j in range(0, self.window, 8):
            yield self.eight[anchor + (self.pad + j)].byteswap() & FIRST[np.clip(right - j, 0, 8)]
        for j in range(0, self.window - self.gram, 8):  # the last of 8 bytes comes first: no swap
            yield self.eight[anchor + (self.pad - j - 8)] & FIRST[np.clip(left - j, 0, 8)]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of hot anchors: their starts, their distinct hashes of 64 and 32 bits, and the place of each among these."""
        p = np.repeat(self.first[self.hot], self.windows[self.hot]) + ramp(self.windows[self.hot])
        h, g = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        cuts = np.searchsorted(p, np.arange(0, self.n + CHUNK, CHUNK)).tolist()  # p grows
        for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                t = self.bytes[s * CHUNK : (s + 1) * CHUNK + self.window].astype(np.uint64) + np.uint64(1)
                at = p[i:j] - s * CHUNK
                for out, base in zip((h, g), BASES):
                    back, ahead = (np.cumprod(np.append(np.uint64(1), np.full(len(t) - 1, f, np.uint64)), dtype=np.uint64) for f in (pow(base, -1, 1 << 64), base))
                    run = np.append(np.uint64(0), np.cumsum(t * back, dtype=np.uint64))
                    out[i:j] = mix64((run[at + self.window] - run[at]) * ahead[at])
        g = (g >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((g, h))
        head = np.ones(len(h), bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(head) - 1
        return p, h[order][head], g[order][head], place


def transforms(columns: list[np.ndarray], ranges: np.ndarray) -> list[np.ndarray]:
    """Positional transforms of the rows of each range, from the last column to the first: a column's symbols in the
    order of what follows them. Rows are in the order of ranges."""
    order, out = np.arange(len(ranges)), []
    for x in reversed(columns):
        x = x[order]
        out.append(x[np.argsort(ranges[order], kind="stable")])
        order = order[np.argsort(x, kind="stable")]
    return out


def interleave(symbols: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all shards in the order of their texts, and how many bytes each has in common with the one before.

    symbols: transforms by column, the last column first, shard after shard. Each round reads every shard's symbols in its own order."""
    rows, rounds = np.arange(len(shard)), []
    for unread in symbols:
        here = np.empty(len(rows), np.uint64)
        here[np.argsort(shard[rows], kind="stable")] = unread
        order = np.argsort(here, kind="stable")
        rounds.append((here, order))
        rows = rows[order]
    common, alike, at = np.zeros(len(rows), np.int64), np.ones(max(0, len(rows) - 1), bool), np.arange(len(rows))
    for here, order in reversed(rounds):
        at = order[at]
        x = here[at]
        differ = x[1:] ^ x[:-1]
        same = (np.append(differ, np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8) != 0)[:-1]
        common[1:] += np.where(alike, np.where(differ == 0, 8, same.argmax(axis=1)), 0)
        alike &= differ == 0
    return rows, common


def repeating(symbols: np.ndarray, shard: np.ndarray, nearest: np.ndarray, windows: np.ndarray, times: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of each row's windows, one after the other, whether it stands twice in the range. nearest: from the anchor back
    to the start of the row's last window."""
    m, around = len(shard), window - gram
    right, common_right = interleave(symbols[: window // 8], shard)
    left, common_left = interleave(symbols[window // 8 :], shard)
    twice = np.zeros((m, around + 1), bool)
    on_right, on_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for back in range(around + 1):
        own = np.flatnonzero((nearest <= back) & (back < nearest + windows))
        if not len(own):
            continue
        on_right[right] = np.cumsum(common_right < window - back)
        on_left[left] = np.cumsum(common_left < back)
        _, interval = np.unique(on_right[own] * (m + 1) + on_left[own], return_inverse=True)
        twice[own, back] = (np.bincount(interval, times[own]) > 1)[interval]
    return twice[np.repeat(np.arange(m), windows), np.repeat(nearest + windows - 1, windows) - ramp(windows)]


SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("symbols", pa.binary()), ("rows", pa.binary())])
OTHER = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("totals", pa.binary())])


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    packed = pack(docs, key, text, window, gram)
    n_rows, n_bytes = packed.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1)) * MOST_BYTES).first()
    ranges, count_ranges = max(1, -(-n_rows // RANGE_ROWS)), ranges_for(n_bytes // 8)
    texts = packed.groupBy("block")

    def shards(t: pa.Table | pa.RecordBatch) -> Iterator[Shard]:
        for i in range(t.num_rows):
            yield Shard(t.slice(i, 1).to_pylist()[0], window, gram)

    def all_of(schema: pa.Schema, rows: list[dict]) -> pa.Table:
        return pa.concat_tables([schema.empty_table(), *[pa.Table.from_pydict(r, schema) for r in rows]])

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shards(b):
                yield from all_of(SCHEMA, [parcels(ANCHORS, s.block, s.grams, np.bincount(s.gram_of, minlength=len(s.grams)), count_ranges)]).to_batches()

    anchors = totals(packed.mapInArrow(send_anchors, PARCEL)).select("kind", "bucket", "block", "totals")

    def send_rows(left: pa.Table, got: pa.Table) -> pa.Table:
        out, pdf = [], got.to_pandas()
        for s in shards(left):
            s.of(pdf, ranges, hot)
            symbols = np.stack(transforms(list(s.columns(s.sent))[: window // 8], s.sent_range) + transforms(list(s.columns(s.sent))[window // 8 :], s.sent_range))
            about = np.stack([s.anchor[s.sent] - s.first[s.sent] - s.windows[s.sent] + 1, s.windows[s.sent], np.minimum(np.bincount(s.row_of, minlength=len(s.sent)), 2)]).astype(np.uint16)
            cuts = np.append(np.flatnonzero(np.diff(s.sent_range, prepend=-1)), len(s.sent)).tolist()
            own = [(int(s.sent_range[a]), s.block, squeeze(symbols[:, a:z].tobytes()), put(about[:, a:z].ravel())) for a, z in zip(cuts, cuts[1:])]
            out.append({c: list(x) for c, x in zip(SENT.names, zip(*own))} if own else {c: [] for c in SENT.names})
        return all_of(SENT, out)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        about = [get(x, "<u2").reshape(3, -1).astype(np.int64) for x in pdf["rows"]]
        sizes = [a.shape[1] for a in about]
        symbols = np.concatenate([np.frombuffer(unsqueeze(x), np.uint64).reshape(-1, m) for x, m in zip(pdf["symbols"], sizes)], axis=1)
        shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
        nearest, windows, times = np.concatenate(about, axis=1)
        bits = repeating(symbols, shard, nearest, windows, times, window, gram)
        ends = np.cumsum([int(a[1].sum()) for a in about])[:-1]
        return pd.DataFrame({"kind": MERGED, "bucket": pdf["range"], "block": pdf["block"], "totals": [squeeze(np.packbits(b).tobytes()) for b in np.split(bits, ends)]})

    answer = "kind int, bucket long, block long, totals binary"
    merged = save(texts.cogroup(anchors.groupBy("block")).applyInArrow(send_rows, "range long, block long, symbols binary, rows binary").groupBy("range").applyInPandas(merge, answer))

    def send_counted(left: pa.Table, got: pa.Table) -> pa.Table:
        out, pdf = [], got.to_pandas()
        for s in shards(left):
            s.of(pdf, ranges, hot)
            _, h, g, place = s.counted()
            out.append(parcels(COUNTED, s.block, h, np.minimum(np.bincount(place, minlength=len(h)), 2), count_ranges, more=g))
        return all_of(SCHEMA, out)

    counted = totals(texts.cogroup(anchors.groupBy("block")).applyInArrow(send_counted, PARCEL), name=True, more=True).select("kind", "bucket", "block", "totals")
    schema = docs.select(F.col(key).alias("doc_id")).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, got: pa.Table) -> pa.Table:
        out, pdf = [], got.to_pandas()
        for s in shards(left):
            s.of(pdf, ranges, hot)
            counts = s.windows[s.sent]
            own, bits = pdf[(pdf["kind"] == MERGED) & (pdf["block"] == s.block)].sort_values("bucket"), []
            for r, data in zip(own["bucket"], own["totals"]):
                bits.append(np.unpackbits(np.frombuffer(unsqueeze(data), np.uint8), count=int(counts[s.sent_range == r].sum())))
            bit, first, windows = np.concatenate([*bits, np.zeros(0, np.uint8)]), np.cumsum(counts) - counts, s.windows[s.merged]
            at = np.repeat(first[s.row_of], windows) + ramp(windows)
            starts = (np.repeat(s.first[s.merged], windows) + ramp(windows))[bit[at] > 0]
            p, _, _, place = s.counted()
            starts = np.concatenate([starts, p[named(pdf, COUNTED, s.block)[place] > 0]])
            change = np.zeros(s.n + 1, np.int32)
            change[starts] += 1  # a window is in one row
            change[starts + window] -= 1
            gone = np.cumsum(change[: s.n], dtype=np.int32) > 0
            ends = np.cumsum(s.lengths)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begin = (ends - s.lengths)[s.lengths > 0]
            opens[begin] = gone[begin]
            sums = [np.append(np.int32(0), np.cumsum(x, dtype=np.int32)) for x in (gone, opens)]
            kept = s.bytes[~gone].tobytes()
            end = (ends - sums[0][ends]).tolist()
            out.append({
                "doc_id": s.keys, "n_bytes": s.lengths, **{c: x[ends] - x[ends - s.lengths] for c, x in zip(("n_removed", "n_spans"), sums)},
                "kept_sha256": [hashlib.sha256(kept[a:z]).hexdigest() for a, z in zip([0, *end], end)]})
        return all_of(arrow, out)

    return texts.cogroup(anchors.unionByName(merged).unionByName(counted).groupBy("block")).applyInArrow(finish, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, p, md5(substring(x, 2 * p + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS p FROM d)),
g AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w JOIN g USING (h)),
i AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM s),
u AS (SELECT r, k, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY r, k),
v AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM u),
t AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS since, string_agg(substring(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM v JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(since, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
