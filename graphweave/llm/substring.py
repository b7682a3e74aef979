"""Substring dedup by recompression.

Spark names words, then symbols, in rounds. A round of naming is a job over the
corpus: every block sends the distinct symbols it has, each is given a name,
which is the same wherever it stands, or is found to stand once. Between two
namings a text is recompressed twice: runs of one symbol become one symbol, then
pairs of neighbours (a hash of the names splits the alphabet in two; a left
symbol before a right symbol is joined with it). Equal passages so get equal
symbols wherever the decisions were the same. For each symbol the span of words
that decided it is kept: an equal window elsewhere that holds the whole span
holds the same symbol.

Shared symbols reveal repeats: a window that holds the span of a symbol that
stands once cannot repeat and goes; later rounds only name what is left.
They verify them as well: a window is written in symbols, the highest whose
spans it holds and towards its edges lower ones and at last words, and two
windows are equal exactly when they are written alike. That writing, as a hash
of 96 bits of names and places, is counted over the corpus.

Names are given to 64-bit hashes of words and of pairs of names. Two different
symbols of one hash would share a name; that matters only where two windows
agree in everything else.

Defined cases: a null or empty text, or one shorter than a window, keeps all
its words; windows overlap freely and may repeat in one document; equal rows
repeat each other; an empty table gives no rows. Only the key and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import PARCEL, SCHEMA, Tokens, each, mix64, named, pair64, parcels, ranges_for, tokenise, totals

WINDOW = 35
#: Rounds of naming after the words', and recompressions before each: nearly every window of 35 words holds the
#: span of some symbol of the last, and few would hold one two recompressions later.
ROUNDS, STEPS = 2, 2
#: Odd numbers, for rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WRITTEN = 100


@dataclass
class Level:
    """Symbols in text order: the words [start, next start) they stand for, the words [lo, hi) that decided them, and whether a text begins."""

    names: np.ndarray
    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    new: np.ndarray


def recompress(x: Level, salt: int) -> Level:
    """Runs, then pairs. Where a text's bound decided, the span reaches beyond it: no other place can tell."""
    s, start, lo, hi, new = x.names, x.start, x.lo, x.hi, x.new
    if not len(s):
        return x
    # Runs: a neighbour on either side was looked at, if there is one.
    head = new.copy()
    head[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(s)) - 1
    length = tail - at + 1
    after = np.minimum(tail + 1, len(s) - 1)
    last = (tail + 1 >= len(s)) | new[after]
    lo, hi = np.where(new[at], lo[at] - 1, np.minimum(lo[np.maximum(at - 1, 0)], lo[at])), np.where(last, hi[tail] + 1, np.maximum(hi[after], hi[tail]))
    s = np.where(length > 1, pair64(s[at], length.astype(np.uint64) + np.uint64(salt << 8)), s[at])
    start, new = start[at], new[at]
    # Pairs: left symbols look right, right symbols look left.
    is_left = (mix64(s + np.uint64(salt)) & np.uint64(1)) == 0
    joint = np.zeros(len(s), bool)  # joined with the next
    joint[:-1] = is_left[:-1] & ~is_left[1:] & ~new[1:]
    nxt, prv = np.minimum(np.arange(len(s)) + 1, len(s) - 1), np.maximum(np.arange(len(s)) - 1, 0)
    end = np.append(new[1:], True)
    lo2 = np.where(is_left, lo, np.where(new, lo - 1, np.minimum(lo, lo[prv])))
    hi2 = np.where(is_left, np.where(end, hi + 1, np.maximum(hi, hi[nxt])), hi)
    keep = np.ones(len(s), bool)
    keep[1:] = ~joint[:-1]
    s = np.where(joint, pair64(s, s[nxt]), s)[keep]
    lo, hi = np.where(joint, np.minimum(lo2, lo2[nxt]), lo2)[keep], np.where(joint, np.maximum(hi2, hi2[nxt]), hi2)[keep]
    return Level(s, start[keep], lo, hi, new[keep])


class Parse:
    """A block's texts on the named levels, and the windows that may still repeat.

    names_of(level, hashes): the names that Spark gave to the sorted distinct
    hashes of a level, 0 for what stands once."""

    def __init__(self, b: Tokens, window: int, rounds: int, names_of: Callable[[int, np.ndarray], np.ndarray]):
        self.window, n = window, len(b.tokens)
        self.n, self.b = n, b
        new = np.zeros(n, bool)
        new[b.first[b.lengths > 0]] = True
        places = np.arange(n)
        self.text = np.repeat(np.arange(len(b.lengths)), b.lengths)
        self.alive = np.repeat(b.ends, b.lengths) - places >= window  # windows start here
        self.levels: list[Level] = []
        x = Level(b.words[b.tokens], places, places, places + 1, new)
        for r in range(rounds):
            x = self.with_names(self.raised(x, r), r, names_of)
        self.last = x

    def raised(self, x: Level, r: int) -> Level:
        """Level r, not yet named, from the level below."""
        for i in range(STEPS if r else 0):
            x = recompress(x, r * STEPS + i)
        return x

    def sent(self, x: Level) -> np.ndarray:
        """Which symbols are decided within one of the living windows of their text."""
        lo, hi = x.lo, x.hi
        ok = (hi - lo <= self.window) & (lo >= 0) & (hi <= self.n)
        ok[ok] = self.text[lo[ok]] == self.text[hi[ok] - 1]
        living = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.alive)])
        ok[ok] = living[lo[ok] + 1] > living[np.maximum(hi[ok] - self.window, 0)]
        return ok

    def distinct(self, x: Level, ok: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct names of some symbols, and each one's place; words are sorted already."""
        if r:
            return np.unique(x.names[ok], return_inverse=True)
        here = np.bincount(self.b.tokens[ok], minlength=len(self.b.words)) > 0
        return self.b.words[here], (np.cumsum(here) - 1)[self.b.tokens[ok]]

    def with_names(self, x: Level, r: int, names_of) -> Level:
        """The level with Spark's names; windows that hold a symbol that stands once go."""
        ok = self.sent(x)
        own, at = self.distinct(x, ok, r)
        got = names_of(r, own)[at]
        lone = got == 0
        lo, hi = x.lo[ok], x.hi[ok]
        change = np.bincount(np.maximum(hi[lone] - self.window, 0), minlength=self.n + 1) - np.bincount(lo[lone] + 1, minlength=self.n + 1)
        self.alive &= np.cumsum(change[: self.n]) == 0
        names = mix64(x.names ^ np.uint64(0xA5A5A5A5A5A5A5A5))  # of what no living window holds: any
        names[ok] = np.where(lone, names[ok], pair64(got, np.full(len(got), r + 1, np.uint64)))
        x = Level(names, x.start, x.lo, x.hi, x.new)
        self.levels.append(x)
        return x

    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the living windows, and how each is written: 64 and 32 bits."""
        p = np.flatnonzero(self.alive)
        end = p + self.window
        powers = [tuple(np.cumprod(np.append(np.uint64(1), np.full(self.n, f, np.uint64)), dtype=np.uint64) for f in (pow(base, -1, 1 << 64), base)) for base in BASES]
        totals_ = [np.zeros(len(p), np.uint64) for _ in BASES]
        left, right = p.copy(), p.copy()  # the words that higher symbols cover so far: none
        covered = np.zeros(len(p), bool)
        for x in reversed(self.levels):
            # Spans are in order, so the symbols that a window decides are neighbours.
            i, j = np.searchsorted(self.monotone(x.lo, True), p), np.searchsorted(self.monotone(x.hi, False), end, side="right")
            some = j > i
            stop = np.append(x.start[1:], self.n)
            i, j = np.where(some, i, 0), np.where(some, j, 1)
            s, e = x.start[i], stop[j - 1]
            a, z = np.searchsorted(x.start, left), np.searchsorted(x.start, right)
            mixed = mix64(x.names)
            for total, (back, _) in zip(totals_, powers):
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * back[x.start], dtype=np.uint64)])
                part = np.where(covered, run[a] - run[i] + run[j] - run[z], run[j] - run[i])
                total += np.where(some, part, np.uint64(0))
            left, right, covered = np.where(some, s, left), np.where(some, e, right), covered | some
        h, g = (mix64(total * ahead[p]) for total, (_, ahead) in zip(totals_, powers))
        return p, h, (g >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def monotone(a: np.ndarray, low: bool) -> np.ndarray:
        """lo as it can only grow, hi as it must: a symbol counts if all beside it towards the window's middle do."""
        return np.maximum.accumulate(a) if low else np.minimum.accumulate(a[::-1])[::-1]


def _all(left: pa.Table, schema: pa.Schema, of: Callable[[Tokens], pa.Table | dict]) -> pa.Table:
    out = [schema.empty_table()]
    for b in each(left):
        x = of(b)
        out.append(x if isinstance(x, pa.Table) else pa.Table.from_pydict(x, schema))
    return pa.concat_tables(out)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    packed = tokenise(docs, key, text, spell=True)
    n_words = packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = ranges_for(n_words // 4)
    blocks = packed.groupBy("block")
    spelt = [c for c in packed.columns if c != "spelling"]
    slim_blocks = packed.select(*spelt).groupBy("block")

    def parse(b: Tokens, got: pd.DataFrame, upto: int) -> Parse:
        return Parse(b, window, upto, lambda r, own: named(got, r, b.block))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each(batches):
            yield from _all_symbols(b, None, 0).to_batches()

    def _all_symbols(b: Tokens, got: pd.DataFrame | None, r: int) -> pa.Table:
        """The symbols of level r that a living window decides; names of the levels below are in got."""
        p = parse(b, got, r)
        top = p.raised(p.last, r)
        own, at = p.distinct(top, p.sent(top), r)
        return pa.Table.from_pydict(parcels(r, b.block, own, np.minimum(np.bincount(at, minlength=len(own)), 2), ranges), SCHEMA)

    def sender(r: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def send(left: pa.Table, got: pa.Table) -> pa.Table:
            return _all(left, SCHEMA, lambda b: _all_symbols(b, got.to_pandas(), r))

        return send

    tables = [totals(packed.select(*spelt).mapInArrow(send_words, PARCEL), name=True)]
    for r in range(1, rounds + 1):
        tables.append(totals(slim_blocks.cogroup(_answers(tables)).applyInArrow(sender(r), PARCEL), name=True))

    def windows(b: Tokens, got: pd.DataFrame):
        """Where the living windows start, and the places of their writings among the distinct ones."""
        p = parse(b, got, rounds + 1)
        at, h, g = p.written()
        order = np.lexsort((g, h))
        head = np.ones(len(h), bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(head) - 1
        return at, h[order][head], g[order][head], place

    def send_windows(left: pa.Table, got: pa.Table) -> pa.Table:
        def of(b: Tokens) -> dict:
            at, h, g, place = windows(b, got.to_pandas())
            return parcels(WRITTEN, b.block, h, np.minimum(np.bincount(place, minlength=len(h)), 2), ranges, more=g)

        return _all(left, SCHEMA, of)

    repeats = totals(slim_blocks.cogroup(_answers(tables)).applyInArrow(send_windows, PARCEL), name=True, more=True)
    schema = docs.select(F.col(key).alias("doc_id")).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    out_schema = to_arrow_schema(schema)

    def finish(left: pa.Table, got: pa.Table) -> pa.Table:
        def of(b: Tokens) -> dict:
            pdf = got.to_pandas()
            at, h, _, place = windows(b, pdf)
            twice = at[named(pdf, WRITTEN, b.block)[place] > 0]
            n = len(b.tokens)
            change = np.zeros(n + window + 1, np.int64)
            change[twice] += 1
            change[twice + window] -= 1  # starts are distinct
            kept = np.cumsum(change[:n]) == 0
            words = np.array(b.spelling, dtype=object)[b.tokens]
            removed = np.add.reduceat(np.append(~kept, False).astype(np.int64), b.first) * (b.lengths > 0) if len(b.first) else b.first
            sha = [hashlib.sha256(b" ".join(words[s:e][kept[s:e]].tolist())).hexdigest() for s, e in zip(b.first.tolist(), b.ends.tolist())]
            return {"doc_id": b.keys, "n_words": b.lengths, "n_removed": removed, "kept_sha256": sha}

        return _all(left, out_schema, of)

    return blocks.cogroup(_answers([*tables, repeats])).applyInArrow(finish, schema)


def _answers(tables: list[DataFrame]):
    out = tables[0].select("kind", "bucket", "block", "totals")
    for t in tables[1:]:
        out = out.unionByName(t.select("kind", "bucket", "block", "totals"))
    return out.groupBy("block")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM w JOIN r USING (h), range(0, 35) t(k)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY u.p) AS kept
  FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
