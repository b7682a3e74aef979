"""LM scoring with a weighted backoff automaton.

The model is a smoothed trigram model over ASCII-lower-cased words and an end
token, laid out as a weighted automaton. States are the histories that stand in
the training texts: every pair of words, every word (and the start of a text),
and the root, which is the empty history. A state's arcs are the words seen
after it: an arc has a weight and leads to the state of the longest known
history that then holds. A state's failure arc leads to the history without its
first word. A text is read once, from left to right: at each token the arc is
taken if there is one, else the failure arc, and so on down to the root, whose
arc is there for every word; the log10 weights add up and the state is carried
to the next token.

    arc(h, w)    log10 P(w|h),  P(w|h) = (1 - k(h)) * c(h w) / c(h) + k(h) * P(w|h'),  h' = h without its first word
    failure(h)   log10 k(h)
    root arc(w)  log10 p(w),    p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), with c(w) = 0 for an unseen word

k(h) is the chance that something new follows: among the training tokens after
histories of a like count and length, the share of those whose n-gram stands
only once. A history that stands once foretells nothing of its own, and one
that stands twice as much as other such histories do; weights for an arc and
the failure arc add up to one over all words.

Counts are exact up to the hashes of 64 bits that name words and n-grams, and
cover all training texts. They are added up by ranges of hashes over the
corpus, and each block of texts gets back the part of the automaton that its
own texts can reach; no task holds the whole model. An n-gram with a word (or
word pair) that stands in one block only is counted there.

Within a block, texts are cut into lanes of LANE tokens that are read side by
side; a lane that begins inside a text first reads the two tokens before it,
which puts it into the state that the whole text would have come to.

Defined cases: a null or empty text is the end token alone; a row without key
is a training row; a table without training rows gives every token the same
unseen weight; equal rows are scored alike and count each; an empty table gives
no rows. Only the key and text columns are read, so other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import PARCEL, SCHEMA, Tokens, answer, class_sums, each, pair64, parcels, ranges_for, tokenise, totals

UNIGRAM, BIGRAM, TRIGRAM = 0, 1, 2
#: Training rows are those whose crc32(key as text) modulo FOLDS is not HELD.
FOLDS, HELD = 10, 0
ADD = 0.1
#: Histories of counts 1 to 4 are classes of their own, then one class for each power of two.
CLASSES = 72
LANE = 256
#: Stands before the first word.
START = np.uint64(0x5851F42D4C957F2D)


def count_class(c: np.ndarray) -> np.ndarray:
    """The class of each count; of 0 that of 1, which nothing uses."""
    c = np.maximum(c, 1)
    return np.where(c <= 4, c - 1, 2 + np.floor(np.log2(c.astype(np.float64))).astype(np.int64))


def novelty(novel, seen) -> np.ndarray:
    """k of each class."""
    return (np.asarray(novel, np.float64) + 0.5) / (np.asarray(seen, np.float64) + 1.0)


class Grams:
    """The distinct n-grams of a block, named by places in its own lists."""

    def __init__(self, b: Tokens):
        self.b, n, self.n_words = b, len(b.tokens), len(b.words)
        self.train = np.repeat(~b.flags, b.lengths)
        start = self.n_words  # the place of START among the words
        self.before = np.empty(n, np.int64)
        self.before[1:] = b.tokens[:-1]
        self.before[b.first] = start
        keys, self.pair_at = np.unique(self.before * (start + 1) + b.tokens, return_inverse=True)
        self.left, self.right = np.divmod(keys, start + 1)
        names = np.append(b.words, START)
        self.pair_hash = pair64(names[self.left], names[self.right])
        self.inner = np.ones(n, bool)  # tokens with two before them, START included
        self.inner[b.first] = False
        self.inner = np.flatnonzero(self.inner)
        keys, self.triple_at = np.unique(self.pair_at[self.inner - 1] * max(1, len(self.left)) + self.pair_at[self.inner], return_inverse=True)
        self.head, self.tail = np.divmod(keys, max(1, len(self.left)))  # the pairs (u, v) and (v, w)
        self.triple_hash = pair64(self.pair_hash[self.head], b.words[self.right[self.tail]])

    def counts(self, kind: int) -> np.ndarray:
        at, mine, size = {
            UNIGRAM: (self.b.tokens, self.train, self.n_words), BIGRAM: (self.pair_at, self.train, len(self.left)), TRIGRAM: (self.triple_at, self.train[self.inner], len(self.head)),
        }[kind]
        return np.bincount(at[mine], minlength=size)

    def sent(self, kind: int, hashes: np.ndarray, which: np.ndarray, ranges: int, classes: np.ndarray | None = None) -> pa.Table:
        at = np.flatnonzero(which)
        at = at[np.argsort(hashes[at])]
        return pa.Table.from_pydict(parcels(kind, self.b.block, hashes[at], self.counts(kind)[at], ranges, None if classes is None else classes[at]), SCHEMA)

    def taken(self, pdf: pd.DataFrame, kind: int, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts over the corpus, and which n-grams stand in no other block: answers to what was sent, own counts for the rest."""
        total, lone = self.counts(kind), np.ones(len(hashes), bool)
        at = np.flatnonzero(which)
        at = at[np.argsort(hashes[at])]
        total[at], lone[at] = answer(pdf, kind, self.b.block)
        return total, lone


class Counted(Grams):
    """The n-grams of a block with what is known of the corpus so far."""

    def __init__(self, b: Tokens, got: pd.DataFrame, starts: int, upto: int):
        super().__init__(b)
        self.c1, lone = answer(got, UNIGRAM, b.block)
        self.c1 = np.append(self.c1, starts)
        lone = np.append(lone, False)
        self.ask2 = ~lone[self.left] & ~lone[self.right]
        if upto >= BIGRAM:
            self.c2, lone2 = self.taken(got, BIGRAM, self.pair_hash, self.ask2)
            self.ask3 = ~lone2[self.head] & ~lone2[self.tail]
            self.class3 = count_class(self.c2[self.head])
        if upto >= TRIGRAM:
            self.c3, _ = self.taken(got, TRIGRAM, self.triple_hash, self.ask3)


class Automaton:
    """The part of the automaton that a block's texts can reach, as flat arrays.

    States: 0 is the root, 1 + i the word i (the last one START), then the
    pairs. arc_key is state * words + word, sorted.
    """

    def __init__(self, g: Counted, z: float, k2: np.ndarray, k3: np.ndarray):
        n, pairs = g.n_words, len(g.left)
        self.n_words, self.start, self.unseen = n, 1 + n, float(np.log10(ADD / z))
        of_pair = 2 + n + np.arange(pairs)
        p1 = (g.c1[:n] + ADD) / z
        own2 = k2[count_class(g.c1[g.left])]
        p2 = (1 - own2) * g.c2 / np.maximum(g.c1[g.left], 1) + own2 * p1[g.right]
        own3 = k3[g.class3]
        p3 = (1 - own3) * g.c3 / np.maximum(g.c2[g.head], 1) + own3 * p2[g.tail]
        has1, has2, has3 = g.c1[:n] > 0, g.c2 > 0, g.c3 > 0
        # Arcs of the root lead to words, arcs of words to pairs, arcs of pairs to pairs.
        key = np.concatenate([np.flatnonzero(has1), ((1 + g.left) * n + g.right)[has2], (of_pair[g.head] * n + g.right[g.tail])[has3]])
        weight = np.log10(np.concatenate([p1[has1], p2[has2], p3[has3]]))
        target = np.concatenate([1 + np.flatnonzero(has1), of_pair[has2], of_pair[g.tail[has3]]])
        order = np.argsort(key)
        self.arc_key, self.arc_weight, self.arc_to = key[order], weight[order], target[order]
        self.fail_to = np.concatenate([np.zeros(2 + n, np.int64), 1 + g.right])
        self.fail_weight = np.concatenate([np.zeros(1), np.log10(k2[count_class(g.c1)]), np.log10(k3[count_class(g.c2)])])

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each lane: the states after it, and the weights of the arcs taken."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        at, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = at[todo] * self.n_words + word[todo]
            i = np.minimum(np.searchsorted(self.arc_key, key), max(0, len(self.arc_key) - 1))
            hit = self.arc_key[i] == key if len(self.arc_key) else np.zeros(len(todo), bool)
            got = todo[hit]
            weight[got] += self.arc_weight[i[hit]]
            after[got] = self.arc_to[i[hit]]
            todo = todo[~hit]
            lost = todo[at[todo] == 0]  # the root's loop for unseen words
            weight[lost] += self.unseen
            todo = todo[at[todo] > 0]
            weight[todo] += self.fail_weight[at[todo]]
            at[todo] = self.fail_to[at[todo]]
        return after, weight

    def score(self, b: Tokens) -> np.ndarray:
        """The sum of the weights of each text."""
        per = -(-b.lengths // LANE)
        doc = np.repeat(np.arange(len(b.lengths)), per)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * LANE
        size = np.minimum(LANE, b.lengths[doc] - begin)
        warm = np.where(begin > 0, 2, 0)
        order = np.argsort(-(size + warm), kind="stable")
        doc, at, warm, left = doc[order], (b.first[doc] + begin - warm)[order], warm[order], (size + warm)[order]
        state = np.where(warm > 0, 0, self.start)
        total = np.zeros(len(doc))
        for step in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left, -step))  # lanes longer than step come first
            state[:live], weight = self.read(state[:live], b.tokens[at[:live] + step])
            total[:live] += np.where(step >= warm[:live], weight, 0.0)
        return np.bincount(doc, total, len(b.lengths))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD
    packed = tokenise(docs, key, text, held, lower=True, end=True)
    n_tokens, = packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # Each training text starts once: c(START).
    starts = packed.select(F.size(F.filter("flags", lambda x: ~x)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each(batches):
            own = np.bincount(b.tokens[np.repeat(~b.flags, b.lengths)], minlength=len(b.words))
            yield pa.RecordBatch.from_pydict(parcels(UNIGRAM, b.block, b.words, own, ranges_for(n_tokens // 8)), SCHEMA)

    words = totals(packed.mapInArrow(send_words, PARCEL))
    n_train, vocabulary = words.agg(F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.sum("present"), F.lit(0))).first()
    z = n_train + ADD * (vocabulary + 1)
    ranges = ranges_for(n_tokens // 2)
    blocks = packed.groupBy("block")
    slim = lambda *dfs: _union(*[d.filter("block >= 0").select("kind", "bucket", "block", "totals") for d in dfs]).groupBy("block")

    def send_pairs(left: pa.Table, got: pa.Table) -> pa.Table:
        out = [SCHEMA.empty_table()]
        for b in each(left):
            g = Counted(b, got.to_pandas(), starts, UNIGRAM)
            out.append(g.sent(BIGRAM, g.pair_hash, g.ask2, ranges))
        return pa.concat_tables(out)

    pairs = totals(blocks.cogroup(slim(words)).applyInArrow(send_pairs, PARCEL))

    def send_triples(left: pa.Table, got: pa.Table) -> pa.Table:
        out = [SCHEMA.empty_table()]
        for b in each(left):
            g = Counted(b, got.to_pandas(), starts, BIGRAM)
            out.append(g.sent(TRIGRAM, g.triple_hash, g.ask3, ranges, g.class3))
            # What a block knows by itself: pairs after words, and triples that are in no other block.
            own2, own3, mine = g.counts(BIGRAM), g.counts(TRIGRAM), ~g.ask3
            for kind_, cls, own, once in ((BIGRAM, count_class(g.c1[g.left]), own2, (g.c2 == 1) & (own2 == 1)), (TRIGRAM, g.class3[mine], own3[mine], own3[mine] == 1)):
                sums = class_sums(kind_, b.block, np.bincount(cls, once, CLASSES), np.bincount(cls, own, CLASSES), ranges)
                out.append(pa.Table.from_pydict(sums, SCHEMA))
        return pa.concat_tables(out)

    triples = totals(blocks.cogroup(slim(words, pairs)).applyInArrow(send_triples, PARCEL), classes=CLASSES)
    one = lambda name: [F.coalesce(F.sum(F.element_at(name, i + 1)), F.lit(0)).alias(f"{name}{i}") for i in range(CLASSES)]
    sums = triples.filter("novel is not null").groupBy(F.abs("kind").alias("kind")).agg(*one("novel"), *one("seen"))
    got = {r["kind"]: r for r in sums.collect()}  # one row for each of two orders
    k2, k3 = (novelty(*([got[n][f"{x}{i}"] if n in got else 0 for i in range(CLASSES)] for x in ("novel", "seen"))) for n in (BIGRAM, TRIGRAM))

    def read(left: pa.Table, got: pa.Table) -> pa.Table:
        out = [out_schema.empty_table()]
        for b in each(left):
            g = Counted(b, got.to_pandas(), starts, TRIGRAM)
            c = g.c1[b.tokens]
            doc, n = np.repeat(np.arange(len(b.keys)), b.lengths), len(b.keys)
            out.append(pa.Table.from_pydict({
                "doc_id": b.keys, "held_out": b.flags, "n_tokens": b.lengths, "n_known": np.bincount(doc, c > 0, n).astype(np.int64), "train_tokens": np.full(n, n_train, np.int64),
                "base_score": np.bincount(doc, np.log10((c + ADD) / z), n), "score": Automaton(g, z, k2, k3).score(b)}, out_schema))
        return pa.concat_tables(out)

    schema = docs.select(F.col(key).alias("doc_id")).schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    out_schema = to_arrow_schema(schema)
    return blocks.cogroup(slim(words, pairs, triples)).applyInArrow(read, schema)


def _union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for d in rest:
        first = first.unionByName(d)
    return first

