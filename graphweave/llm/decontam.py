"""Benchmark decontamination: a prefix-filtered containment join, native.

Item windows of ten words are the sets to find. Their words are ordered by
rarity over all documents, and the rarest word of a window is its prefix: a
text that contains the window contains that word, at the window's own offset
from its start. The places of prefix words leave the scan, each with the words
around it; they are joined to the windows on the prefix word, bounded by
position and length (the window must lie inside the text), and verified word
by word. No text is shuffled.

The plan is the same whatever the benchmark: one scan that counts its words and
one that finds places. Prefix words (and the windows behind them) are broadcast
while their number and bytes are within stated bounds; beyond these, places are
shuffled to the words, which are the rarest and so have few.

Defined cases: a null text or item has no words, so no window; an item of
fewer words than a window is one window; equal items each count; equal rows of
documents each give a row; an empty table on either side gives rows without
hits, or no rows. Only key and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save

WINDOW = 10
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows and bytes that are broadcast at most.
PREFIX_WORDS = 500_000
BROADCAST_BYTES = 64 << 20
#: Longs of the bit filter, as a power of two: 16 MB at every size.
FILTER_BITS = 20


def split_words(text: Column) -> Column:
    """Words after an empty first entry; a text that ends with a sign has an empty last entry too."""
    known = F.coalesce(text, F.lit(""))
    # lower() does just A-Z where all is ASCII, and is faster.
    plain = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(ascii_lower(known))
    return F.split(F.concat(F.lit(" "), plain), BETWEEN, -1)


def words(text: Column) -> Column:
    return F.filter(split_words(text), lambda w: w != "")


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item_id, win, ws: the window's words), distinct; win: two hashes of the words."""
    w = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1)))
    each = w.select("item_id", F.explode(F.transform(at, lambda i: F.slice("ws", i, window))).alias("ws")).distinct()
    return each.select("item_id", F.struct(F.xxhash64("ws").alias("h1"), F.xxhash64(F.lit("w"), "ws").alias("h2")).alias("win"), "ws")


def within(df: DataFrame, most: int, *measured: Column) -> bool:
    """Whether the rows and the measured bytes of df, saved, may be broadcast."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(measured, F.lit(0))), F.lit(0))).first()
    return n <= most and size <= BROADCAST_BYTES


def bounded(df: DataFrame, most: int, *measured: Column) -> DataFrame:
    """df, saved, to be broadcast if it is within the bounds."""
    return F.broadcast(df) if within(df, most, *measured) else df


def sieve(words_: DataFrame) -> DataFrame:
    """words_(word) -> (at, bits): a filter of 2^26 bits at most; words that pass() it may be among these."""
    h = F.xxhash64("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    return words_.select(h.bitwiseAND((1 << FILTER_BITS) - 1).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))


def passing(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """rows(word, ..) without those that the filter rules out."""
    h = F.xxhash64("word")
    at = rows.withColumns({"at": h.bitwiseAND((1 << FILTER_BITS) - 1), "bit": F.shiftrightunsigned(h, 58).cast("int")})
    return at.join(F.broadcast(filter_), "at").filter(F.getbit("bits", F.col("bit")) == 1).drop("at", "bit", "bits")


def rarity(docs: DataFrame, vocabulary: DataFrame, text: str, most: int) -> DataFrame:
    """(word, n): how often each word of the vocabulary stands in all texts. Occurrences are added up before they meet
    the vocabulary by a shuffle: a word is a row for each task."""
    every = docs.select(F.explode_outer(split_words(F.col(text))).alias("word"))
    if within(vocabulary, most, F.octet_length("word")):
        n = every.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        n = passing(every, save(sieve(vocabulary))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(n, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _n_words(texts: str) -> Column:
    """Of what split_words() gave."""
    return F.size(texts) - 1 - F.when((F.size(texts) > 1) & (F.element_at(texts, -1) == ""), 1).otherwise(0)


def places_shuffled(docs: DataFrame, prefix: DataFrame, key: str, text: str) -> DataFrame:
    """The same as places(), for prefix words that are too many to broadcast."""
    base = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), split_words(F.col(text)).alias("text_words"))
    each = base.select("doc_id", "t", F.posexplode_outer("text_words").alias("i", "word"))
    some = save(prefix.select("word").distinct())
    found = passing(each, save(sieve(some))).filter((F.col("word") != "") & (F.col("i") > 0))
    start = F.col("i") - 1 - F.col("off")
    starts = found.join(prefix, "word").filter(start >= 0).groupBy("doc_id", "t").agg(F.collect_set(F.struct(start.alias("start"), "len", F.col("win.h1").alias("h1"))).alias("starts"))
    starts = starts.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "starts")
    both = base.withColumn("n", _n_words("text_words")).join(starts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t").eqNullSafe(F.col("u"))), "left")
    # An array is never null here, and words start behind its empty first entry. Hashes first, the words of what is left then.
    own = lambda x: F.slice("text_words", x["start"] + 2, x["len"])
    likely = F.filter("starts", lambda x: (x["start"] + x["len"] <= F.col("n")) & (F.xxhash64(own(x)) == x["h1"]))
    both = save(both.select("doc_id", "t", "n", F.transform(likely, lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), own(x).alias("ws"))).alias("likely")))
    rows = both.select("doc_id", "t", "n", F.lit(-1).alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(prefix.schema["win"].dataType).alias("win"))
    sure = both.select("doc_id", "t", "n", F.explode("likely").alias("x")).select("doc_id", "t", "n", "x.*").join(prefix.select("ws", "win"), "ws")
    return save(rows.unionByName(sure.select(*rows.columns).distinct()))


def places(docs: DataFrame, prefix: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """prefix(word, win, ws, off, len) -> saved (doc_id, t, n, start, len, win): where the windows stand, and for every
    row of docs one row with start -1."""
    base = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), split_words(F.col(text)).alias("text_words"))
    at = base.select("doc_id", "t", "text_words", F.posexplode_outer("text_words").alias("i", "word"))
    # The empty first entry stands for the row itself: words are at 1, 2, .. No array is empty, and an outer explode
    # saves the filter on its size that Spark would add, which splits every text once more.
    some = save(prefix.select("word").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "word string")))
    if not within(some, most, F.octet_length("word")):
        return places_shuffled(docs, prefix, key, text)
    reach = prefix.agg(F.coalesce(F.max(F.greatest(F.col("off"), F.col("len") - F.col("off"))), F.lit(1))).first()[0]
    hits = at.join(F.broadcast(some), "word").filter((F.col("word") != "") | (F.col("i") == 0))
    low = F.greatest(F.lit(1), F.col("i") - reach)
    near = F.when(F.col("i") > 0, F.slice("text_words", low + 1, F.lit(2 * reach + 1)))
    hits = save(hits.select("doc_id", "t", "i", "word", low.alias("low"), _n_words("text_words").alias("n"), near.alias("near")))
    rows = hits.filter("i = 0").select("doc_id", "t", "n", F.lit(-1).alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(prefix.schema["win"].dataType).alias("win"))
    own = bounded(prefix, most, F.octet_length(F.array_join("ws", " ")), F.octet_length("word"))
    start = F.col("i") - 1 - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n"))
    both = hits.filter("i > 0").join(own, "word").filter(inside)
    same = F.slice("near", F.greatest(F.lit(1), start + 2 - F.col("low")), F.col("len")) == F.col("ws")
    return save(rows.unionByName(both.filter(same).select("doc_id", "t", "n", start.alias("start"), "len", "win").distinct()))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = PREFIX_WORDS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings, comma-joined), t (a hash of
    the text), contaminated. block: the rows that are broadcast at most."""
    each = save(item_windows(items, item_key, item_text, window))
    windows = each.select("win", "ws").distinct()
    vocabulary = save(windows.select(F.explode("ws").alias("word")).distinct())
    counts = save(rarity(docs, vocabulary, text, block))
    # The rarest word of each window, its first place there.
    placed = windows.select("win", F.posexplode("ws").alias("off", "word")).join(counts, "word")
    first = placed.groupBy("win").agg(F.min(F.struct("n", "word", "off")).alias("m"))
    prefix = save(first.join(windows, "win").select(F.col("m.word").alias("word"), F.col("m.off").alias("off"), F.size("ws").alias("len"), "win", "ws"))
    placed = places(docs, prefix, key, text, block)
    found = placed.filter("start >= 0")
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    spans = found.groupBy("doc_id", "t").agg(F.size(F.array_distinct(covered)).alias("n_hit"))
    of_items = found.select("doc_id", "t", "win").distinct().join(bounded(each.select("item_id", "win"), block, F.octet_length(F.col("item_id").cast("string"))), "win")
    of_items = of_items.select("doc_id", "t", F.col("item_id").cast("string").alias("item_id")).distinct()
    of_items = of_items.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    on = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.t").eqNullSafe(F.col(f"{b}.t"))
    hits = spans.alias("s").join(of_items.alias("o"), on("s", "o"), "left").select("s.doc_id", "s.t", "n_hit", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    # Rows that agree in key and text share their hits, and each has its own row.
    own = placed.filter("start < 0").select("doc_id", "t", F.col("n").cast("long").alias("n_words"))
    out = own.alias("d").join(hits.alias("h"), on("d", "h"), "left")
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("long")
    return out.select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.greatest(F.lit(0), F.coalesce(F.size("ids"), F.lit(0))).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("item_ids"), "d.t", (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
w AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS p FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM w),
d AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(1, len(ws) - n + 2))) AS p FROM dw, lens WHERE len(ws) >= n)),
h AS (SELECT d.doc_id, d.p, d.n, w.item_id FROM d JOIN w ON d.g = w.g AND d.n = w.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id
"""
