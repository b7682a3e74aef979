"""Queries on text units, budgets and names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.json_ladder import json_array, object_or
from ..functions.text import normalize_surface, token_count, truncate_tokens
from ..functions.tokenizers import BytePairTokenizer
from ..operators import budget, chunking, claims, describe, resolution
from ..plans import prompts
from ..sources.documents import caps, with_ids, without_blanks
from .base import longs, query, table

BULK = replace(EngineConfig(), max_documents=None, max_characters=None)

CHUNKS = r"""WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start_at, CASE WHEN length(text) <= 1000 THEN length(text) ELSE
    CASE WHEN length(regexp_extract(substr(text, 1, 1000), '(?s)^(.*[.?!。？！\n])', 1)) > 500 THEN length(regexp_extract(substr(text, 1, 1000), '(?s)^(.*[.?!。？！\n])', 1)) ELSE 1000 END END AS stop_at
  FROM documents WHERE regexp_matches(text, '\S')
  UNION ALL
  SELECT doc_id, text, n, start2, CASE WHEN n <= start2 + 1000 THEN n ELSE start2 + CASE WHEN m > 500 THEN m ELSE 1000 END END
  FROM (SELECT doc_id, text, n, stop_at - 160 AS start2, length(regexp_extract(substr(text, stop_at - 160 + 1, 1000), '(?s)^(.*[.?!。？！\n])', 1)) AS m FROM c WHERE stop_at < n)),
k AS (SELECT doc_id, start_at, trim(substr(text, start_at + 1, stop_at - start_at), chr(32) || chr(10) || chr(9) || chr(13)) AS text FROM c),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1)::BIGINT AS chunk_index, text FROM k WHERE text <> '')
"""


@query(CHUNKS + "SELECT doc_id, chunk_index, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk_documents(table(spark, sf_dir, "documents"), BULK)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(CHUNKS + "SELECT lang, count(*)::BIGINT AS chunks, max(chunk_index)::BIGINT AS max_index FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.struct("doc_id", "lang"))
    c = chunking.chunk_documents(docs.withColumn("doc_id", F.col("doc_id.lang")), BULK)
    return longs(c.groupBy(F.col("doc_id").alias("lang")).agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("max_index")), "chunks", "max_index")


@query("SELECT count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, count(*) > 200 OR sum(length(text)) > 500000 AS over_cap FROM documents")
def doc_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(caps(table(spark, sf_dir, "documents")), "docs", "chars")


@query(r"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(32) || chr(10) ELSE text END AS text FROM documents) WHERE regexp_matches(text, '\S')")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " \n").otherwise(F.col("text")).alias("text"))
    return without_blanks(docs).select("doc_id")


TOKENS = r"len(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\s])'))"


@query("SELECT 'own_doc_' || (row_number() OVER (ORDER BY text NULLS FIRST) - 1) AS doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def keyless_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for documents that have none."""
    return with_ids(table(spark, sf_dir, "documents").drop("doc_id"), "own").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: Single bytes, "th" and "the": a vocabulary that SQL can follow.
FEW_RANKS = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257}


@query("SELECT doc_id, (strlen(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), 'th')) - len(regexp_extract_all(coalesce(text, ''), 'the')))::BIGINT AS tokens FROM documents")
def token_counts_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", BytePairTokenizer(FEW_RANKS).count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {TOKENS}::BIGINT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\s])')[1:50], '')) AS kept FROM documents")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(truncate_tokens(F.col("text"), 50)).alias("kept"))


@query(f"""WITH t AS (SELECT source, doc_id, {TOKENS} AS n FROM documents),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT source, doc_id, least(n, 4000 - before)::BIGINT AS used FROM s WHERE before < 4000""")
def token_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source, by id, that fit into a budget."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return budget.select_within(docs, 4000, ["source"], rank="doc_id").select("source", "doc_id", F.col("used").cast("long").alias("used"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id // 24 AS list, doc_id, least({TOKENS}, 2000)::BIGINT AS cost, row_number() OVER (PARTITION BY doc_id // 24 ORDER BY doc_id) AS i FROM documents),
b AS (SELECT list, doc_id, i, 1::BIGINT AS batch, cost AS used FROM t WHERE i = 1
  UNION ALL SELECT t.list, t.doc_id, t.i, CASE WHEN t.cost > 0 AND b.used > 0 AND b.used + t.cost > 2000 THEN b.batch + 1 ELSE b.batch END,
  CASE WHEN t.cost > 0 AND b.used > 0 AND b.used + t.cost > 2000 THEN t.cost ELSE b.used + t.cost END FROM b JOIN t ON t.list = b.list AND t.i = b.i + 1)
SELECT b.list, b.doc_id, b.batch FROM b JOIN t ON t.list = b.list AND t.i = b.i WHERE cost > 0""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists of 24 documents each, packed into batches."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 24).cast("long").alias("list"), "doc_id", "text")
    return budget.batches(docs, 2000, ["list"], rank="doc_id").select("list", "doc_id", F.col("batch").cast("long").alias("batch"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'It is [' || user_id || ', ' || event_id || '] so' WHEN 1 THEN '[]' WHEN 2 THEN 'no list' ELSE '```json' || chr(10) || '["' || event_type || '", [1], {}]' || chr(10) || '```' END AS text FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 3 END::BIGINT AS items FROM a""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists out of texts: in prose, alone, fenced, or not there."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("It is ["), "user_id", F.lit(", "), "event_id", F.lit("] so"))).when(k == 1, "[]").when(k == 2, "no list").otherwise(F.concat(F.lit('```json\n["'), "event_type", F.lit('", [1], {}]\n```')))
    return e.select("event_id", F.coalesce(F.size(F.try_variant_get(F.try_parse_json(json_array(text)), "$", "array<variant>")), F.lit(-1)).cast("long").alias("items"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'none' ELSE 'none' END AS kind FROM events""")
def json_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that have what is asked of them; others, and texts without one, give the default."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit('so {"kind": "'), "event_type", F.lit('", "value": 1} there'))).when(k == 1, F.concat(F.lit('{"kind": "'), "event_type", F.lit('"}'))).otherwise(F.col("event_type"))
    doc = F.try_parse_json(object_or(text, ("kind", "value"), '{"kind": "none"}'))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(doc, "$.kind", "string").alias("kind"))


@query("""WITH d AS (SELECT user_id, list(event_type ORDER BY event_id) AS ds, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)
SELECT user_id, n::BIGINT AS n_mentions, list_reduce(ds, lambda a, d: CASE WHEN a = d THEN a ELSE a || ' | ' || d END) AS description FROM d""")
def merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions merged in order of mention, without consolidation."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("description"))
    return describe.merged_texts(e, "user_id")


@query("""SELECT doc_id, md5('Extract at most 20 entities (name, type, description) and at most 30 relations (source, target, relation_type, description) from the text.' || chr(10) ||
'Answer with one JSON object {"entities": [...], "relations": [...]}; every source and target must be the name of an entity.' || chr(10) || 'Text:' || chr(10) || text) AS prompt FROM documents""")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = EngineConfig()
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompts.extraction(F.col("text"), c.max_entities, c.max_relations)).alias("prompt"))


NOISY = "SELECT p_partkey::BIGINT AS ord, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE '  ' || p_name || '! ' END AS name, lower(p_type) AS type, (1 + p_partkey % 2)::BIGINT AS mention_count FROM part"
SURFACE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CANON = f"""WITH m AS ({NOISY}), s AS (SELECT ord, upper(trim(type)) AS type, trim(name) AS spelling, name AS raw, {SURFACE.format('name')} AS surface, mention_count FROM m),
k AS (SELECT type, surface, spelling, sum(mention_count) AS n, min(ord) AS first_ord FROM s GROUP BY ALL),
f AS (SELECT *, first_ord = min(first_ord) OVER (PARTITION BY type, surface) AS first, sum(n) OVER (PARTITION BY type, surface) AS total FROM k),
c AS (SELECT type, surface, spelling AS canonical, total::BIGINT AS mentions FROM f QUALIFY row_number() OVER (PARTITION BY type, surface ORDER BY n DESC, first DESC, lower(spelling), first_ord) = 1),
raw AS (SELECT s.raw, arg_max(c.canonical, s.ord) AS canonical FROM s JOIN c USING (type, surface) GROUP BY s.raw)
"""


def noisy_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in three spellings, as mentions of their type."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("! ")))
    return p.select(F.col("p_partkey").cast("long").alias("ord"), name.alias("name"), F.lower("p_type").alias("type"), (1 + F.col("p_partkey") % 2).cast("long").alias("mention_count"))


@query(f"WITH m AS ({NOISY}) SELECT ord, name AS raw, {SURFACE.format('name')} AS surface FROM m")
def normalize_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_mentions(spark, sf_dir).select("ord", F.col("name").alias("raw"), normalize_surface(F.col("name")).alias("surface"))


@query(CANON + "SELECT * FROM c")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(resolution.canonical_names(noisy_mentions(spark, sf_dir)), "mentions")


@query(CANON + "SELECT * FROM raw")
def raw_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.raw_name_map(noisy_mentions(spark, sf_dir))


@query(CANON + "SELECT s.ord, s.type, s.raw AS name, c.canonical FROM s JOIN c USING (type, surface)")
def remap_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve_entities(noisy_mentions(spark, sf_dir)).select("ord", "type", "name", "canonical")


@query(CANON + "SELECT DISTINCT s.type, c.canonical, s.raw AS alias FROM s JOIN c USING (type, surface)")
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.entity_aliases(noisy_mentions(spark, sf_dir))


@query(CANON + """SELECT source, target, relation_type, count(*)::BIGINT AS n FROM (
  SELECT s_name AS source, coalesce(raw.canonical, x.name) AS target, 'SUPPLIES' AS relation_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN m x ON x.ord = l_partkey LEFT JOIN raw ON raw.raw = x.name)
GROUP BY ALL""")
def remap_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = noisy_mentions(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rel = lines.join(m.select("ord", F.col("name").alias("target")), F.col("l_partkey") == F.col("ord")).select(F.col("s_name").alias("source"), "target", F.lit(" supplies ").alias("relation_type"))
    return resolution.resolve_relations(rel, resolution.raw_name_map(m)).groupBy("source", "target", "relation_type").agg(F.count(F.lit(1)).alias("n"))


@query(CANON + "SELECT count(*)::BIGINT AS mentions, count(DISTINCT canonical)::BIGINT AS canonical_entities, (count(*) - count(DISTINCT canonical))::BIGINT AS aliases_merged FROM s JOIN c USING (type, surface)")
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolution_report(noisy_mentions(spark, sf_dir))


@query(f"WITH m AS ({NOISY}), a AS (SELECT ord, trim(name) AS name, {SURFACE.format('name')} AS surface FROM m) SELECT surface, arg_min(name, ord) AS name FROM a WHERE surface <> '' GROUP BY surface")
def claim_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = noisy_mentions(spark, sf_dir)
    return claims.alias_lookup(m.select("ord", F.trim("name").alias("name"), F.col("name").alias("alias")))


def event_claims(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    """Events as claims, those of one id not yet merged; names(ord, name, alias)."""
    e = table(spark, sf_dir, "events")
    padded = lambda x: F.lpad(x.cast("string"), 9, "0")
    k = F.col("event_id")
    raw = e.select(
        k.alias("ord"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("chunk_id"), F.concat(F.lit("CUSTOMER#"), padded(F.col("user_id"))).alias("subject"),
        F.when(k % 2 == 0, F.concat(F.lit("Customer "), padded(F.col("user_id") + 1))).otherwise(F.concat(F.lit("page "), F.col("user_id").cast("string"))).alias("object"),
        F.lit("FACT").alias("type"), F.when(k % 3 == 0, "true").when(k % 3 == 1, "odd").alias("status"), F.col("event_type").alias("description"))
    return claims.resolve(raw, claims.alias_lookup(names)).withColumn("id", F.concat_ws("|", "text_unit_id", "subject_id", "object_id", "description"))


@query(r"""WITH names AS (SELECT lower(c_name) AS key, c_name AS name FROM customer), surf AS (SELECT trim(regexp_replace(key, '[^\p{L}\p{N}_\s]', ' ', 'g')) AS surface, name FROM names),
c AS (SELECT event_id AS ord, 'user_' || user_id AS chunk_id, 'CUSTOMER#' || lpad(user_id::VARCHAR, 9, '0') AS subject,
  CASE WHEN event_id % 2 = 0 THEN 'Customer ' || lpad((user_id + 1)::VARCHAR, 9, '0') ELSE 'page ' || user_id END AS object, event_type, CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'odd' ELSE NULL END AS status FROM events),
j AS (SELECT ord, chunk_id, s.name AS subject_id, coalesce(o.name, c.object) AS object_id, event_type, CASE WHEN status = 'true' THEN 'TRUE' ELSE 'UNKNOWN' END AS status
  FROM c JOIN surf s ON s.surface = regexp_replace(lower(c.subject), '[^\p{L}\p{N}_\s]', ' ', 'g') LEFT JOIN surf o ON o.surface = lower(c.object))
SELECT chunk_id || '|' || subject_id || '|' || object_id || '|' || event_type AS id, arg_max(status, ord) AS status, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def claim_resolve_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims about customers; a claim that comes again replaces the one before."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_name").alias("alias"))
    c = event_claims(spark, sf_dir, names)
    last = claims.dedupe(c.select("id", "ord", "status"))
    return last.join(c.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id").select("id", "status", "n")
