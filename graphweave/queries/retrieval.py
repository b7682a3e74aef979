"""Queries on vectors, query modes and evaluation."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import vectors
from ..functions.text import normalize_question
from ..functions.vectors import hash_embedding
from ..operators import budget, chunking, claims, extract, graph, retrieve
from ..plans import evaluate, indexing, modes
from ..plans.providers import CannedProvider
from ..sources.index_store import IndexStore
from ..sources.scratch import save, settle, shared_dir, spread
from ..sources.table_graph import entity_mentions, relation_mentions
from .base import GRAPH, ORACLE, QUERIES, entities, longs, query, relations, table
from .text import event_claims

BULK = replace(EngineConfig(), max_documents=None, max_characters=None)
COSINE = "CASE WHEN sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) > 0 THEN list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) ELSE 0.0 END"
SCORED = f"WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round({COSINE.format('embedding::DOUBLE[]', 'qv')}, 6) AS score FROM embeddings, q)"


def question_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.lit(0).alias("question_id"), F.col("embedding").alias("question"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieve.score(table(spark, sf_dir, "embeddings"), question_vector(spark, sf_dir), "embedding")
    return s.withColumn("score", F.round("score", 6))


@query(SCORED.replace(", 6) AS score", ", 9) AS score") + " SELECT row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieve.rank_named(table(spark, sf_dir, "embeddings"), question_vector(spark, sf_dir), 10, "vec_id", "embedding")
    return longs(got, "rank").select("rank", "vec_id", F.round("score", 6).alias("score"))


@query(SCORED + " SELECT label, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score FROM s QUALIFY rank <= 5")
def cosine_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(retrieve.rank_top(scored(spark, sf_dir), 5, "vec_id", by=("label",)), "rank").select("label", "rank", "vec_id", "score")


@query(SCORED + ", t AS (SELECT vec_id, round(score, 1) AS score FROM s) SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC)::BIGINT AS rank, vec_id FROM t QUALIFY rank <= 20")
def similarity_reverse_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other order of ties: the later vector first."""
    return longs(retrieve.rank_top(scored(spark, sf_dir), 20, F.desc("vec_id"), digits=1), "rank").select("rank", "vec_id")


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), z AS (SELECT vec_id, CASE WHEN label = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 0) ELSE embedding::DOUBLE[] END AS v FROM embeddings) SELECT vec_id, round({COSINE.format('v', 'qv')}, 6) AS score FROM z, q")
def zero_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("v", F.when(F.col("label") == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return retrieve.score(v, question_vector(spark, sf_dir), "v").select("vec_id", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws || CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || '::' || ws[i + 1]) ELSE [] END) AS f FROM w)
SELECT doc_id, (concat('0x', substr(sha256(f), 1, 8))::BIGINT % 256)::BIGINT AS dim, sum(CASE WHEN concat('0x', substr(sha256(f), 9, 1))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS value FROM f GROUP BY ALL""")
def sha_feature_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature hashing: sums by document and dimension."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.inline(vectors.sha_sums(F.col("text"), 256)))
    return d.groupBy("doc_id", "dim").agg(F.sum("value").alias("value"))


@query()
def blake_feature_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(hash_embedding(F.col("text"), 256)).alias("dim", "value"))
    return v.filter("value <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 5).cast("double").alias("value"))


@query()
def basic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in chunks, embedded; the five nearest chunks to each benchmark item."""
    chunks = save(chunking.chunk_documents(table(spark, sf_dir, "documents"), BULK))
    keyed = chunks.select(F.col("chunk_id").alias("key"), hash_embedding(F.col("text"), 256).alias("vector"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), hash_embedding(F.col("text"), 256).alias("question"))
    return longs(retrieve.rank_named(keyed, q, 5), "rank").select("question_id", "rank", F.col("key").alias("chunk_id"), F.round("score", 5).alias("score"))


LOCAL = """, seeds AS (SELECT r_name AS q, r_name AS name FROM region), w AS (SELECT u AS a, v AS b FROM u UNION SELECT v, u FROM u),
n1 AS (SELECT q, name FROM seeds UNION SELECT q, w.b FROM seeds JOIN w ON w.a = seeds.name), n AS (SELECT q, name FROM n1 UNION SELECT q, w.b FROM n1 JOIN w ON w.a = n1.name)
"""


def local_names(spark: SparkSession, sf_dir: str, r: DataFrame | None = None) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("q"), F.col("r_name").alias("name"))
    return seeds.unionByName(graph.neighbors(seeds, graph.undirected(r if r is not None else relations(spark, sf_dir)), 1, by=("q",)).select("q", "name")).distinct()


@query(GRAPH + LOCAL + "SELECT q, 'entity' AS kind, name AS id FROM n1 UNION ALL SELECT a.q, 'relation', source || '>' || relation_type || '>' || target FROM r JOIN n1 a ON a.name = source JOIN n1 b ON b.name = target AND b.q = a.q")
def local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around each region: entities, and relations with both ends among them."""
    r = relations(spark, sf_dir, True)
    names = save(local_names(spark, sf_dir, r))
    rel = graph.induced(r, names, by=("q",))
    return names.select("q", F.lit("entity").alias("kind"), F.col("name").alias("id")).unionByName(
        rel.select("q", F.lit("relation").alias("kind"), F.concat_ws(">", "source", "relation_type", "target").alias("id")))


@query("""WITH c AS (SELECT event_id AS id, 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS subject_id, 'Customer#' || lpad((user_id + 7)::VARCHAR, 9, '0') AS object_id FROM events),
n AS (SELECT c_nationkey AS q, c_name AS name FROM customer) SELECT DISTINCT q::BIGINT AS question_id, id FROM (SELECT q, id FROM c JOIN n ON name = subject_id UNION ALL SELECT q, id FROM c JOIN n ON name = object_id)""")
def local_claims_or_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about the customers of each nation, as subject or object, each once."""
    name = lambda x: F.concat(F.lit("Customer#"), F.lpad(x.cast("string"), 9, "0"))
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), name(F.col("user_id")).alias("subject_id"), name(F.col("user_id") + 7).alias("object_id"))
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("question_id"), F.col("c_name").alias("name"))
    return modes.claims_about(c, n).select("question_id", "id")


@query(GRAPH + LOCAL + f""", k AS (SELECT DISTINCT q, chunk_id FROM n JOIN em USING (name)), v AS (SELECT 'customer_' || vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT r_name AS q, embedding::DOUBLE[] AS qv FROM region JOIN embeddings ON vec_id = r_regionkey), s AS (SELECT q, chunk_id, round({COSINE.format('v', 'qv')}, 6) AS score FROM k JOIN v USING (chunk_id) JOIN q USING (q))
SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id)::BIGINT AS rank, score FROM s QUALIFY rank <= 12""")
def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of the entities within two hops of each region, the nearest twelve; customers' rows have vectors."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("q"), F.col("r_name").alias("name"))
    around = graph.neighbors(seeds, graph.undirected(relations(spark, sf_dir, True)), 2, by=("q",)).select("q", "name")
    names = seeds.unionByName(around).distinct().withColumnRenamed("q", "question_id")
    v = table(spark, sf_dir, "embeddings")
    vectors = v.select(F.concat(F.lit("customer_"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vector"))
    q = table(spark, sf_dir, "region").join(v, F.col("vec_id") == F.col("r_regionkey")).select(F.col("r_name").alias("question_id"), F.col("embedding").alias("question"))
    pairs = modes.evidence_of(names, entity_mentions(spark, sf_dir).select("name", "chunk_id"))
    best = retrieve.rank_top(retrieve.score_pairs(pairs, vectors, q).withColumn("score", F.round("score", 6)), 12, "key")
    return longs(best, "rank").select(F.col("question_id").alias("q"), F.col("key").alias("chunk_id"), "rank", "score")


@query(f"""WITH c AS (SELECT vec_id, label % 3 AS level, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 9), q AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
l AS (SELECT coalesce(max(level) FILTER (level <= 1), min(level), 0) AS level FROM c), s AS (SELECT question_id, vec_id, c.level, round({COSINE.format('v', 'qv')}, 9) AS score FROM c JOIN l USING (level), q)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, level::BIGINT AS level, round(score, 6) AS score FROM s QUALIFY rank <= 24""")
def community_reports_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the chosen level, nearest first, for every twentieth vector as question; vectors stand for reports,
    labels for levels, and those of one label are blank."""
    v = table(spark, sf_dir, "embeddings")
    own = v.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("level"), F.when(F.col("label") != 9, "report").otherwise(" ").alias("summary"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    got = modes.ranked_reports(own, v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), q, 1, 24)
    return longs(got, "rank", "level").select("question_id", "rank", F.col("id").alias("vec_id"), "level", F.round("score", 6).alias("score"))


ANSWERS = """SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'no list, ' || event_type ELSE
  '{"points": [{"description": "' || event_type || '", "score": ' || (value * 3)::DECIMAL(12, 2) || '}, {"description": " ", "score": 5}]}' END AS response FROM events"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event, some of them plain text."""
    e = table(spark, sf_dir, "events")
    listed = F.concat(F.lit('{"points": [{"description": "'), "event_type", F.lit('", "score": '), (F.col("value") * 3).cast("decimal(12,2)").cast("string"), F.lit('}, {"description": " ", "score": 5}]}'))
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no list, "), "event_type")).otherwise(listed).alias("response"))


@query(f"""WITH a AS ({ANSWERS}), p AS (SELECT event_id, user_id, CASE WHEN response LIKE '{{%' THEN json_extract_string(response, '$.points[0].description') ELSE response END AS description,
  CASE WHEN response LIKE '{{%' THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, json_extract_string(response, '$.points[0].score')::DOUBLE)) ELSE 1.0::DOUBLE END AS score FROM a)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, description, event_id)::BIGINT AS rank, event_id, description, score FROM p WHERE score > 0""")
def global_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points out of answers, ranked for each user."""
    p = modes.parse_points(answers(spark, sf_dir)).filter("score > 0")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "description", "event_id")
    return p.select("user_id", F.row_number().over(w).cast("long").alias("rank"), "event_id", "description", "score")


@query("""WITH k AS (SELECT user_id AS question_id, event_id AS rank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT question_id, rank, (i % least(3, n))::BIGINT AS fold FROM k""")
def drift_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events dealt round about."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("rank"))
    return longs(modes.folds(e, 3), "fold")


QUERIES["drift_folds_whole"], ORACLE["drift_folds_whole"] = drift_folds, ORACLE["drift_folds"]


FOLLOWUPS = """WITH j AS (SELECT user_id AS question_id, event_id, event_type, value FROM events), c AS (SELECT question_id, event_id || '_0' AS id, event_type || ' of ' || (event_id % 4) || '?' AS question, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value)) AS score FROM j
  UNION ALL SELECT question_id, event_id || '_1', upper(event_type) || '  of ' || (event_id % 3), 50.0 FROM j),
m AS (SELECT *, regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[?.! ]+$', '') AS norm FROM c),
n AS (SELECT * FROM m WHERE norm <> 'click of 1' QUALIFY row_number() OVER (PARTITION BY question_id, norm ORDER BY score DESC, question, id) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, question, id)::BIGINT AS place FROM n)
"""


def answers_with_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = lambda k: (F.col("event_id") % k).cast("string")
    text = F.concat(
        F.lit('{"answer": "a", "follow_ups": [{"question": "'), "event_type", F.lit(" of "), n(4), F.lit('?", "score": '), F.col("value").cast("string"), F.lit('}, {"question": "'),
        F.upper("event_type"), F.lit("  of "), n(3), F.lit('", "score": 50}, {"question": ""}]}'))
    return e.select(F.col("user_id").alias("question_id"), "event_id", text.alias("response"))


def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.parse_followups(answers_with_followups(spark, sf_dir), F.col("event_id").cast("string"), F.lit(1), F.lit(None))


@query(FOLLOWUPS + "SELECT question_id, place, id, question, score FROM f WHERE place <= 3")
def drift_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New follow-ups of each user, the three best; one wording was seen before."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), normalize_question(F.lit("Click  of 1?")).alias("norm")).distinct()
    best, _ = modes.frontier(followups(spark, sf_dir), seen, 3)
    return longs(best, "place").select("question_id", "place", "id", "question", "score")


@query(FOLLOWUPS + "SELECT question_id, norm FROM n")
def drift_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that was new counts as seen from then on, also what the cut left out."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.lit("click of 1").alias("norm")).distinct()
    return modes.frontier(followups(spark, sf_dir), seen, 3)[1]


@query("""WITH j AS (SELECT user_id AS question_id, event_id, event_type, value FROM events WHERE event_id % 100 / 100.0::DOUBLE >= 0.35)
SELECT question_id, event_id || '_q_0' AS id, event_type || ' of ' || (event_id % 4) || '?' AS question, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value)) AS score, (2 + event_id % 2)::BIGINT AS depth, event_id::VARCHAR AS parent_id FROM j
UNION ALL SELECT question_id, event_id || '_q_1', upper(event_type) || '  of ' || (event_id % 3), 50.0, (2 + event_id % 2)::BIGINT, event_id::VARCHAR FROM j""")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only answers that are sure enough lead further; some are exactly at the gate."""
    rows = answers_with_followups(spark, sf_dir).withColumns({"id": F.col("event_id").cast("string"), "depth": (1 + F.col("event_id") % 2).cast("int"), "confidence": F.col("event_id") % 100 / 100.0})
    return longs(modes.expansions(rows, EngineConfig().drift_confidence_gate), "depth").select("question_id", "id", "question", "score", "depth", "parent_id")


@query(r"""WITH e AS (SELECT user_id, event_id AS id, event_id % 10 / 10.0::DOUBLE AS confidence, event_id % 2 AS depth, len(regexp_extract_all(event_type || ' ' || props, '\s*(?:[\p{L}\p{N}_]+|[^\s])')) AS n FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, depth, id) AS rank FROM e), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT user_id, rank::BIGINT AS rank, id, least(n, 100 - before)::BIGINT AS used FROM s WHERE before < 100""")
def drift_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each user by confidence, depth and id, within a budget."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 10 / 10.0).alias("confidence"), (F.col("event_id") % 2).alias("depth"), F.concat_ws(" ", "event_type", "props").alias("text"))
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("confidence"), "depth", "id")))
    return longs(budget.select_within(ranked, 100, ["user_id"]), "rank", "used").select("user_id", "rank", "id", "used")


CASES = """WITH x AS (SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 3 = 0)) AS want, list_distinct(list(event_type) FILTER (event_id % 5 = 0)) AS got, string_agg(event_type, ' ' ORDER BY event_id) FILTER (event_id % 11 = 0) AS said FROM events GROUP BY user_id),
m AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'basic' ELSE 'drift' END AS mode, coalesce(want, []) AS want, coalesce(got, []) AS got, coalesce(said, '') AS said FROM x),
r AS (SELECT user_id, mode, CASE WHEN len(want) > 0 THEN len(list_intersect(want, got))::DOUBLE / len(want) ELSE 1.0 END AS recall,
  len(list_filter(['CLICK', 'view', 'view', 'nothing'], lambda t: contains(lower(said), lower(t))))::DOUBLE / 4 AS coverage FROM m)
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases: what they should have found, what they found, what was said."""
    e = table(spark, sf_dir, "events")
    some = lambda k: F.collect_set(F.when(F.col("event_id") % k == 0, F.col("event_type")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id") % 11 == 0, F.struct("event_id", "event_type")))), lambda x: x["event_type"]), " ")
    return e.groupBy("user_id").agg(some(3).alias("want"), some(5).alias("got"), said.alias("said")).select(
        "user_id", F.when(F.col("user_id") % 2 == 0, "basic").otherwise("drift").alias("mode"),
        evaluate.source_recall(F.col("want"), F.col("got")).alias("recall"),
        evaluate.answer_term_coverage(F.array(*map(F.lit, ("CLICK", "view", "view", "nothing"))), F.col("said")).alias("coverage"))


@query(CASES + "SELECT user_id, mode, round(recall, 6) AS recall FROM r")
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("user_id", "mode", F.round("recall", 6).alias("recall"))


@query(CASES + "SELECT user_id, mode, round(coverage, 6) AS coverage FROM r")
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("user_id", "mode", F.round("coverage", 6).alias("coverage"))


@query(CASES + """SELECT mode, count(*)::BIGINT AS cases, round(avg(CASE WHEN user_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate, round(avg(recall), 6) AS avg_source_recall, round(avg(coverage), 6) AS avg_answer_term_coverage,
  avg(user_id::DOUBLE) AS avg_latency_ms, avg(CASE WHEN mode = 'drift' THEN (user_id % 4)::DOUBLE END) AS avg_drift_actions FROM r GROUP BY mode""")
def eval_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cases(spark, sf_dir).select(
        "mode", (F.col("user_id") % 3 > 0).alias("success"), F.col("recall").alias("source_recall"), F.col("coverage").alias("answer_term_coverage"), F.col("user_id").cast("double").alias("latency_ms"),
        F.when(F.col("mode") == "drift", F.col("user_id") % 4).alias("drift_actions"))
    return evaluate.by_mode(r).withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_source_recall", "avg_answer_term_coverage")})


@query(GRAPH + """, k AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name) AS rank FROM e)
SELECT type AS question_id, 'entity' AS type, name AS id, rank::BIGINT AS rank, substr(type || ' ' || name, 1, 12) AS text FROM k""")
def source_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as the sources of an answer, by name, their texts cut; types stand for questions."""
    e = entities(spark, sf_dir).withColumn("question_id", F.col("type"))
    return modes.as_sources(modes.numbered(e, "name"), "entity", "name", "r", F.concat_ws(" ", F.col("question_id"), "name"), 12)


@query("""WITH e AS (SELECT user_id AS q, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
t AS (SELECT q, 0 AS g, i AS o, 'chunk_' || (id % 50) AS id FROM e WHERE id % 3 = 0), s AS (SELECT q, 1 AS g, i AS o, 'entity:' || event_type AS id FROM e WHERE id % 3 = 1),
c AS (SELECT q, 2 AS g, row_number() OVER (PARTITION BY q ORDER BY id) AS o, id FROM (SELECT q, 'claim_' || id AS id FROM e WHERE id % 3 = 2)), r AS (SELECT q, 0 AS g, i AS o, 'L0_C' || (id % 9) AS id FROM e WHERE id % 2 = 0),
v AS (SELECT q, 1 AS g, (id % 2) * 1000000000000 + i * 10 + x.n AS o, CASE x.n WHEN 0 THEN 'chunk_' || (id % 50) ELSE 'L0_C' || (id % 9) END AS id FROM e, (VALUES (0), (1)) x(n)),
m AS (SELECT 'basic' AS mode, * FROM t UNION ALL SELECT 'local', * FROM t UNION ALL SELECT 'local', * FROM s UNION ALL SELECT 'local', * FROM c UNION ALL SELECT 'global', * FROM r UNION ALL SELECT 'drift', * FROM r UNION ALL SELECT 'drift', * FROM v),
f AS (SELECT mode, q, id, min(g * 1000000000000000 + o) AS place FROM m GROUP BY ALL)
SELECT mode, q AS question_id, string_agg(id, ',' ORDER BY place) AS source_ids FROM f GROUP BY mode, q""")
def eval_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers of each mode rest on, in order and each once; a user's events stand for what was found for a question."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w)).withColumnRenamed("user_id", "question_id")
    k = F.col("event_id")
    chunk, report = F.concat(F.lit("chunk_"), (k % 50).cast("string")), F.concat(F.lit("L0_C"), (k % 9).cast("string"))
    details = {
        "text_units": e.filter("event_id % 3 = 0").select("question_id", F.col("i").alias("rank"), chunk.alias("key")), "seeds": e.filter("event_id % 3 = 1").select("question_id", F.col("i").alias("rank"), F.col("event_type").alias("name")),
        "claims": e.filter("event_id % 3 = 2").select("question_id", F.concat(F.lit("claim_"), k.cast("string")).alias("id")), "reports": e.filter("event_id % 2 = 0").select("question_id", F.col("i").alias("rank"), report.alias("id")),
        "evidence": e.select("question_id", (k % 2).alias("depth"), F.col("i").alias("place"), F.array(chunk, report).alias("source_ids")),
    }
    rows = [modes.source_ids(details, mode).select(F.lit(mode).alias("mode"), "question_id", F.array_join("source_ids", ",").alias("source_ids")) for mode in modes.MODES]
    return reduce(DataFrame.unionByName, rows)


def noisy_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as answers of a provider: plain, fenced, wrapped in prose, broken, or with a dangling end."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    target = F.when(F.col("l_linenumber") == 5, "nobody").otherwise(F.col("p_name"))
    doc = F.to_json(F.struct(
        F.array(*[F.struct(n.alias("name"), F.lit(k).alias("type"), F.col("p_type").alias("description")) for n, k in ((F.col("s_name"), "SUPPLIER"), (F.col("p_name"), "PART"))]).alias("entities"),
        F.array(F.struct(F.col("s_name").alias("source"), target.alias("target"), F.lit("SUPPLIES").alias("relation_type"), F.col("p_brand").alias("description"))).alias("relations")))
    k = F.col("l_linenumber")
    text = F.when(k == 2, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(k == 3, F.concat(F.lit("Here it is: "), doc, F.lit(" Anything else?"))).when(k == 4, F.substring(doc, 1, 20)).otherwise(doc)
    return rows.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"), text.alias("response"))


@query("""SELECT s_name AS source, p_name AS target, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber NOT IN (4, 5) GROUP BY ALL""")
def json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that survive parsing and checks of noisy answers."""
    _, r = extract.mentions(noisy_responses(spark, sf_dir))
    return r.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT name, type, count(*)::BIGINT AS n FROM (SELECT s_name AS name, 'SUPPLIER' AS type, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
UNION ALL SELECT p_name, 'PART', l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE l_linenumber NOT IN (4, 5) GROUP BY ALL""")
def extraction_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = extract.mentions(noisy_responses(spark, sf_dir))
    return e.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))


@query(GRAPH + "SELECT 'entities' AS name, name AS id, mention_count AS n FROM e UNION ALL SELECT 'relations', source || '>' || relation_type || '>' || target, mention_count FROM r")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, listed and read again, row for row."""
    import uuid

    store, name = IndexStore(spark, f"{shared_dir(spark)}/indexes"), f"table-graph-{uuid.uuid4().hex}"
    store.save(name, {"entities": entities(spark, sf_dir), "relations": relations(spark, sf_dir)})
    if name not in store.list():
        raise RuntimeError("a saved index is not listed")
    t = store.load(name)
    r = t["relations"].select(F.lit("relations").alias("name"), F.concat_ws(">", "source", "relation_type", "target").alias("id"), F.col("mention_count").alias("n"))
    out = settle(lambda: t["entities"].select(F.lit("entities").alias("name"), F.col("name").alias("id"), F.col("mention_count").alias("n")).unionByName(r))
    store.delete(name)
    return out


def table_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The documents as text units, and the whole table graph with its evidence and claims."""
    mentions = entity_mentions(spark, sf_dir)
    e = save(entities(spark, sf_dir).withColumn("description", F.col("type")))
    # Nothing that asks this index looks at how often, or in how many orders, a relation is mentioned.
    r = save(graph.merge_weights(relation_mentions(spark, sf_dir), e).withColumn("description", F.col("relation_type")))
    units = save(chunking.chunk_documents(table(spark, sf_dir, "documents"), BULK))
    # An entity stands in all chunks of the documents with its customer's, supplier's or parts' numbers.
    number = F.regexp_extract("chunk_id", r"^(?:customer|supplier|part)_(\d+)$", 1).try_cast("long")
    rows = mentions.select("name", number.alias("doc_id")).filter("doc_id is not null").distinct()
    where = save(rows.join(units.select("doc_id", "chunk_id"), "doc_id").select("name", "chunk_id").distinct())
    found = claims.dedupe(event_claims(spark, sf_dir, mentions.select("ord", "name", F.col("name").alias("alias"))).drop("raw_type"))
    return {"text_units": units, "entities": e, "relations": r, "entity_chunks": where, "claims": save(found)}


#: Modes that look at communities and their reports; the others get an index without these.
OF_REPORTS = ("global", "drift")


def table_index(spark: SparkSession, sf_dir: str, mode: str = "global") -> indexing.Index:
    """An index over the documents (as text units) and the whole table graph, with all tables that the mode looks at."""
    from ..operators import community, reports

    tables = table_graph(spark, sf_dir)
    if mode not in OF_REPORTS:
        tables["vectors"] = save(indexing.embed(tables | {"reports": no_reports(spark)}, BULK))
        return indexing.Index(tables, BULK)
    tables["communities"] = c = community.hierarchy(tables["entities"], graph.undirected(tables["relations"]), BULK)
    tables["reports"] = reports.reports(c, tables["entities"], tables["relations"], CannedProvider({}))
    tables["vectors"] = save(indexing.embed(tables, BULK))
    return indexing.Index(tables, BULK)


def no_reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, level int, parent_id string, summary string, size bigint")


def _mode(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Who is located in "), "n_name", F.lit("?")).alias("query"))
    got = modes.query(table_index(spark, sf_dir, mode), q, mode)
    return longs(got.sources, "rank").join(got.answers, "question_id").select("question_id", "type", "id", "rank", "answer")


@query()
def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each nation: sources and answer."""
    return _mode(spark, sf_dir, "local")


@query()
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "global")


@query()
def drift_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "drift")
