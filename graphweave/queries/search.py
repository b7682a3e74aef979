"""The four query modes over an index that SQL can follow: SHA feature vectors, regions and nations as communities."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import extract, graph, reports
from ..plans import evaluate, indexing, modes, prompts
from ..plans.embedding import ShaEmbedder
from ..plans.providers import OFFLINE_ANSWER, OFFLINE_ANSWERS, CannedProvider, Provider, ask, lines_of
from ..sources.scratch import save, settle
from ..sources.table_graph import entity_mentions, relation_mentions
from .base import GRAPH, entities, longs, query, relations, table
from .retrieval import BULK, OF_REPORTS, no_reports, table_graph
from .text import CHUNKS, TOKENS, chunking, noisy_mentions

SAID = dict(OFFLINE_ANSWERS)
CONFIG = EngineConfig()
EMBEDDER = ShaEmbedder(CONFIG.embedding_dimension)


def vectors_sql(name: str, rows: str) -> str:
    """CTEs {name}_v(key, dim, v) and {name}_n(key, n: the length, 0 without words) of rows(key, text)."""
    return rf"""{name}_t AS ({rows}), {name}_w AS (SELECT key, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM {name}_t),
{name}_f AS (SELECT key, unnest(ws || CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || '::' || ws[i + 1]) ELSE [] END) AS f FROM {name}_w),
{name}_c AS (SELECT key, f, count(*) AS n FROM {name}_f GROUP BY ALL), {name}_u AS (SELECT f, sha256(f) AS h FROM (SELECT DISTINCT f FROM {name}_c)),
{name}_v AS (SELECT key, concat('0x', substr(h, 1, 8))::BIGINT % 256 AS dim, sum(CASE WHEN concat('0x', substr(h, 9, 1))::BIGINT % 2 = 1 THEN n ELSE -n END)::DOUBLE AS v FROM {name}_c JOIN {name}_u USING (f) GROUP BY ALL),
{name}_n AS (SELECT t.key, coalesce(sqrt(sum(v * v)), 0) AS n FROM {name}_t t LEFT JOIN {name}_v USING (key) GROUP BY t.key)"""


def scores_sql(a: str, b: str, pairs: str) -> str:
    """Rows (a, b, score) for pairs(a, b) of keys."""
    return f"""SELECT p.a, p.b, round(CASE WHEN an.n * bn.n > 0 THEN coalesce(sum(x.v * y.v), 0) / (an.n * bn.n) ELSE 0.0::DOUBLE END, 9) AS score
FROM ({pairs}) p JOIN {a}_n an ON an.key = p.a JOIN {b}_n bn ON bn.key = p.b LEFT JOIN {a}_v x ON x.key = p.a LEFT JOIN {b}_v y ON y.key = p.b AND y.dim = x.dim GROUP BY p.a, p.b, an.n, bn.n"""


UNITS = CHUNKS + ", units AS (SELECT doc_id, doc_id || '_chunk_' || chunk_index AS key, text FROM chunks)"


@query(UNITS + ", " + vectors_sql("q", "SELECT item_id AS key, text FROM benchmark") + ", " + vectors_sql("c", "SELECT key, text FROM units") + f""",
s AS ({scores_sql('q', 'c', 'SELECT q.key AS a, c.key AS b FROM q_t q, c_t c')}), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s)
SELECT a AS question_id, 'text_unit' AS type, b AS id, rank::BIGINT AS rank, substr(text, 1, 240) AS text, '{OFFLINE_ANSWER}' AS answer FROM r JOIN units ON key = b WHERE rank <= 5""")
def basic_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all chunks to every benchmark item, and the answer."""
    units = save(chunking.chunk_documents(table(spark, sf_dir, "documents"), BULK))
    vectors = save(units.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), EMBEDDER.embed(F.col("text")).alias("vector")))
    index = indexing.Index({"text_units": units, "vectors": vectors}, BULK, EMBEDDER)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    return settle(lambda: shown(modes.query(index, q, "basic")))


def shown(got: modes.Answer) -> DataFrame:
    return got.sources.join(got.answers, "question_id").select("question_id", "type", "id", "rank", "text", "answer")


def place_members(spark: SparkSession, sf_dir: str, relations_: DataFrame) -> DataFrame:
    """Regions (level 0) and nations (level 1) as communities: (id, level, parent_id, size, name), saved."""
    nation, r = table(spark, sf_dir, "nation"), relations_.filter("relation_type = 'LOCATED_IN'")
    inside = r.join(nation, F.col("target") == F.col("n_name")).select(F.col("source").alias("name"), "n_nationkey", "n_regionkey").unionByName(nation.select(F.col("n_name").alias("name"), "n_nationkey", "n_regionkey")).distinct()
    tag = lambda level, k: F.concat(F.lit(f"L{level}_C"), F.col(k).cast("string"))
    low = inside.select(tag(1, "n_nationkey").alias("id"), F.lit(1).alias("level"), tag(0, "n_regionkey").alias("parent_id"), "name")
    high = inside.select(tag(0, "n_regionkey").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), "name")
    high = high.unionByName(table(spark, sf_dir, "region").select(tag(0, "r_regionkey").alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")))
    members = high.unionByName(low).distinct()
    size = members.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    return save(members.join(size, "id").select("id", "level", "parent_id", "size", "name"))


def place_index(spark: SparkSession, sf_dir: str, provider: Provider = CannedProvider({}), config: EngineConfig = BULK, mode: str = "global") -> indexing.Index:
    """The table graph with places as communities, whose reports the provider writes if the mode looks at them."""
    tables = table_graph(spark, sf_dir)
    if mode not in OF_REPORTS:
        tables["vectors"] = save(indexing.embed(tables | {"reports": no_reports(spark)}, config, EMBEDDER))
        return indexing.Index(tables, config, EMBEDDER)
    tables["communities"] = c = place_members(spark, sf_dir, tables["relations"])
    tables["reports"] = reports.reports(c, tables["entities"], tables["relations"], provider)
    tables["vectors"] = save(indexing.embed(tables, config, EMBEDDER))
    return indexing.Index(tables, config, EMBEDDER)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("question_id"), F.concat(F.lit("Who is located in "), "n_name", F.lit("?")).alias("query"))


QUESTIONS = "SELECT n_nationkey::BIGINT AS key, 'Who is located in ' || n_name || '?' AS text FROM nation"
#: seeds, names around them, evidence (cut to the budget) and claims of each question in q_t.
LOCAL = GRAPH + ", " + UNITS.replace("WITH RECURSIVE ", "", 1) + r""", {questions}, """ + vectors_sql("e", "SELECT name AS key, name || ': ' || type AS text FROM e") + f""",
es AS ({scores_sql('q', 'e', 'SELECT q.key AS a, e.key AS b FROM q_t q, e_t e')}), seeds AS (SELECT a AS q, b AS name, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM es QUALIFY rank <= 5),
w AS (SELECT u AS a, v AS b FROM u UNION SELECT v, u FROM u), names AS (SELECT q, name FROM seeds UNION SELECT q, w.b FROM seeds JOIN w ON w.a = seeds.name),
ec AS (SELECT DISTINCT name, key FROM (SELECT name, TRY_CAST(regexp_extract(chunk_id, '^(?:customer|supplier|part)_(\\d+)$', 1) AS BIGINT) AS doc_id FROM em) JOIN units USING (doc_id)),
ev AS (SELECT DISTINCT q AS a, key AS b FROM names JOIN ec USING (name)), """ + vectors_sql("c", "SELECT key, text FROM units WHERE key IN (SELECT b FROM ev)") + f""",
cs AS ({scores_sql('q', 'c', 'SELECT a, b FROM ev')}), cr AS (SELECT a AS q, b AS key, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS rank FROM cs QUALIFY rank <= 12),
ct AS (SELECT cr.*, text, {TOKENS} AS n FROM cr JOIN units USING (key)), cb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ct),
""" + r"""packed AS (SELECT q, key, rank, CASE WHEN n > {budget} - before THEN array_to_string(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\s])')[1 : ({budget} - before)::BIGINT], '') ELSE text END AS text FROM cb WHERE before < {budget}),
surf AS (SELECT arg_min(name, ord) AS name, surface FROM (SELECT ord, name, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS surface FROM em) WHERE surface <> '' GROUP BY surface),
cl AS (SELECT DISTINCT chunk_id || '|' || s.name || '|' || coalesce(o.name, object) || '|' || event_type AS id, s.name AS subject_id, coalesce(o.name, object) AS object_id, event_type AS description FROM
  (SELECT 'user_' || user_id AS chunk_id, 'customer ' || lpad(user_id::VARCHAR, 9, '0') AS subject, CASE WHEN event_id % 2 = 0 THEN 'Customer ' || lpad((user_id + 1)::VARCHAR, 9, '0') ELSE 'page ' || user_id END AS object, event_type FROM events)
  JOIN surf s ON s.surface = subject LEFT JOIN surf o ON o.surface = lower(object)),
about AS (SELECT DISTINCT q, cl.* FROM cl JOIN names ON name = subject_id UNION SELECT DISTINCT q, cl.* FROM cl JOIN names ON name = object_id)
"""


def local_sql(questions: str, budget: int) -> str:
    return LOCAL.replace("{questions}", vectors_sql("q", questions)).replace("{budget}", str(budget))


@query(local_sql(QUESTIONS, CONFIG.local_tokens) + f""", x AS (SELECT q, 'text_unit' AS type, key AS id, rank, substr(text, 1, 240) AS text FROM packed
UNION ALL SELECT q, 'entity', name, row_number() OVER (PARTITION BY q ORDER BY name) AS r, e.type FROM names JOIN e USING (name) QUALIFY r <= 5
UNION ALL SELECT q, 'claim', id, row_number() OVER (PARTITION BY q ORDER BY id), substr(description, 1, 240) FROM about)
SELECT q AS question_id, type, id, rank::BIGINT AS rank, text, '{OFFLINE_ANSWER}' AS answer FROM x""")
def local_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each nation: seeds, what is around them, evidence within the budget, claims, and the answer."""
    return settle(lambda: shown(modes.query(place_index(spark, sf_dir, mode="local"), asked(spark, sf_dir), "local")))


class Citer:
    """A provider that reads its prompt: how many entities it shows with a type, and the ids of claims and texts in order."""

    name = "citer"

    def complete(self, task: str, prompt: str) -> str:
        return self.read(task, [prompt])

    def read(self, task: str, pieces: Iterable[str]) -> str:
        typed, ids, section = 0, ([], []), ""
        for line in lines_of(pieces):
            if section == "Relations:" and line.startswith("- "):  # nearly all lines are these
                continue
            if line in prompts.LOCAL:
                section = line
            elif section == "Entities:":
                typed += re.match(r"- .+ [(][A-Z]+[)]: ", line) is not None
            elif section in ("Claims:", "Texts:") and (m := re.match(r"- \[([^\]]+)\]", line)):
                ids[section == "Texts:"].append(m[1])
        return f"{typed};{','.join(ids[0])};{','.join(ids[1])}"


@query(local_sql(QUESTIONS, CONFIG.local_tokens) + """, shown_n AS (SELECT q, count(*) AS n FROM names JOIN e USING (name) GROUP BY q), shown_c AS (SELECT q, string_agg(id, ',' ORDER BY id) AS ids FROM about GROUP BY q),
shown_t AS (SELECT q, string_agg(key, ',' ORDER BY rank) AS ids FROM packed GROUP BY q)
SELECT q_t.key AS question_id, coalesce(n, 0) || ';' || coalesce(shown_c.ids, '') || ';' || coalesce(shown_t.ids, '') AS answer
FROM q_t LEFT JOIN shown_n ON shown_n.q = q_t.key LEFT JOIN shown_c ON shown_c.q = q_t.key LEFT JOIN shown_t ON shown_t.q = q_t.key""")
def local_answers_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local answers of a provider that cites what its prompt shows: entities with types, claims and texts with ids."""
    return settle(lambda: modes.query(place_index(spark, sf_dir, mode="local"), asked(spark, sf_dir), "local", provider=Citer()).answers)


REPORTS = f""", rep AS (SELECT 'L1_C' || n_nationkey AS id, row_number() OVER (ORDER BY 'L1_C' || n_nationkey) AS rank, '{SAID['community_summary']}' AS text FROM nation)"""


@query("WITH q AS (" + QUESTIONS + ")" + REPORTS + f" SELECT key AS question_id, 'community' AS type, id, rank::BIGINT AS rank, substr(rep.text, 1, 240) AS text, '{SAID['global_reduce']}' AS answer FROM q, rep WHERE rank <= 24")
def global_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the level, mapped to points and reduced. Offline reports read alike, so their ids decide."""
    return settle(lambda: shown(modes.query(place_index(spark, sf_dir), asked(spark, sf_dir), "global")))


FOLLOW_UP = "Which indexed entities provide the strongest local evidence?"


@query(local_sql(f"SELECT n_nationkey::BIGINT AS key, '{FOLLOW_UP}' AS text FROM nation", CONFIG.drift_local_tokens) + REPORTS + f""",
ids AS (SELECT q, 0 AS g, rank AS o, key AS id FROM packed UNION ALL SELECT q, 1, rank, 'entity:' || name FROM seeds UNION ALL SELECT q, 2, row_number() OVER (PARTITION BY q ORDER BY id), id FROM about),
ev1 AS (SELECT q, string_agg(id, ',' ORDER BY g, o) AS ids FROM ids GROUP BY q)
SELECT key AS question_id, 'community' AS type, id, rank::BIGINT AS rank, rep.text, '{SAID['drift_reduce']}' AS answer FROM q_t, rep WHERE rank <= 9
UNION ALL SELECT q, 'drift_evidence', 'primer_0_0', 1, ids, '{SAID['drift_reduce']}' FROM ev1
UNION ALL SELECT key, 'trace', 'no_followups', 1, '1', '{SAID['drift_reduce']}' FROM q_t""")
def drift_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports dealt to folds, their follow-up looked into once for each question, what it rests on, and why it ended."""

    def run() -> DataFrame:
        got = modes.query(place_index(spark, sf_dir), asked(spark, sf_dir), "drift")
        ids = got.details["evidence"].select("question_id", "id", F.array_join("source_ids", ",").alias("ids"))
        rows = got.sources.join(ids, ["question_id", "id"], "left").select("question_id", "type", "id", "rank", F.coalesce("ids", "text").alias("text"))
        t = got.details["trace"].select("question_id", F.lit("trace").alias("type"), F.col("termination").alias("id"), F.lit(1).cast("long").alias("rank"), F.col("actions").cast("string").alias("text"))
        return rows.unionByName(t).join(got.answers, "question_id")

    return settle(run)


class FirstWords:
    """A provider without a model: the first two words of a text are entities, and the first comes before the second."""

    name = "first words"

    def complete(self, task: str, prompt: str) -> str:
        import json

        words = re.findall(r"[A-Za-z]+", prompt.split("Text:\n", 1)[1])[:2]
        es = [{"name": w, "type": "word", "description": f"a word of {len(w)} letters"} for w in words]
        rs = [{"source": words[0], "target": words[1], "relation_type": "before", "description": "next"}] if len(words) > 1 and words[0] != words[1] else []
        return f"Here: {json.dumps({'entities': es, 'relations': rs})} Done."


@query(UNITS + r""", w AS (SELECT key, regexp_extract_all(text, '[A-Za-z]+')[1:2] AS ws FROM units), m AS (SELECT key, unnest(ws) AS x FROM w),
spelt AS (SELECT lower(x) AS surface, x, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT x, min((doc_id, chunk_index, i)) AS first FROM (SELECT c.doc_id, c.chunk_index, i, ws[i] AS x FROM (SELECT doc_id, chunk_index, regexp_extract_all(text, '[A-Za-z]+')[1:2] AS ws FROM chunks) c, (VALUES (1), (2)) v(i) WHERE i <= len(ws)) GROUP BY x),
p AS (SELECT surface, x, n, first = min(first) OVER (PARTITION BY surface) AS is_first, first FROM spelt JOIN o USING (x)), canon AS (SELECT surface, x AS canonical FROM p QUALIFY row_number() OVER (PARTITION BY surface ORDER BY n DESC, is_first DESC, first) = 1),
e AS (SELECT 'entity' AS kind, canonical AS id, count(*)::BIGINT AS mentions, count(DISTINCT key)::BIGINT AS chunks FROM m JOIN canon c ON c.surface = lower(x) GROUP BY ALL),
r AS (SELECT 'relation' AS kind, a.canonical || '>BEFORE>' || b.canonical AS id, count(*)::BIGINT AS mentions, count(DISTINCT key)::BIGINT AS chunks FROM w JOIN canon a ON a.surface = lower(ws[1]) JOIN canon b ON b.surface = lower(ws[2]) WHERE len(ws) > 1 AND ws[1] <> ws[2] GROUP BY ALL)
SELECT * FROM e UNION ALL SELECT * FROM r""")
def graph_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, chunks to a provider's answers, answers to mentions, resolved and merged to a graph."""

    def run() -> DataFrame:
        units = save(chunking.chunk_documents(table(spark, sf_dir, "documents"), BULK))
        e, r = map(save, extract.mentions(extract.raw_responses(units, FirstWords(), BULK)))
        g = indexing.build_graph(e, r, BULK)
        es = g["entities"].select(F.lit("entity").alias("kind"), F.col("name").alias("id"), F.col("mention_count").alias("mentions"), F.col("n_chunks").alias("chunks"))
        rs = g["relations"].select(F.lit("relation").alias("kind"), F.concat_ws(">", "source", "relation_type", "target").alias("id"), F.col("mention_count").alias("mentions"), F.col("n_chunks").alias("chunks"))
        return longs(es.unionByName(rs), "mentions", "chunks")

    return settle(run)


class Pieces:
    """A provider that streams: the first three words of a text, piece by piece, and its length. Every prompt whose length
    is a multiple of five fails at first."""

    name = "pieces"

    def __init__(self) -> None:
        self.failed: set[str] = set()

    def complete(self, task: str, prompt: str) -> str:
        raise NotImplementedError("it streams")

    def stream(self, task: str, prompt: str) -> Iterator[str]:
        text = prompt.split("Text:\n", 1)[1]
        for w in re.findall("[A-Za-z]+", text)[:3]:
            yield w.upper()
            yield " "
        if len(text) % 5 == 0 and prompt not in self.failed:
            self.failed.add(prompt)
            raise OSError("broken off")
        yield f"{task}:{len(text)}"


@query("""SELECT doc_id, concat_ws(' ', nullif(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[1:3], lambda w: upper(w)), ' '), ''), 'sum up:' || length(coalesce(text, ''))) AS answer,
  length('Text:' || chr(10) || coalesce(text, ''))::BIGINT AS prompt_length FROM documents""")
def provider_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's prompt, many in flight, answers joined from pieces and tried again where they broke off."""

    def run() -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Text:\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
        got = ask(docs, Pieces(), F.lit("sum up"), F.col("prompt"), "answer", wait=0.001, parallel=64, stream=True)
        return got.select("doc_id", "answer", F.length("prompt").cast("long").alias("prompt_length"))

    return settle(run)


PRUNED = replace(BULK, prune_enabled=True, min_node_degree=32, min_edge_weight_percentile=10.0, describe=False)


@query(GRAPH + """, x AS (SELECT name, mention_count, degree FROM e JOIN d USING (name)), keep AS (SELECT name FROM x WHERE degree >= 32), t AS (SELECT quantile_cont(weight, 0.1) AS w FROM r),
k AS (SELECT r.* FROM r, t WHERE weight >= w AND source IN (SELECT name FROM keep) AND target IN (SELECT name FROM keep))
SELECT 'resolution' AS stage, 'mentions' AS figure, (SELECT count(*) FROM em)::DOUBLE AS value UNION ALL SELECT 'resolution', 'canonical_entities', (SELECT count(*) FROM e)
UNION ALL SELECT 'resolution', 'aliases_merged', (SELECT count(*) FROM em) - (SELECT count(*) FROM e) UNION ALL SELECT 'pruning', 'enabled', 1 UNION ALL SELECT 'pruning', 'edge_weight_threshold', (SELECT w FROM t)
UNION ALL SELECT 'pruning', 'before_entities', (SELECT count(*) FROM e) UNION ALL SELECT 'pruning', 'before_relations', (SELECT count(*) FROM r)
UNION ALL SELECT 'pruning', 'after_entities', (SELECT count(*) FROM keep) UNION ALL SELECT 'pruning', 'after_relations', (SELECT count(*) FROM k)
UNION ALL SELECT 'pruning', 'before_entity_mentions', (SELECT sum(mention_count) FROM e) UNION ALL SELECT 'pruning', 'after_entity_mentions', (SELECT sum(mention_count) FROM x WHERE degree >= 32)
UNION ALL SELECT 'pruning', 'before_relation_mentions', (SELECT sum(mention_count) FROM r) UNION ALL SELECT 'pruning', 'after_relation_mentions', (SELECT sum(mention_count) FROM k)
UNION ALL SELECT 'pruning', 'removed_entities', (SELECT count(*) FROM x WHERE degree < 32) UNION ALL SELECT 'pruning', 'removed_relations', (SELECT count(*) FROM r) - (SELECT count(*) FROM k)
UNION ALL SELECT 'pruning', 'reason_min_node_degree', count(*) FROM x WHERE degree < 32 HAVING count(*) > 0""")
def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resolution and pruning of the whole table graph report, but for the shapes of the graph that graph_statistics has."""

    def run() -> DataFrame:
        unresolved = replace(PRUNED, entity_resolution="none")
        g = indexing.build_graph(entity_mentions(spark, sf_dir), relation_mentions(spark, sf_dir).withColumn("description", F.col("relation_type")), unresolved)
        return g["figures"].filter(~F.col("figure").rlike("avg_degree|density|components"))

    return settle(run)


class Counter:
    """A provider that says how many entities, relations and inner reports a report's prompt shows."""

    name = "counter"

    def complete(self, task: str, prompt: str) -> str:
        parts = prompt.split("Relations:\n")
        relations_, inner = parts[1].split("Reports of the communities inside:\n")
        return ",".join(str(sum(x.startswith("- ") for x in p.split("\n"))) for p in (parts[0], relations_, inner))


@query(GRAPH + """, low AS (SELECT source AS name, n_nationkey, n_regionkey FROM r JOIN nation ON target = n_name WHERE relation_type = 'LOCATED_IN' UNION SELECT n_name, n_nationkey, n_regionkey FROM nation),
mem AS (SELECT 'L1_C' || n_nationkey AS id, 1 AS level, 'L0_C' || n_regionkey AS parent_id, name FROM low UNION SELECT 'L0_C' || n_regionkey, 0, NULL, name FROM low UNION SELECT 'L0_C' || r_regionkey, 0, NULL, r_name FROM region),
x AS (SELECT id, least(30, count(*)) AS n FROM mem GROUP BY id), y AS (SELECT a.id, least(40, count(*)) AS n FROM r JOIN mem a ON a.name = source JOIN mem b ON b.name = target AND a.id = b.id GROUP BY a.id), z AS (SELECT parent_id AS id, count(DISTINCT id) AS n FROM mem WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT DISTINCT mem.id, level::BIGINT AS level, x.n || ',' || coalesce(y.n, 0) || ',' || coalesce(z.n, 0) AS summary FROM mem JOIN x USING (id) LEFT JOIN y USING (id) LEFT JOIN z USING (id)""")
def reports_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on nations, then on regions, which see those of their nations."""

    def run() -> DataFrame:
        e = save(entities(spark, sf_dir).withColumn("description", F.col("type")))
        r = save(relations(spark, sf_dir).withColumn("description", F.col("relation_type")))
        return longs(reports.reports(place_members(spark, sf_dir, r), e, r, Counter()), "level").select("id", "level", "summary")

    return settle(run)


@query(local_sql(QUESTIONS, CONFIG.local_tokens) + """, m AS (SELECT q, max(CASE WHEN seeds.name = n_name THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall FROM seeds JOIN nation ON n_nationkey = q GROUP BY q)
SELECT q::VARCHAR AS case_id, 'local' AS mode, true AS success, recall AS source_recall, 0.5::DOUBLE AS answer_term_coverage FROM m
UNION ALL SELECT n_nationkey::VARCHAR, 'global', true, 0.0, 0.5 FROM nation""")
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation over all nations in two modes: does a question find its nation, and what does the answer say."""

    def run() -> DataFrame:
        q = asked(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("question_id"))
        cases = q.select(
            F.col("question_id").cast("string").alias("id"), F.lit("places").alias("index_id"), "query", F.array(F.lit("local"), F.lit("global")).alias("modes"), F.array(F.concat(F.lit("entity:"), "n_name")).alias("expected_source_ids"),
            F.array(F.lit(" OFFLINE "), F.lit("nothing"), F.lit(" ")).alias("expected_answer_terms"), F.lit(5).alias("top_k"), F.lit(None).cast("int").alias("community_level"))
        return evaluate.run(place_index(spark, sf_dir), cases).select("case_id", "mode", "success", "source_recall", "answer_term_coverage")

    return settle(run)


@query("""WITH m AS (SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE '  ' || p_name || '! ' END AS name, lower(p_type) AS type FROM part), l AS (SELECT s_name AS source, m.name AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN m ON ord = l_partkey)
SELECT 'entity' AS kind, name AS id, count(*)::BIGINT AS n FROM m GROUP BY name""")
def unresolved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without resolution: every spelling is one."""
    m = noisy_mentions(spark, sf_dir).withColumns({"mention_count": F.lit(1).cast("long"), "description": F.col("name"), "chunk_id": F.concat(F.lit("part_"), F.col("ord").cast("string"))})
    none = spark.createDataFrame([], "ord long, source string, target string, relation_type string, description string, weight double, chunk_id string")
    g = indexing.build_graph(m, none, replace(BULK, entity_resolution="none"))
    return g["entities"].select(F.lit("entity").alias("kind"), F.col("name").alias("id"), F.col("mention_count").alias("n"))


@query(GRAPH + """, mem AS (SELECT source AS name, target AS c, 1 AS level FROM r WHERE relation_type = 'LOCATED_IN' UNION SELECT n_name, r_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, n_name, 1 FROM nation)
SELECT name, arg_min(c, (level, c)) AS id FROM mem GROUP BY name""")
def community_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadest community of each entity: nations are in their region first."""
    r, nation, region = relations(spark, sf_dir), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = lambda df, name, c, level: df.select(F.col(name).alias("name"), F.col(c).alias("id"), F.lit(level).alias("level"))
    parts = [row(r.filter("relation_type = 'LOCATED_IN'"), "source", "target", 1), row(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", 0), row(nation, "n_name", "n_name", 1)]
    return graph.community_of(reduce(DataFrame.unionByName, parts).distinct())


@query(GRAPH + "SELECT name, type, mention_count, n_chunks FROM e WHERE name IN (SELECT n_name FROM nation)")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's entity by its name."""
    e = save(entities(spark, sf_dir))
    names = [x["n_name"] for x in table(spark, sf_dir, "nation").select("n_name").collect()]  # a dimension table: 25 rows at every size
    return reduce(DataFrame.unionByName, [graph.entity(e, n) for n in names]).select("name", "type", "mention_count", "n_chunks")
