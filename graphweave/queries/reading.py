"""Global and drift search under a provider that reads its prompts, so that every answer, score and follow-up depends on
what the engine showed: folds, batches, budgets, frontiers over two depths and each way to end can be told apart."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import modes, prompts
from ..plans.providers import lines_of
from ..sources.scratch import settle
from .base import longs, query
from .retrieval import BULK
from .search import QUESTIONS, asked, local_sql, place_index, scores_sql, vectors_sql
from .text import TOKENS

#: Small budgets, so that lists are packed into many batches and cut.
GLOBAL = replace(BULK, map_tokens=24, reduce_tokens=42)
DRIFT = replace(BULK, drift_actions=5, drift_reduce_tokens=300)
TITLES = frozenset((*prompts.LOCAL, "Found before:"))
FOLLOW_UP = "Who is located in NATION_{}?"


class Scout:
    """A provider without a model that knows nothing but its prompt."""

    name = "scout"

    def complete(self, task: str, prompt: str) -> str:
        if task.startswith("community_summary"):
            return self.report(prompt)
        if task.startswith("drift_followup"):
            return self.read(task, [prompt])
        asked_ = int(re.search(r"^Question: .*?(\d+)\?$", prompt, re.M)[1])
        reports_ = [int(c) for c in re.findall(r"^- L\d+_C(\d+): ", prompt, re.M)]
        if task.startswith("global_map"):
            n = len(reports_)
            return json.dumps({"points": [{"description": f"L1_C{c} {i}/{n}", "score": (7 * c + 3 * asked_) % 11 * 9} for i, c in enumerate(reports_, 1)]})
        if task == "global_reduce":
            return ";".join(re.findall(r"^- (.*)$", prompt, re.M))
        if task == "drift_primer":
            more = [{"question": FOLLOW_UP.format(c), "score": (37 * c + asked_) % 101} for c in reports_ if asked_ % 5 != 4]
            return json.dumps({"answer": f"{len(reports_)} reports, first L1_C{reports_[0]}", "follow_ups": more})
        return hashlib.md5(prompt.split("First answer: ", 1)[1].encode()).hexdigest()

    def report(self, prompt: str) -> str:
        """How many entities and relations are shown, and where the first relation leads."""
        shown, rest = prompt.split("\nRelations:\n", 1)
        relations_ = re.findall("^- .*-> (.*)$", rest.split("\nReports of the communities inside:\n", 1)[0], re.M)
        n = len(re.findall("^- ", shown, re.M))
        return f"{relations_[0] if relations_ else 'nowhere'} has {n} entities and {len(relations_)} relations" + (" in all" if n % 2 == 0 else "")

    def read(self, task: str, pieces: Iterable[str]) -> str:
        """What is shown of each kind; the next questions are the nations among the entities, and one by the numbers shown."""
        e = c = t = before = 0
        root = own = section = None
        nations = []
        for line in lines_of(pieces):
            if section == "Relations:" and line.startswith("- "):  # nearly all lines are these
                continue
            if line in TITLES:
                section = line
            elif section is None:
                if root is None and (m := re.fullmatch(r"Question: .*?(\d+)\?", line)):
                    root = int(m[1])
                elif m := re.fullmatch(r"Follow-up: .*?(\d+)\?", line):
                    own = int(m[1])
            elif section == "Entities:":
                e += re.match(r"- .+ [(][A-Z]+[)]: ", line) is not None
                if m := re.match(r"- NATION_(\d+) [(]NATION[)]: ", line):
                    nations.append(int(m[1]))
            else:
                c += section == "Claims:" and line.startswith("- [")
                t += section == "Texts:" and line.startswith("- [")
                before += section == "Found before:" and line.startswith("- ")
        more = [{"question": FOLLOW_UP.format(x), "score": (11 * x + e) % 101} for x in [*nations, (own + e + c + root) % 25]]
        said = f"{e} entities, {c} claims, {t} texts, {before} before"
        return json.dumps({"answer": said, "confidence": (e + 3 * t + 7 * c + own + root) % 10 / 10, "follow_ups": more})


#: Reports of the nations, as Scout writes them, and their order (b: the report, c: its nation) for each question a.
RANKED = """, low AS (SELECT source AS name, n_nationkey::BIGINT AS c FROM r JOIN nation ON target = n_name WHERE relation_type = 'LOCATED_IN' UNION SELECT n_name, n_nationkey FROM nation),
ln AS (SELECT c, least(30, count(*)) AS n FROM low GROUP BY c), lr AS (SELECT a.c, least(40, count(*)) AS n, arg_min(target, (source, target, relation_type)) AS first FROM r JOIN low a ON a.name = source JOIN low b ON b.name = target AND a.c = b.c GROUP BY a.c),
rep AS (SELECT 'L1_C' || c AS key, c, coalesce(first, 'nowhere') || ' has ' || ln.n || ' entities and ' || coalesce(lr.n, 0) || ' relations' || CASE WHEN ln.n % 2 = 0 THEN ' in all' ELSE '' END AS text FROM ln LEFT JOIN lr USING (c)), """ + vectors_sql("p", "SELECT key, text FROM rep") + f""",
ps AS ({scores_sql('q', 'p', 'SELECT q.key AS a, p.key AS b FROM q_t q, p_t p')}), ranked AS (SELECT a, c, b, text, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM ps JOIN rep ON rep.key = b)"""
#: The first tokens of a text, as budgets cut it.
CUT = r"CASE WHEN n > {0} - before THEN array_to_string(regexp_extract_all(text, '\s*(?:[\p{{L}}\p{{N}}_]+|[^\s])')[1 : ({0} - before)::BIGINT], '') ELSE text END"
BEFORE = "coalesce(sum(n) OVER (PARTITION BY q ORDER BY {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"


@query(local_sql(QUESTIONS, GLOBAL.local_tokens) + RANKED + f""", t AS (SELECT a AS q, c, rank, {TOKENS} AS n FROM ranked WHERE rank <= 24),
b AS (SELECT q, c, rank, 1 AS batch, n AS used FROM t WHERE rank = 1
  UNION ALL SELECT t.q, t.c, t.rank, CASE WHEN used + n > 24 THEN batch + 1 ELSE batch END, CASE WHEN used + n > 24 THEN n ELSE used + n END FROM b JOIN t ON t.q = b.q AND t.rank = b.rank + 1),
points AS (SELECT q, 'L1_C' || c || ' ' || row_number() OVER (PARTITION BY q, batch ORDER BY rank) || '/' || count(*) OVER (PARTITION BY q, batch) AS text, (7 * c + 3 * q) % 11 * 9 AS score FROM b),
best AS (SELECT *, {TOKENS} AS n, row_number() OVER (PARTITION BY q ORDER BY score DESC, text) AS o FROM points WHERE score > 0), cum AS (SELECT *, {BEFORE.format('o')} FROM best)
SELECT q AS question_id, string_agg({CUT.format(42)}, ';' ORDER BY o) AS answer, count(*)::BIGINT AS points FROM cum WHERE before < 42 GROUP BY q""")
def global_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each nation: reports packed into batches, points scored by what was read, the best reduced."""

    def run() -> DataFrame:
        got = modes.query(place_index(spark, sf_dir, Scout(), GLOBAL), asked(spark, sf_dir), "global", provider=Scout())
        n = got.details["map_points"].groupBy("question_id").agg(F.count(F.lit(1)).alias("points"))
        return got.answers.join(n, "question_id", "left").select("question_id", "answer", F.coalesce("points", F.lit(0)).cast("long").alias("points"))

    return settle(run)


@query(local_sql(QUESTIONS, DRIFT.drift_local_tokens) + RANKED + f""", prim AS (SELECT a AS q, c, b AS report, rank, (rank - 1) % 3 AS fold, (rank - 1) // 3 AS pos FROM ranked WHERE rank <= 9),
first_said AS (SELECT q, string_agg(said, chr(10) ORDER BY fold) AS primer FROM (SELECT q, fold, count(*) || ' reports, first ' || arg_min(report, rank) AS said FROM prim GROUP BY q, fold) GROUP BY q),
sees AS (SELECT q_t.key AS nat, (SELECT count(*) FROM names JOIN e USING (name) WHERE q = q_t.key) AS es, (SELECT count(*) FROM about WHERE q = q_t.key) AS cs, (SELECT count(*) FROM packed WHERE q = q_t.key) AS ts FROM q_t),
ids AS (SELECT q, 0 AS g, rank AS o, key AS id FROM packed UNION ALL SELECT q, 1, rank, 'entity:' || name FROM seeds UNION ALL SELECT q, 2, row_number() OVER (PARTITION BY q ORDER BY id), id FROM about),
rests AS (SELECT q AS nat, string_agg(id, ', ' ORDER BY g, o) AS ids FROM ids GROUP BY q),
f1 AS (SELECT q, 'primer_' || fold || '_' || pos AS id, c AS nat, 'Who is located in NATION_' || c || '?' AS question, (37 * c + q) % 101 AS score FROM prim WHERE q % 5 <> 4 AND c <> q),
p1 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, question, id) AS place FROM f1 QUALIFY place <= 3),
e1 AS (SELECT p1.*, es, cs, ts, (es + 3 * ts + 7 * cs + nat + q) % 10 / 10.0::DOUBLE AS confidence FROM p1 JOIN sees USING (nat)), used AS (SELECT q, count(*) AS used FROM e1 GROUP BY q),
sure AS (SELECT * FROM e1 WHERE confidence >= 0.35), near AS (SELECT sure.q, sure.id, n_nationkey::BIGINT AS nat, row_number() OVER (PARTITION BY sure.q, sure.id ORDER BY n_name) - 1 AS pos FROM sure JOIN names ON names.q = sure.nat JOIN nation ON n_name = name),
next AS (SELECT * FROM near UNION ALL SELECT sure.q, sure.id, (nat + es + cs + sure.q) % 25, coalesce(n, 0) FROM sure LEFT JOIN (SELECT q, id, count(*) AS n FROM near GROUP BY ALL) k ON k.q = sure.q AND k.id = sure.id),
f2 AS (SELECT q, id || '_q_' || pos AS id, id AS parent, next.nat, 'Who is located in NATION_' || next.nat || '?' AS question, (11 * next.nat + es) % 101 AS score FROM next JOIN (SELECT q, id, es FROM sure) s USING (q, id)),
n2 AS (SELECT * FROM f2 WHERE nat <> q AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.q = f2.q AND f1.nat = f2.nat) QUALIFY row_number() OVER (PARTITION BY q, nat ORDER BY score DESC, question, id) = 1),
p2 AS (SELECT n2.*, used, row_number() OVER (PARTITION BY q ORDER BY score DESC, question, id) AS place FROM n2 JOIN used USING (q) QUALIFY place <= least(3, 5 - used)),
found AS (SELECT q, id, '' AS parent, nat, question, place, 1 AS depth, confidence, es || ' entities, ' || cs || ' claims, ' || ts || ' texts, 0 before' AS answer FROM e1
  UNION ALL SELECT q, id, parent, nat, question, place, 2, (es + 3 * ts + 7 * cs + nat + q) % 10 / 10.0::DOUBLE, es || ' entities, ' || cs || ' claims, ' || ts || ' texts, ' || used || ' before' FROM p2 JOIN sees USING (nat)),
evt AS (SELECT found.*, coalesce(ids, '') AS ids, 'Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || 'Sources: ' || coalesce(ids, '') AS text FROM found LEFT JOIN rests USING (nat)),
evn AS (SELECT *, {TOKENS} AS n, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, depth, id) AS o FROM evt), budgets AS (SELECT q, primer, 300 - {TOKENS.replace('text', 'primer')} AS budget FROM first_said),
cum AS (SELECT evn.*, budget, {BEFORE.format('o')} FROM evn JOIN budgets USING (q)), lines AS (SELECT q, string_agg('- ' || {CUT.format('budget')}, chr(10) ORDER BY o) AS shown FROM cum WHERE before < budget GROUP BY q),
done AS (SELECT q, count(*) AS actions, max(depth) AS depth FROM found GROUP BY q)
SELECT q AS question_id, 'evidence' AS kind, id, parent AS parent_id, depth::BIGINT AS depth, place::BIGINT AS place, question || ' ' || answer || ' ' || ids AS text, confidence FROM evt
UNION ALL SELECT q, 'end', CASE WHEN coalesce(actions, 0) >= 5 THEN 'max_actions' WHEN coalesce(depth, 0) >= 2 THEN 'max_depth' ELSE 'no_followups' END, '', coalesce(depth, 0), coalesce(actions, 0), md5(primer || chr(10) || coalesce(shown, '(none)')), 0
FROM budgets LEFT JOIN done USING (q) LEFT JOIN lines USING (q)""")
def drift_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each nation, followed over two depths: every piece of evidence with its parent, place and sources;
    and how each search ended (id), after how many actions (place), with a digest of what the last prompt showed."""

    def run() -> DataFrame:
        got = modes.query(place_index(spark, sf_dir, Scout(), DRIFT), asked(spark, sf_dir), "drift", provider=Scout())
        said = F.concat_ws(" ", "question", "answer", F.array_join("source_ids", ", "))
        found = got.details["evidence"].select("question_id", F.lit("evidence").alias("kind"), "id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "depth", "place", said.alias("text"), "confidence")
        ended = got.details["trace"].join(got.answers, "question_id").select(
            "question_id", F.lit("end").alias("kind"), F.col("termination").alias("id"), F.lit("").alias("parent_id"), F.col("max_depth").alias("depth"), F.col("actions").alias("place"), F.col("answer").alias("text"), F.lit(0.0).alias("confidence"))
        return longs(found.unionByName(ended), "depth", "place")

    return settle(run)
