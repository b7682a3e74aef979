"""The four query modes, each for a set of questions(question_id, query) at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_ladder import json_object
from ..functions.text import normalize_question, strip
from ..operators import budget, graph, retrieve
from ..operators.community import choose_level
from ..sources.scratch import save
from . import prompts, providers
from .indexing import Index
from .providers import OfflineProvider, Provider, keeping, payloads

#: Answers without evidence.
NO_REPORTS = "No community reports were available at the selected hierarchy level."
NO_POINTS = "The selected community reports did not contain enough relevant evidence to answer the question."
Q = "question_id"
#: Entities, relations or claims of one question that a prompt may hold without a setting where the provider takes it as
#: one string; one that reads prompts in pieces has no such bound.
LISTED = 5_000_000


@dataclass
class Answer:
    answers: DataFrame  # (question_id, answer)
    sources: DataFrame  # (question_id, type, id, rank, text)
    details: dict[str, DataFrame]


def ask(rows: DataFrame, index: Index, provider: Provider | None, task: Column, prompt: Column) -> DataFrame:
    return providers.ask(rows, provider or OfflineProvider(), task, prompt, retries=index.config.max_retry, parallel=index.config.provider_parallelism, stream=index.config.stream)


def _vectors(index: Index, kind: str) -> DataFrame:
    return index.vectors.filter(F.col("kind") == kind).select("key", "vector")


def _embedded(questions: DataFrame, index: Index) -> DataFrame:
    return questions.select(Q, index.own_embedder.embed(F.col("query")).alias("question"))


def _listed(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """(question_id, items: the texts in order); lists are cut to k or a budget before."""
    return rows.groupBy(Q).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]).alias("items"))


def _items(rows: DataFrame, name: str, base: DataFrame) -> DataFrame:
    return base.join(rows.withColumnRenamed("items", name), Q, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with r: 1, 2, .. within each question."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(Q).orderBy(order)))


def as_sources(rows: DataFrame, kind: str, id_: str, rank: str, text: Column, chars: int) -> DataFrame:
    return rows.select(Q, F.lit(kind).alias("type"), F.col(id_).alias("id"), F.col(rank).cast("long").alias("rank"), F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("text"))


def basic(index: Index, questions: DataFrame, top_k: int = 5, provider: Provider | None = None) -> Answer:
    """The k nearest chunks answer; no token budget."""
    k = min(top_k, index.config.max_top_k)
    hits = retrieve.rank_named(_vectors(index, "chunk"), _embedded(questions, index), k)
    hits = save(hits.join(index.text_units.withColumnRenamed("chunk_id", "key"), "key"))
    rows = _items(_listed(hits, "rank", F.col("text")), "texts", questions)
    got = ask(rows, index, provider, F.lit("basic_query_answer"), prompts.basic(F.col("query"), F.col("texts")))
    return Answer(got.select(Q, strip(F.col("response")).alias("answer")), as_sources(hits, "text_unit", "key", "rank", F.col("text"), 240), {"text_units": hits})


def claims_about(claims: DataFrame, names: DataFrame) -> DataFrame:
    """names(question_id, name) -> (question_id, claims' columns): claims whose subject or object is among the names, each once."""
    by = lambda end: claims.join(names.select(Q, F.col("name").alias(end)), end).select(Q, *claims.columns)
    return by("subject_id").unionByName(by("object_id")).dropDuplicates([Q, "id"])


def evidence_of(names: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """names(question_id, name) -> (question_id, key): the distinct chunks in which the entities stand."""
    return names.join(entity_chunks, "name").select(Q, F.col("chunk_id").alias("key")).distinct()


class Context(dict[str, DataFrame]):
    """What is around each question, by name of the table; with what a prompt lists of it (see ask_local) in tables that
    hold once what several questions share."""

    who: DataFrame  # (question_id, alike): of questions that read alike one is looked into
    lists: DataFrame  # (alike, block, bit)
    shared: dict[str, DataFrame]  # entities and relations with (block, bits), claims and text units by question


def local_context(index: Index, questions: DataFrame, top_k: int, max_tokens: int) -> Context:
    """Seeds, the entities around them, relations and claims among these, and the best of their chunks within a budget."""
    config = index.config
    asked = save(questions.groupBy("query").agg(F.min(Q).alias("alike")))
    who = save(questions.select(Q, F.col("query").alias("q_")).join(asked, F.col("q_").eqNullSafe(F.col("query"))).select(Q, "alike"))
    q = save(_embedded(asked.withColumnRenamed("alike", Q), index))
    seeds = save(retrieve.rank_named(_vectors(index, "entity"), q, min(top_k, config.max_top_k)).withColumnRenamed("key", "name"))
    around = graph.neighbors(seeds, graph.undirected(index.relations), config.neighbor_depth, by=(Q,)).select(Q, "name")
    names = save(seeds.select(Q, "name").unionByName(around).distinct())
    claims = save(claims_about(index.claims, names))
    scored = retrieve.score_pairs(evidence_of(names, index.entity_chunks), _vectors(index, "chunk"), q)
    top = retrieve.rank_top(scored, config.max_text_units, "key").join(index.text_units.withColumnRenamed("chunk_id", "key"), "key")
    texts = save(budget.select_within(top, max_tokens, [Q], tokenizer=index.own_tokenizer))
    lists = providers.in_blocks(q, Q)
    held = save(graph.held_by(names.join(lists, Q)))
    entities, relations = save(held.join(index.entities, "name")), save(graph.induced_by(index.relations, held))
    each = lambda rows: who.join(rows.withColumnRenamed(Q, "alike"), "alike").drop("alike")
    # One row for each question again; read only by who asks for these tables.
    apart = lambda rows: each(rows.join(lists, "block").filter(F.getbit("bits", F.col("bit").cast("int")) == 1).drop("block", "bits", "bit"))
    ctx = Context(seeds=each(seeds), entities=each(names.join(index.entities, "name")), relations=apart(relations).select(Q, *index.relations.columns), claims=each(claims), text_units=each(texts))
    ctx.who, ctx.lists = who, lists.withColumnRenamed(Q, "alike")
    ctx.shared = {"entities": entities, "relations": relations, "claims": claims, "text_units": texts}
    return ctx


def first(rows: DataFrame, shown: int | None, *order: str) -> DataFrame:
    """rows with o: 1, 2, .. within each question; the first `shown`, or all."""
    rows = rows.withColumn("o", F.row_number().over(Window.partitionBy(Q).orderBy(*order)))
    return rows if shown is None else rows.filter(F.col("o") <= shown)


def _local_lines(ctx: Context, shown: int | None) -> DataFrame:
    """(block, bits, section, k1, k2, k3, line): what local prompts list, in order of k1, k2, k3; never gathered here."""
    has = lambda rows, name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")
    e, r, c, t = (ctx.shared[x] for x in ("entities", "relations", "claims", "text_units"))
    lists = ctx.lists.withColumnRenamed("alike", Q)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), "bit").alias("bits")

    def of(section: int, rows: DataFrame, line: Column, *order: str, most: int | None = shown) -> DataFrame:
        keys = [F.col(x) for x in order] + [F.lit("")] * (3 - len(order))
        if Q not in rows.columns and most is not None:
            rows = rows.join(lists, "block").filter(F.getbit("bits", "bit") == 1).drop("block", "bits", "bit")
        own = rows if most is None else first(rows, most, *order)
        if Q in own.columns:
            own = own.join(lists, Q).withColumn("bits", bit)
        return own.select("block", "bits", F.lit(section).alias("section"), *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)], line.alias("line"))

    claim = F.format_string("[%s] status=%s %s -> %s: %s", "id", has(c, "status"), has(c, "subject_id"), has(c, "object_id"), has(c, "description"))
    parts = [
        of(0, e, F.format_string("%s (%s): %s", "name", has(e, "type"), has(e, "description")), "name"),
        of(1, r, F.format_string("%s -%s-> %s: %s", "source", "relation_type", "target", has(r, "description")), "source", "target", "relation_type"),
        of(2, c, claim, "id"),
        of(3, t.withColumn("at", F.format_string("%010d", "rank")), F.format_string("[%s] %s", "key", "text"), "at", most=None),
    ]
    return reduce(DataFrame.unionByName, parts)


def ask_local(rows: DataFrame, ctx: Context, index: Index, provider: Provider | None, task: Column, head: Column, tail: Column | None = None) -> DataFrame:
    """rows(question_id, ..) with the provider's answer to head, the lists of the context, and tail."""
    config = index.config
    return providers.ask_lists(
        rows, _local_lines(ctx, config.shown_items), Q, provider or OfflineProvider(), task, head, prompts.LOCAL, tail, listed=LISTED, retries=config.max_retry, parallel=config.provider_parallelism, stream=config.stream,
        lists=ctx.who.join(ctx.lists, "alike"))


def in_order(parts: DataFrame) -> DataFrame:
    """parts(question_id, g, o, id) -> (question_id, source_ids): ids by g, then o, each where it stands first."""
    return parts.groupBy(Q).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("g", "o", "id"))), lambda x: x["id"])).alias("source_ids"))


def _part(rows: DataFrame, group: int, order: str, id_: Column) -> DataFrame:
    return rows.select(Q, F.lit(group).alias("g"), F.col(order).cast("long").alias("o"), id_.alias("id"))


def local_ids(ctx: dict[str, DataFrame], shown: int | None = None) -> DataFrame:
    """(question_id, source_ids): text units by rank, seeds as entity:NAME by rank, the claims that a prompt shows."""
    return in_order(_part(ctx["text_units"], 0, "rank", F.col("key")).unionByName(_part(ctx["seeds"], 1, "rank", F.concat(F.lit("entity:"), "name"))).unionByName(_part(first(ctx["claims"], shown, "id"), 2, "o", F.col("id"))))


def source_ids(details: dict[str, DataFrame], mode: str, shown: int | None = None) -> DataFrame:
    """(question_id, source_ids): what an answer of a mode rests on, in order and each once. drift: the reports, then
    the sources of every piece of evidence in the order in which it was looked for."""
    if mode == "basic":
        return in_order(_part(details["text_units"], 0, "rank", F.col("key")))
    if mode == "local":
        return local_ids(details, shown)
    reports = _part(details["reports"], 0, "rank", F.col("id"))
    if mode == "global":
        return in_order(reports)
    evidence = details["evidence"].select(Q, "depth", "place", F.posexplode("source_ids").alias("pos", "id"))
    at = F.row_number().over(Window.partitionBy(Q).orderBy("depth", "place", "pos"))
    return in_order(reports.unionByName(_part(evidence.withColumn("at", at), 1, "at", F.col("id"))))


def local(index: Index, questions: DataFrame, top_k: int = 5, provider: Provider | None = None) -> Answer:
    ctx = local_context(index, questions, top_k, index.config.local_tokens)
    got = ask_local(questions, ctx, index, provider, F.lit("local_query_answer"), prompts.local(F.col("query")))
    by_name = numbered(ctx["entities"], "name").filter(F.col("r") <= top_k)
    by_id = numbered(ctx["claims"], "id")
    sources = as_sources(ctx["text_units"], "text_unit", "key", "rank", F.col("text"), 240).unionByName(as_sources(by_name, "entity", "name", "r", F.col("description"), 200)).unionByName(as_sources(by_id, "claim", "id", "r", F.col("description"), 240))
    return Answer(got.select(Q, strip(F.col("response")).alias("answer")), sources, ctx)


def ranked_reports(reports: DataFrame, vectors: DataFrame, embedded: DataFrame, level: int, top_k: int) -> DataFrame:
    """reports(id, level, summary, ..), vectors(key, vector) -> (question_id, rank, score, id, .., text): the nearest of
    the level, or of the one that stands for it; blank reports are none."""
    own = reports.filter(F.col("summary").isNotNull() & (strip(F.col("summary")) != ""))
    own = own.join(F.broadcast(choose_level(own, level)), "level")
    near = vectors.join(own.select(F.col("id").alias("key")), "key", "left_semi")
    return retrieve.rank_named(near, embedded, top_k).withColumnRenamed("key", "id").join(own, "id").withColumnRenamed("summary", "text")


def community_context(index: Index, questions: DataFrame, level: int, top_k: int, max_tokens: int) -> DataFrame:
    """(question_id, rank, id, level, parent_id, score, text): reports of the level, best first, within the budget."""
    top = ranked_reports(index.reports, _vectors(index, "community"), _embedded(questions, index), level, top_k)
    return save(budget.select_within(top, max_tokens, [Q], tokenizer=index.own_tokenizer))


def parse_points(rows: DataFrame) -> DataFrame:
    """rows(.., response) -> (.., description, score): the points of each answer; an answer without any is a point of score 1 itself."""
    doc = F.try_parse_json(json_object(F.col("response")))
    p = rows.withColumn("points", F.try_variant_get(doc, "$.points", "array<variant>"))
    point = lambda v: F.struct(
        strip(F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit(""))).alias("description"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(0.0)))).alias("score"))
    good = F.filter(F.transform(F.coalesce("points", F.array().cast("array<variant>")), point), lambda x: x["description"] != "")
    whole = F.when(strip(F.col("response")) != "", F.array(F.struct(strip(F.col("response")).alias("description"), F.lit(1.0).alias("score")))).otherwise(F.slice(good, 1, 0))
    p = p.withColumn("good", good).withColumn("x", F.explode(F.when(F.size("good") > 0, F.col("good")).otherwise(whole)))
    return p.select(*rows.columns, "x.description", "x.score").drop("response")


def global_(index: Index, questions: DataFrame, level: int | None = None, top_k: int = 24, provider: Provider | None = None) -> Answer:
    """Reports are packed into batches, a provider lists points for each, the best points within a budget are reduced."""
    config = index.config
    reports = community_context(index, questions, config.global_community_level if level is None else level, min(top_k, config.global_top_k), config.global_tokens)
    packed = budget.batches(reports.select(Q, "rank", "id", "text"), config.map_tokens, [Q], tokenizer=index.own_tokenizer)
    maps = packed.groupBy(Q, "batch").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("r")).join(questions, Q)
    maps = maps.withColumn("shown", F.transform("r", lambda x: F.concat(x["id"], F.lit(": "), x["text"])))
    got = ask(maps, index, provider, F.concat(F.lit("global_map_"), (F.col("batch") - 1).cast("string")), prompts.global_map(F.col("query"), F.col("shown")))
    points = parse_points(save(got.select(Q, "batch", F.transform("r", lambda x: x["id"]).alias("source_reports"), "response"))).filter("score > 0")
    points = points.withColumn("rank", F.row_number().over(Window.partitionBy(Q).orderBy(F.desc("score"), "description", "batch"))).withColumnRenamed("description", "text")
    chosen = save(budget.select_within(points, config.reduce_tokens, [Q], tokenizer=index.own_tokenizer))
    rows = _items(_listed(chosen, "rank", F.col("text")), "points", questions)
    some = reports.select(Q).distinct().withColumn("some", F.lit(True))
    got = ask(rows.filter(F.size("points") > 0), index, provider, F.lit("global_reduce"), prompts.global_reduce(F.col("query"), F.col("points"))).select(Q, strip(F.col("response")).alias("said"))
    answers = rows.join(some, Q, "left").join(got, Q, "left").select(Q, F.when(F.col("some").isNull(), NO_REPORTS).when(F.size("points") == 0, NO_POINTS).otherwise(F.col("said")).alias("answer"))
    return Answer(answers, as_sources(reports, "community", "id", "rank", F.col("text"), 240), {"reports": reports, "map_points": chosen})


def folds(reports: DataFrame, n: int) -> DataFrame:
    """reports(question_id, rank, ..) with fold: dealt round about, as many folds as there are reports at most."""
    size = F.count(F.lit(1)).over(Window.partitionBy(Q))
    place = F.row_number().over(Window.partitionBy(Q).orderBy("rank")) - 1
    return reports.withColumn("fold", place % F.least(F.lit(max(1, n)), size))


def parse_followups(rows: DataFrame, prefix: Column, depth: Column, parent: Column) -> DataFrame:
    """rows(question_id, response, ..) -> (question_id, id, question, score, depth, parent_id); ids keep the place in the answer."""
    doc = F.try_parse_json(json_object(F.col("response")))
    items = rows.select(Q, prefix.alias("prefix"), depth.cast("int").alias("depth"), parent.cast("string").alias("parent_id"), F.posexplode(F.try_variant_get(doc, "$.follow_ups", "array<variant>")).alias("pos", "v"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_variant_get("v", "$.score", "double"), F.lit(0.0))))
    text = strip(F.coalesce(F.try_variant_get("v", "$.question", "string"), F.lit("")))
    return items.select(Q, F.concat("prefix", F.lit("_"), F.col("pos").cast("string")).alias("id"), text.alias("question"), score.alias("score"), "depth", "parent_id").filter("question <> ''")


def expansions(found: DataFrame, gate: float) -> DataFrame:
    """found(question_id, id, depth, confidence, response): follow-ups of what was answered surely enough."""
    sure = found.filter(F.col("confidence") >= gate)
    return parse_followups(sure, F.concat("id", F.lit("_q")), F.col("depth") + 1, F.col("id"))


def frontier(candidates: DataFrame, seen: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(the k best new questions, all that were new): one for each normalised wording, none that was seen (question_id, norm)."""
    c = candidates.withColumn("norm", normalize_question(F.col("question"))).filter("norm <> ''").join(seen, [Q, "norm"], "left_anti")
    order = [F.desc("score"), "question", "id"]
    new = c.withColumn("same", F.row_number().over(Window.partitionBy(Q, "norm").orderBy(*order))).filter("same = 1").drop("same")
    ranked = new.withColumn("place", F.row_number().over(Window.partitionBy(Q).orderBy(*order)))
    return ranked.filter(F.col("place") <= k), new.select(Q, "norm")


def drift(index: Index, questions: DataFrame, level: int | None = None, provider: Provider | None = None) -> Answer:
    """Bounded exploration: a first answer from community reports gives follow-ups; each depth's best are looked into
    locally and may give more. All questions of a depth are one job."""
    config = index.config
    n = config.drift_primer_folds
    reports = community_context(index, questions, config.drift_community_level if level is None else level, min(3 * n, config.global_top_k), config.drift_primer_tokens)
    dealt = folds(reports, n).groupBy(Q, "fold").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("r")).join(questions, Q)
    dealt = dealt.withColumn("shown", F.transform("r", lambda x: F.concat(x["id"], F.lit(": "), x["text"])))
    primed = save(ask(dealt, index, provider, F.lit("drift_primer"), prompts.drift_primer(F.col("query"), F.col("shown"))).select(Q, "fold", "response"))
    doc = F.try_parse_json(json_object(F.col("response")))
    said = primed.withColumn("a", strip(F.coalesce(F.try_variant_get(doc, "$.answer", "string"), F.when(doc.isNull(), F.col("response")), F.lit("")))).filter("a <> ''")
    primer = questions.join(said.groupBy(Q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold", "a"))), lambda x: x["a"]), "\n").alias("primer")), Q, "left").select(Q, "query", F.coalesce("primer", F.lit("")).alias("primer"))
    primer = save(primer)
    seen = save(questions.select(Q, normalize_question(F.col("query")).alias("norm")))
    pending, new = frontier(parse_followups(primed, F.concat(F.lit("primer_"), F.col("fold").cast("string")), F.lit(1), F.lit(None)), seen, config.drift_followups)
    pending, seen = save(pending), save(seen.unionByName(new))
    evidence = questions.sparkSession.createDataFrame([], f"{Q} {questions.schema[Q].dataType.simpleString()}, id string, question string, answer string, confidence double, depth int, parent_id string, place int, source_ids array<string>")
    trace: dict[str, DataFrame] = {}
    for depth in range(1, config.drift_depth + 1):
        used = evidence.groupBy(Q).agg(F.count(F.lit(1)).alias("used"))
        slots = F.least(F.lit(config.drift_followups), F.lit(config.drift_actions) - F.coalesce("used", F.lit(0)))
        current = save(pending.join(used, Q, "left").filter(F.col("place") <= slots).drop("used"))
        if current.isEmpty():
            break
        # Follow-ups are the questions of a local search of their own.
        key = F.concat_ws("/", F.col(Q).cast("string"), F.col("id"))
        asked = save(current.select(key.alias("k"), F.col(Q).alias("root"), "id", "question", "depth", "parent_id", "place"))
        ctx = local_context(index, asked.select(F.col("k").alias(Q), F.col("question").alias("query")), config.drift_local_k, config.drift_local_tokens)
        prior = evidence.groupBy(F.col(Q).alias("root")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "id", F.concat("question", F.lit(": "), "answer").alias("said")))), lambda x: x["said"]).alias("prior"))
        rows = asked.join(prior, "root", "left").join(questions.select(F.col(Q).alias("root"), F.col("query").alias("root_query")), "root").withColumnRenamed("k", Q)
        head, tail = prompts.drift_followup(F.col("root_query"), F.col("question")), prompts.found_before(F.coalesce("prior", F.array().cast("array<string>")))
        got = ask_local(rows, ctx, index, provider, F.concat(F.lit("drift_followup_"), F.col("id")), head, tail)
        got = got.select(F.col(Q).alias("k"), F.col("root").alias(Q), "id", "question", "depth", "parent_id", "place", "response")
        ids = local_ids(ctx, config.shown_items).withColumnRenamed(Q, "k")
        doc = F.try_parse_json(json_object(F.col("response")))
        confidence = F.when(doc.isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(doc, "$.confidence", "double"), F.lit(0.0)))))
        answer = strip(F.coalesce(F.try_variant_get(doc, "$.answer", "string"), F.when(doc.isNull(), F.col("response")), F.lit("")))
        found = save(got.join(ids, "k", "left").select(Q, "id", "question", answer.alias("answer"), confidence.alias("confidence"), "depth", "parent_id", "place", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "response"))
        evidence = save(evidence.unionByName(found.drop("response")))
        if depth == config.drift_depth:
            break
        pending, new = frontier(expansions(found, config.drift_confidence_gate), seen, config.drift_followups)
        pending, seen = save(pending), save(seen.unionByName(new))
    done = evidence.groupBy(Q).agg(F.count(F.lit(1)).alias("actions"), F.max("depth").alias("max_depth"))
    trace = questions.select(Q).join(done, Q, "left").select(Q, F.coalesce("actions", F.lit(0)).alias("actions"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"))
    trace = trace.withColumn("termination", F.when(F.col("actions") >= config.drift_actions, "max_actions").when(F.col("max_depth") >= config.drift_depth, "max_depth").otherwise("no_followups"))
    share = max(1, config.drift_reduce_tokens // 4)
    primer = primer.withColumn("primer", index.own_tokenizer.truncate(F.col("primer"), share)).withColumn("left", F.greatest(F.lit(1), F.lit(config.drift_reduce_tokens) - index.own_tokenizer.count(F.col("primer"))))
    order = Window.partitionBy(Q).orderBy(F.desc("confidence"), "depth", "id")
    text = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nSources: "), F.array_join("source_ids", ", "))
    ranked = evidence.withColumn("rank", F.row_number().over(order)).withColumn("text", text).join(primer.select(Q, "left"), Q)
    chosen = save(budget.select_within(ranked, F.col("left"), [Q], tokenizer=index.own_tokenizer))
    rows = _items(_listed(chosen, "rank", F.col("text")), "evidence", primer)
    got = ask(rows, index, provider, F.lit("drift_reduce"), prompts.drift_reduce(F.col("query"), F.col("primer"), F.col("evidence")))
    listed = evidence.withColumn("r", F.row_number().over(order))
    sources = as_sources(reports, "community", "id", "rank", F.col("text"), 200).unionByName(as_sources(listed, "drift_evidence", "id", "r", F.col("answer"), 240))
    return Answer(got.select(Q, strip(F.col("response")).alias("answer")), sources, {"reports": reports, "evidence": evidence, "trace": trace, "reduce_evidence": chosen})


MODES = {"basic": basic, "local": local, "global": global_, "drift": drift}


def query(index: Index, questions: DataFrame, mode: str, **options) -> Answer:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    limit = index.config.max_query_characters
    if limit is not None and not questions.filter(F.length("query") > limit).isEmpty():
        raise ValueError("a question is too long")
    with keeping(index.config.keep_payloads) as kept:
        answer = MODES[mode](index, questions, **options)
    if (calls := payloads(kept)) is not None:
        answer.details["payloads"] = calls
    return answer
