"""Prompts as columns: each renderer takes columns and gives the prompt's column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(items: Column, line, empty: str = "(none)") -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n")).otherwise(F.lit(empty))


def _prompt(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def extraction(text: Column, max_entities: int, max_relations: int) -> Column:
    return _prompt(
        f"Extract at most {max_entities} entities (name, type, description) and at most {max_relations} relations (source, target, relation_type, description) from the text.",
        'Answer with one JSON object {"entities": [...], "relations": [...]}; every source and target must be the name of an entity.', "Text:", text)


def claims(text: Column, names: Column, what: str, max_claims: int) -> Column:
    return _prompt(
        f"Find at most {max_claims} claims in the text: {what}",
        'Answer with {"claims": [{"subject", "object", "type", "status", "description", "start_date", "end_date", "source_text"}]}; status is TRUE, FALSE, SUSPECTED or UNKNOWN.',
        F.concat(F.lit("Known entities: "), F.array_join(names, ", ")), "Text:", text)


def entity_description(name: Column, kind: Column, descriptions: Column) -> Column:
    return _prompt(F.concat(F.lit("Write one description of "), name, F.lit(" ("), kind, F.lit(") from these mentions:")), _lines(descriptions, lambda d: F.concat(F.lit("- "), d)))


def relation_description(source: Column, kind: Column, target: Column, descriptions: Column) -> Column:
    return _prompt(F.concat(F.lit("Write one description of the relation "), source, F.lit(" -"), kind, F.lit("-> "), target, F.lit(" from these mentions:")), _lines(descriptions, lambda d: F.concat(F.lit("- "), d)))


def community(id_: Column, level: Column, entities: Column, relations: Column, children: Column) -> Column:
    """entities: array<struct<name, type, description>>, first 30 shown; relations: array<struct<source, relation_type, target, description>>, first 40; children: array<struct<id, summary>>."""
    return _prompt(
        F.concat(F.lit("Write a report on community "), id_, F.lit(" of level "), level.cast("string"), F.lit(".")), "Entities:",
        _lines(F.slice(entities, 1, 30), lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ["), e["type"], F.lit("]: "), e["description"])), "Relations:",
        _lines(F.slice(relations, 1, 40), lambda r: F.concat(F.lit("- "), r["source"], F.lit(" -"), r["relation_type"], F.lit("-> "), r["target"])), "Reports of the communities inside:",
        _lines(children, lambda c: F.concat(F.lit("- "), c["id"], F.lit(": "), c["summary"])))


#: The lists of a local prompt, in its order; they may be long, so their lines are rows until a provider is asked.
LOCAL = ("Entities:", "Relations:", "Claims:", "Texts:")


def local(query: Column) -> Column:
    """What stands before the lists."""
    return _prompt("Answer the question from these data only.", F.concat(F.lit("Question: "), query))


def basic(query: Column, texts: Column) -> Column:
    return _prompt("Answer the question from these texts only.", F.concat(F.lit("Question: "), query), _lines(texts, lambda x: F.concat(F.lit("- "), x)))


def global_map(query: Column, reports: Column) -> Column:
    return _prompt('List the points that help to answer, as {"points": [{"description", "score": 0 to 100}]}.', F.concat(F.lit("Question: "), query), _lines(reports, lambda x: F.concat(F.lit("- "), x)))


def global_reduce(query: Column, points: Column) -> Column:
    return _prompt("Answer the question from these points, the best first.", F.concat(F.lit("Question: "), query), _lines(points, lambda x: F.concat(F.lit("- "), x)))


def drift_primer(query: Column, reports: Column) -> Column:
    return _prompt('Give a first answer and follow-up questions, as {"answer", "follow_ups": [{"question", "score": 0 to 100}]}.', F.concat(F.lit("Question: "), query), _lines(reports, lambda x: F.concat(F.lit("- "), x)))


def drift_followup(root: Column, question: Column) -> Column:
    """What stands before the lists."""
    return _prompt(
        'Answer the follow-up from these data, as {"answer", "confidence": 0 to 1, "follow_ups": [{"question", "score"}]}.',
        F.concat(F.lit("Question: "), root), F.concat(F.lit("Follow-up: "), question), local(question))


def found_before(prior: Column) -> Column:
    """What stands behind the lists. prior: array of earlier questions with their answers; the last six are shown."""
    shown = F.when(F.size(prior) > 6, F.slice(prior, F.size(prior) - 5, 6)).otherwise(prior)
    return _prompt("Found before:", _lines(shown, lambda x: F.concat(F.lit("- "), x)))


def drift_reduce(query: Column, primer: Column, evidence: Column) -> Column:
    return _prompt("Answer the question from the first answer and the evidence.", F.concat(F.lit("Question: "), query), F.concat(F.lit("First answer: "), primer), _lines(evidence, lambda x: F.concat(F.lit("- "), x)))
