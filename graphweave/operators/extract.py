"""Extraction: provider answers become mention rows, after checks on the whole answer."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.json_ladder import find_json, has_keys, json_object, json_or
from ..functions.text import strip
from ..plans import prompts
from ..plans.providers import Provider, ask
from ..sources.scratch import save


ENTITY_KEYS, RELATION_KEYS = ("name", "type", "description"), ("source", "target", "relation_type", "description")
ENTITY, RELATION = itemgetter(*ENTITY_KEYS), itemgetter(*RELATION_KEYS)
NOTHING = (None, None, None)
#: Answers that are Python objects at a time.
SLICE = 512


def usable(response: str | None) -> bool:
    """Whether mentions() would take the answer, so that it need not be asked for again."""
    doc = json_or(response, keys=("entities", "relations"))
    if not isinstance(doc, dict) or not all(isinstance(doc[k], list) for k in ("entities", "relations")):
        return False
    if not all(has_keys(e, ENTITY_KEYS) for e in doc["entities"]) or not all(has_keys(r, RELATION_KEYS) for r in doc["relations"]):
        return False
    names = [e["name"] for e in doc["entities"]]
    return all(r["source"] in names and r["target"] in names for r in doc["relations"])


def raw_responses(chunks: DataFrame, provider: Provider, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(ord, chunk_id, response), saved: answers are parsed from there. An answer that cannot be used is asked for
    again; a provider that keeps failing leaves its chunk with an empty answer and the others untouched."""
    ord_ = F.struct("doc_id", "chunk_index").alias("ord")
    rows = chunks.select(ord_, "chunk_id", "text")
    prompt = prompts.extraction(F.col("text"), config.max_entities, config.max_relations)
    got = ask(rows.withColumn("prompt", prompt), provider, F.lit("entity_extraction"), F.col("prompt"), retries=config.max_retry, parallel=config.provider_parallelism, valid=usable, instead="", strict=False, stream=config.stream)
    return save(got.select("ord", "chunk_id", *(["prompt"] if config.keep_payloads else []), "response"))


def parsed(responses: DataFrame) -> DataFrame:
    """responses(.., response) with doc: the answer as a variant, null without JSON."""
    return responses.withColumn("doc", F.try_parse_json(json_object(F.col("response"))))


def _odd(doc: object) -> str:
    """The JSON of an answer that is left to Spark."""
    return json.dumps(doc, ensure_ascii=False).encode("utf-8", "replace").decode()


def _texts(rows: list[tuple]) -> bool:
    return all(v is None or isinstance(v, str) and v.encode("utf-8", "replace").decode() == v for x in rows for v in x)


def answer(response: str | None, judged: bool = True) -> tuple[list[tuple] | None, list[tuple] | None, str | None]:
    """(entities, relations, odd) of an answer: values by ENTITY_KEYS and RELATION_KEYS if it is good and all of them are
    texts or null; odd: the JSON of one that may be good, with others. judged: values are looked at, as they need not be
    where those that are no texts would be noticed."""
    doc = find_json(response)
    if doc is None:
        return NOTHING
    if not isinstance(doc, dict):
        return None, None, _odd(doc)
    es, rs = doc.get("entities"), doc.get("relations")
    if es is None or rs is None:
        return NOTHING
    try:
        if not isinstance(es, list) or not isinstance(rs, list):
            raise TypeError
        e, r = list(map(ENTITY, es)), list(map(RELATION, rs))
        names = {x[0] for x in e}
    except KeyError:
        return NOTHING if all(isinstance(x, dict) for x in (*es, *rs)) else (None, None, _odd(doc))
    except TypeError:
        return None, None, _odd(doc)
    names.discard(None)
    for x in r:
        if x[0] not in names or x[1] not in names:
            return NOTHING if _texts(e) and _texts(r) else (None, None, _odd(doc))
    return (e, r, None) if not judged or _texts(e) and _texts(r) else (None, None, _odd(doc))


def _lists(rows: list[list[tuple] | None], keys: tuple[str, ...]) -> pa.Array:
    columns = list(zip(*[x for row in rows if row for x in row])) or [()] * len(keys)
    flat = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], list(keys))
    ends = np.cumsum([0, *(len(row or ()) for row in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([row is None for row in rows], pa.bool_()))


def _told(responses: pa.Array, judged: bool) -> pa.Array:
    got = [answer(x, judged) for x in responses.to_numpy(zero_copy_only=False).tolist()]
    es, rs, odd = zip(*got) if got else ((), (), ())
    return pa.StructArray.from_arrays([_lists(es, ENTITY_KEYS), _lists(rs, RELATION_KEYS), pa.array(odd, pa.string())], ["es", "rs", "odd"])


def _answers(responses: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, max(1, len(responses)), SLICE):
        try:
            parts.append(_told(responses.slice(at, SLICE), False))
        except (pa.ArrowException, TypeError, UnicodeError):
            parts.append(_told(responses.slice(at, SLICE), True))
    return pa.concat_arrays(parts)


def _checked(response: Column) -> Column:
    """struct<es, rs, odd>: answer() of each. Declared not to be repeatable, so that Spark reads an answer once however many
    filters and columns use it."""
    es, rs = (f"array<struct<{', '.join(f'{k}: string' for k in keys)}>>" for keys in (ENTITY_KEYS, RELATION_KEYS))
    return F.arrow_udf(_answers, f"struct<es: {es}, rs: {rs}, odd: string>").asNondeterministic()(response)


def mentions(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, chunk_id, response) -> entity mentions (ord, pos, chunk_id, name, type, description, mention_count),
    relation mentions (ord, pos, chunk_id, source, target, relation_type, description, weight).

    An answer counts only as a whole: entities and relations are lists, every
    row has its keys, and every relation's ends are among the answer's own
    entities. Rows of a good answer with an empty name or end are left out.
    """
    p = responses.withColumn("a", _checked(F.col("response")))
    # Values that are no texts are written as Spark has them.
    rows = "array<map<string, string>>"
    # A generator's column is made once; a plain one would be parsed again by each filter below.
    p = p.select("*", F.explode(F.array(F.from_json("a.odd", f"entities {rows}, relations {rows}"))).alias("doc"))
    lacks = lambda v, keys: v.isNull() | ~reduce(and_, [F.map_contains_key(v, k) for k in keys])
    es, rs = F.col("doc.entities"), F.col("doc.relations")
    known = lambda r, end: F.coalesce(F.array_contains(F.transform(es, lambda e: e["name"]), r[end]), F.lit(False))
    bad_entity = F.exists(es, lambda e: lacks(e, ENTITY_KEYS))
    bad_relation = F.exists(rs, lambda r: lacks(r, RELATION_KEYS) | ~known(r, "source") | ~known(r, "target"))
    good = ~F.coalesce(bad_entity, F.lit(True)) & ~F.coalesce(bad_relation, F.lit(True))
    fields = lambda v, keys: F.transform(v, lambda x: F.struct(*[x[k].alias(k) for k in keys]))
    either = lambda own, v, keys: F.when(F.col("a.odd").isNull(), own).when(good, fields(v, keys))
    of = lambda own, v, keys: p.select("ord", "chunk_id", F.posexplode(either(F.col(own), v, keys)).alias("pos", "v")).select("ord", "pos", "chunk_id", "v.*")
    e = of("a.es", es, ENTITY_KEYS).withColumn("mention_count", F.lit(1).cast("long"))
    r = of("a.rs", rs, RELATION_KEYS).withColumn("weight", F.lit(1.0))
    order = F.struct("ord", "pos")
    e = e.withColumn("ord", order).drop("pos").filter((strip(F.col("name")) != "") & (strip(F.col("type")) != ""))
    return e, r.withColumn("ord", order).drop("pos").filter((F.col("source") != "") & (F.col("target") != ""))
