"""Claims: subject and object are looked up among the entities' names and aliases."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import EngineConfig
from ..functions.text import normalize_surface, strip
from ..plans import prompts
from ..plans.providers import Provider, ask
from ..sources.scratch import BROADCAST_ROWS, save
from .extract import parsed

STATUSES = ("TRUE", "FALSE", "SUSPECTED", "UNKNOWN")
EXTRA = ("start_date", "end_date", "source_text")
CLAIMS = "id string, text_unit_id string, subject_id string, object_id string, type string, status string, description string, start_date string, end_date string, source_text string"
WHAT = "statements about the named entities that could be checked"


def alias_lookup(aliases: DataFrame, surface=normalize_surface) -> DataFrame:
    """aliases(ord, name, alias) -> (surface, name): the first entity with the surface form has it."""
    a = aliases.select("ord", "name", surface(F.col("alias")).alias("surface")).filter("surface <> ''")
    return a.groupBy("surface").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


@F.pandas_udf(StringType())
def claim_id(chunk: pd.Series, subject: pd.Series, object_: pd.Series, kind: pd.Series, description: pd.Series) -> pd.Series:
    rows = zip(chunk, subject, object_.fillna(""), kind, description)
    return pd.Series(["claim_" + hashlib.blake2b("|".join(r).encode(), digest_size=8).hexdigest() for r in rows], dtype=object)


def resolve(raw: DataFrame, lookup: DataFrame, surface=normalize_surface) -> DataFrame:
    """raw(ord, chunk_id, subject, object, type, status, description, ..): subjects that are no entity go, objects that
    are none stay as written; blank descriptions go; of claims that agree in id the last stays."""
    s = lookup.select(F.col("surface").alias("s_key"), F.col("name").alias("subject_id"))
    o = lookup.select(F.col("surface").alias("o_key"), F.col("name").alias("o_name"))
    c = raw.withColumns({"s_key": surface(strip(F.coalesce("subject", F.lit("")))), "o_key": surface(strip(F.col("object"))), "description": strip(F.col("description"))}).filter("description <> ''")
    c = c.join(s, "s_key").join(o, "o_key", "left")
    status = F.upper(F.coalesce("status", F.lit("UNKNOWN")))
    kind = F.coalesce("type", F.lit("FACT"))
    return c.select(
        "ord", F.col("chunk_id").alias("text_unit_id"), "subject_id", F.coalesce("o_name", strip(F.col("object"))).alias("object_id"), kind.alias("raw_type"),
        F.when(strip(kind) == "", "FACT").otherwise(strip(kind)).alias("type"), F.when(status.isin(*STATUSES), status).otherwise("UNKNOWN").alias("status"), "description",
        *[x for x in EXTRA if x in raw.columns])


def dedupe(claims: DataFrame, key: str = "id") -> DataFrame:
    """The last claim of each key."""
    rest = [c for c in claims.columns if c not in (key, "ord")]
    last = claims.groupBy(key).agg(F.max_by(F.struct(*rest), "ord").alias("c"))
    return last.select(key, "c.*")


def extract_claims(chunks: DataFrame, entities: DataFrame, lookup: DataFrame, provider: Provider, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, text_unit_id, subject_id, object_id, type, status, description, start_date, end_date, source_text). A chunk
    whose provider keeps failing has no claims, nor has one with a date that is no text; the others are untouched."""
    shown = entities.select("name").orderBy("name")
    if config.claim_names is not None:
        shown = shown.limit(config.claim_names)
    elif shown.count() > BROADCAST_ROWS:
        raise ValueError(f"over {BROADCAST_ROWS} names cannot go into every prompt; set claim_names")
    names = shown.agg(F.array_sort(F.collect_list("name")).alias("names"))  # one row
    rows = chunks.select(F.struct("doc_id", "chunk_index").alias("ord"), "chunk_id", "text").crossJoin(F.broadcast(names))
    prompt = prompts.claims(F.col("text"), F.col("names"), WHAT, config.max_claims_per_chunk)
    got = ask(rows, provider, F.lit("claim_extraction"), prompt, retries=config.max_retry, parallel=config.provider_parallelism, instead="", strict=False, stream=config.stream)
    p = parsed(save(got.select("ord", "chunk_id", "response")))
    items = F.slice(F.try_variant_get("doc", "$.claims", "array<variant>"), 1, config.max_claims_per_chunk)
    of = lambda v, n: F.try_variant_get(v, f"$.{n}", "variant")
    no_text = lambda v, n: of(v, n).isNotNull() & ~F.is_variant_null(of(v, n)) & (F.schema_of_variant(of(v, n)) != "STRING")
    whole = p.select("ord", "chunk_id", items.alias("items")).filter(~F.coalesce(F.exists("items", lambda v: no_text(v, "start_date") | no_text(v, "end_date")), F.lit(False)))
    raw = whole.select("ord", "chunk_id", F.posexplode("items").alias("pos", "v")).withColumn("ord", F.struct("ord", "pos"))
    raw = raw.select("ord", "chunk_id", *[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in ("subject", "object", "type", "status", "description", *EXTRA)])
    c = resolve(raw.withColumn("source_text", strip(F.coalesce("source_text", F.lit("")))), lookup)
    return dedupe(c.withColumn("id", claim_id("text_unit_id", "subject_id", "object_id", "raw_type", "description")).drop("raw_type"))

