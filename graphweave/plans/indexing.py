"""From documents to an index: chunks, mentions, resolution, graph, descriptions,
pruning, claims, communities, reports, vectors. Every table is a DataFrame; the
steps that an external provider answers are saved, so they are asked for once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.tokenizers import WORDS, Tokenizer
from ..operators import chunking, claims, community, describe, extract, graph, prune, reports, resolution
from ..sources.index_store import IndexStore
from ..sources.scratch import save
from .embedding import Embedder, HashEmbedder
from .providers import OfflineProvider, Provider, keeping, payloads

TABLES = ("text_units", "entities", "relations", "entity_chunks", "claims", "communities", "reports", "vectors", "statistics")
#: What the stages removed or merged: (stage, figure, value), and (name, reasons) of pruned entities.
FIGURES, REMOVED = "figures", "removed"
#: Kept on request: all prompts and answers.
PAYLOADS = "payloads"


@dataclass
class Index:
    tables: dict[str, DataFrame]
    config: EngineConfig = field(default_factory=EngineConfig)
    #: Made questions and texts comparable; None: feature hashing.
    embedder: Embedder | None = None
    #: Counts what budgets allow; None: words and signs.
    tokenizer: Tokenizer | None = None

    @property
    def own_tokenizer(self) -> Tokenizer:
        return self.tokenizer or WORDS

    @property
    def own_embedder(self) -> Embedder:
        return self.embedder or HashEmbedder(self.config.embedding_dimension)

    def quality(self) -> dict:
        """Rows of each table, the graph's figures, and by stage what resolution, pruning and claims did."""
        counts = {name: self.tables[name].count() for name in TABLES if name in self.tables and name != "statistics"}
        stages: dict[str, dict] = {}
        for r in self.tables[FIGURES].collect() if FIGURES in self.tables else ():  # some dozen rows
            whole = r["value"] is not None and r["value"] == int(r["value"])
            stages.setdefault(r["stage"], {})[r["figure"]] = int(r["value"]) if whole else r["value"]
        return counts | self.tables["statistics"].first().asDict() | stages

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def metadata(embedder: Embedder) -> dict:
    """What vectors must agree in to be comparable."""
    return {"embedding_provider": embedder.name, "embedding_model": getattr(embedder, "model", embedder.name), "embedding_dimension": embedder.dimension}


def described(mentions: DataFrame, provider: Provider, config: EngineConfig, *keys: str) -> DataFrame:
    if not config.describe:
        return describe.merged_texts(mentions, *keys)
    return describe.summarise(mentions, provider, *keys, cap=config.max_description_mentions, parallel=config.provider_parallelism, retries=config.max_retry, stream=config.stream)


class Tally:
    """Rows of a table, counted by the job that writes it."""

    def __init__(self) -> None:
        self.rows: dict[str, Observation] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.rows[name] = Observation()
        return save(df.observe(self.rows[name], F.count(F.lit(1)).alias("n")))

    def __getitem__(self, name: str) -> int:
        return self.rows[name].get["n"]


def pruning_figures(before: tuple[DataFrame, DataFrame], kept: prune.Pruned, tally: Tally, config: EngineConfig) -> list[tuple[str, str, float]]:
    """Figures before and after, the threshold, what went, and how often each reason was given."""
    if not config.prune_enabled:
        return [("pruning", "enabled", 0.0)]
    out = {"enabled": 1, "edge_weight_threshold": kept.threshold.first()["threshold"]}
    for when, tables in (("before", before), ("after", (kept.entities, kept.relations))):
        out |= {f"{when}_{k}": v for k, v in graph.statistics(*tables).first().asDict().items()}
    out |= {f"removed_{x}": tally[x] - tally[f"kept_{x}"] for x in ("entities", "relations")}
    reasons = kept.removed.select(F.explode("reasons").alias("r")).groupBy("r").count().collect()  # five reasons there are
    out |= {f"reason_{r['r']}": r["count"] for r in reasons}
    return [("pruning", k, float(v)) for k, v in out.items()]


def build_graph(entity_mentions: DataFrame, relation_mentions: DataFrame, config: EngineConfig, provider: Provider | None = None) -> dict[str, DataFrame]:
    """Mentions -> resolved, merged, described and pruned entities and relations, where entities stand, what was removed
    and the figures of both stages."""
    provider, tally = provider or OfflineProvider(), Tally()
    if config.entity_resolution == "normalized":
        named = resolution.resolve_entities(entity_mentions, exact=True)
        raw = resolution.raw_name_map(entity_mentions, exact=True)
        entity_mentions = tally.save(named.withColumn("alias", F.col("name")).withColumn("name", F.col("canonical")).drop("surface", "canonical"), "mentions")
        relation_mentions = save(resolution.resolve_relations(relation_mentions, raw))
    else:
        entity_mentions = tally.save(entity_mentions.withColumn("alias", F.col("name")), "mentions")
        relation_mentions = save(relation_mentions)
    merged = graph.merge_entities(entity_mentions)
    typed = entity_mentions.drop("type").join(merged.select("name", "type"), "name")
    entities = tally.save(merged.join(described(typed, provider, config, "name", "type").drop("n_mentions", "type"), "name"), "entities")
    keys = ("source", "target", "relation_type")
    merged = graph.merge_relations(relation_mentions, entities)
    relations = tally.save(merged.join(described(relation_mentions, provider, config, *keys).drop("n_mentions"), list(keys), "left"), "relations")
    figures = [("resolution", "mentions", tally["mentions"]), ("resolution", "canonical_entities", tally["entities"]), ("resolution", "aliases_merged", max(0, tally["mentions"] - tally["entities"]))]
    kept = prune.prune(entities, relations, config)
    if config.prune_enabled:
        kept.entities, kept.relations, kept.removed = tally.save(kept.entities, "kept_entities"), tally.save(kept.relations, "kept_relations"), save(kept.removed)
    figures += pruning_figures((entities, relations), kept, tally, config)
    names = kept.entities.select("name")
    return {
        "entities": kept.entities, "relations": kept.relations,
        "entity_chunks": graph.provenance(entity_mentions, "name").join(names, "name", "left_semi"),
        "aliases": entity_mentions.select("ord", "name", "alias").join(names, "name", "left_semi"),
        REMOVED: kept.removed, FIGURES: _figures(entities.sparkSession, figures),
    }


def _figures(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame([(s, f, float(v)) for s, f, v in rows], "stage string, figure string, value double")


def embed(index: dict[str, DataFrame], config: EngineConfig, embedder: Embedder | None = None) -> DataFrame:
    """(kind, key, vector) of entities, chunks and reports."""
    embedder = embedder or HashEmbedder(config.embedding_dimension)
    v = lambda kind, df, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), embedder.embed(text).alias("vector"))
    e = v("entity", index["entities"], "name", F.concat(F.col("name"), F.lit(": "), F.coalesce("description", F.lit(""))))
    t = v("chunk", index["text_units"], "chunk_id", F.col("text"))
    c = v("community", index["reports"].filter("summary <> ''"), "id", F.col("summary"))
    return e.unionByName(t).unionByName(c)


def _tables(docs: DataFrame, config: EngineConfig, provider: Provider, embedder: Embedder | None) -> dict[str, DataFrame]:
    out = {"text_units": save(chunking.chunk_documents(docs, config))}
    raw = extract.raw_responses(out["text_units"], provider, config)
    e, r = map(save, extract.mentions(raw.select("ord", "chunk_id", "response")))
    out |= build_graph(e, r, config, provider)
    aliases = out.pop("aliases")
    out = {k: save(v) for k, v in out.items()}
    if config.claims_enabled:
        lookup = claims.alias_lookup(aliases)
        out["claims"] = save(claims.extract_claims(out["text_units"], out["entities"], lookup, provider, config))
        found = [("claims", "enabled", 1.0), ("claims", "count", float(out["claims"].count()))]
    else:
        found = [("claims", "enabled", 0.0), ("claims", "count", 0.0)]
        out["claims"] = docs.sparkSession.createDataFrame([], claims.CLAIMS)
    out[FIGURES] = save(out[FIGURES].unionByName(_figures(docs.sparkSession, found)))
    out["communities"] = community.hierarchy(out["entities"], graph.undirected(out["relations"]), config)
    out["reports"] = reports.reports(out["communities"], out["entities"], out["relations"], provider, config.provider_parallelism, config.stream)
    out["vectors"] = save(embed(out, config, embedder))
    out["statistics"] = save(graph.statistics(out["entities"], out["relations"]))
    return out


def build_index(docs: DataFrame, config: EngineConfig = EngineConfig(), provider: Provider | None = None, embedder: Embedder | None = None, tokenizer: Tokenizer | None = None) -> Index:
    provider = provider or OfflineProvider()
    with keeping(config.keep_payloads) as kept:
        out = _tables(docs, config, provider, embedder)
    if (calls := payloads(kept)) is not None:
        out[PAYLOADS] = calls
    return Index(out, config, embedder, tokenizer)


#: Tables that lie in folders by a column, which questions filter by.
PARTED = {"vectors": "kind"}
#: Tables and columns that came after the first layout, with what stands for them in an older index; None: a null.
LATER_TABLES = {FIGURES: "stage string, figure string, value double", REMOVED: "name string, reasons array<string>"}
LATER_COLUMNS = {"claims": {"source_text": "string", "start_date": "string", "end_date": "string"}, "reports": {"size": "bigint"}, "entities": {"n_chunks": "bigint"}, "relations": {"n_chunks": "bigint"}}


def persist(index: Index, spark: SparkSession, root: str, index_id: str, overwrite: bool = False) -> None:
    """With the index goes whether its vectors are complete, so that nobody has to look at all of them again."""
    own = index.own_embedder
    about = metadata(own) | {"quality": index.quality(), "vectors_complete": complete(index.tables, own.dimension)}
    IndexStore(spark, root).save(index_id, index.tables, about, overwrite, PARTED)


def upgraded(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an index of any version, as this version has them."""
    out = dict(tables)
    for name, schema in LATER_TABLES.items():
        if name not in out:
            out[name] = spark.createDataFrame([], schema)
    for name, columns in LATER_COLUMNS.items():
        if name in out:
            out[name] = out[name].withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in out[name].columns})
    return out


def complete(tables: dict[str, DataFrame], dimension: int) -> bool:
    """Whether every entity, chunk and report has a vector of the length."""
    vectors = tables["vectors"]
    want = [("entity", tables["entities"], "name"), ("chunk", tables["text_units"], "chunk_id"), ("community", tables["reports"].filter("summary <> ''"), "id")]
    keys = None
    for kind, df, key in want:
        own = df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
        keys = own if keys is None else keys.unionByName(own)
    good = vectors.filter(F.size("vector") == dimension)
    return keys.join(good, ["kind", "key"], "left_anti").isEmpty() and vectors.filter(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).isEmpty()


def load(spark: SparkSession, root: str, index_id: str, config: EngineConfig = EngineConfig(), embedder: Embedder | None = None, tokenizer: Tokenizer | None = None) -> Index:
    """The stored index; vectors of another embedding, or with gaps, are made anew."""
    store = IndexStore(spark, root)
    index = Index(upgraded(spark, store.load(index_id)), config, embedder, tokenizer)
    stored, own = store.metadata(index_id), metadata(index.own_embedder)
    whole = stored.get("vectors_complete")  # older indexes don't say
    if any(stored.get(k) != v for k, v in own.items()) or not (complete(index.tables, index.own_embedder.dimension) if whole is None else whole):
        index.tables["vectors"] = save(embed(index.tables, config, index.own_embedder))
    return index
