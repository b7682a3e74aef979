"""Indexes on disk: one folder of Parquet tables a version, and a manifest that names the current one.

A version is written whole before the manifest is renamed over the old one in
one step, so a reader sees the old index or the new one. The version before
stays, for those who still read it, until the next one is written; a crash
leaves the old index or the new one, and at worst files that no manifest names,
which the next save removes. Paths go through Hadoop's file system, as the
tables do.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import check_index_id

#: 1: plain tables. 2: tables may lie in folders by a column. Both are read.
SCHEMA_VERSION = 2


def stamp() -> str:
    """Now, in UTC, to the microsecond."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%S.%fZ")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._overwrite = over

    def _dir(self, index_id: str) -> str:
        return f"{self.root}/{check_index_id(index_id)}"

    def _manifest(self, index_id: str) -> dict:
        path = f"{self._dir(index_id)}/manifest.json"
        if not self._fs.exists(self._path(path)):
            raise FileNotFoundError(f"no index {index_id!r}")
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def exists(self, index_id: str) -> bool:
        return self._fs.exists(self._path(f"{self._dir(index_id)}/manifest.json"))

    def list(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.root}/{n}/manifest.json")))

    def delete(self, index_id: str) -> bool:
        return bool(self._fs.delete(self._path(self._dir(index_id)), True))

    def save(self, index_id: str, tables: dict[str, DataFrame], metadata: dict | None = None, overwrite: bool = False, parted: dict[str, str] | None = None) -> None:
        """parted: of tables by name, the column by whose values their files lie in folders."""
        if self.exists(index_id) and not overwrite:
            raise FileExistsError(f"index {index_id!r} exists")
        version = f"v={uuid.uuid4().hex}"
        for name, df in tables.items():
            column = (parted or {}).get(name)
            writer = df.write.partitionBy(column) if column in df.columns else df.write
            writer.parquet(f"{self._dir(index_id)}/{version}/{name}")
        manifest = {"schema_version": SCHEMA_VERSION, "index_id": index_id, "version": version, "tables": sorted(tables), "metadata": metadata or {}, "timestamp": stamp()}
        new, path = self._path(f"{self._dir(index_id)}/manifest.{version[2:]}.tmp"), self._path(f"{self._dir(index_id)}/manifest.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        old = self._manifest(index_id)["version"] if self._fs.exists(path) else None
        self._files.rename(new, path, self._overwrite)
        for s in self._fs.listStatus(self._path(self._dir(index_id))):
            name = s.getPath().getName()
            if name.startswith("v=") and name not in (version, old) or name.endswith(".tmp"):
                self._fs.delete(s.getPath(), True)

    def load(self, index_id: str) -> dict[str, DataFrame]:
        m = self._manifest(index_id)
        if m["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"index {index_id!r} has layout {m['schema_version']}; this library reads up to {SCHEMA_VERSION}")
        return {t: self.spark.read.parquet(f"{self._dir(index_id)}/{m['version']}/{t}") for t in m["tables"]}

    def metadata(self, index_id: str) -> dict:
        return self._manifest(index_id)["metadata"]

    def version(self, index_id: str) -> str:
        """Another one after every save."""
        return self._manifest(index_id)["version"]


#: The fields of an index that is kept as one JSON object.
PAYLOAD = (
    "entities map<string, struct<name string, type string, description string, mention_count bigint, source_chunk_ids array<string>>>, "
    "relations array<struct<source string, target string, relation_type string, description string, mention_count bigint, weight double, source_chunk_ids array<string>>>, "
    "communities array<struct<id string, level int, entities array<string>, summary string, parent_id string, size bigint>>, "
    "covariates array<struct<id string, text_unit_id string, subject_id string, object_id string, type string, status string, description string, start_date string, end_date string, source_text string>>, "
    "text_chunks array<struct<id string, text string, doc_id string, chunk_index int>>, "
    "entity_embeddings map<string, array<float>>, chunk_embeddings map<string, array<float>>, community_embeddings map<string, array<float>>"
)


def read_payload(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index that is kept as one JSON object, in an envelope (under "graph") or bare, as older files are.
    Fields that are missing are empty tables. Such a file is read whole; it is small by the guards it was made under."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"graph struct<{PAYLOAD}>, {PAYLOAD}").alias("d"))
    names = [f.name for f in raw.schema["d"].dataType["graph"].dataType.fields]
    doc = raw.select(*[F.when(F.col("d.graph").isNotNull(), F.col(f"d.graph.{n}")).otherwise(F.col(f"d.{n}")).alias(n) for n in names])
    rows = lambda name: doc.select(F.explode(name).alias("x")).select("x.*")
    entities = doc.select(F.explode("entities").alias("k", "x")).select("x.*")
    size = lambda c: F.greatest(F.lit(0), F.size(c)).cast("long").alias("n_chunks")
    communities = rows("communities")
    vectors = None
    for kind, name in (("entity", "entity_embeddings"), ("chunk", "chunk_embeddings"), ("community", "community_embeddings")):
        own = doc.select(F.explode(name).alias("key", "vector")).select(F.lit(kind).alias("kind"), "key", "vector")
        vectors = own if vectors is None else vectors.unionByName(own)
    return {
        "text_units": rows("text_chunks").select("doc_id", F.col("id").alias("chunk_id"), "chunk_index", "text"),
        "entities": entities.select("name", "type", "mention_count", size("source_chunk_ids"), "description"),
        "relations": rows("relations").select("source", "target", "relation_type", "weight", "mention_count", size("source_chunk_ids"), "description"),
        "entity_chunks": entities.select("name", F.explode("source_chunk_ids").alias("chunk_id")).distinct(),
        "claims": rows("covariates"),
        "communities": communities.select("id", "level", "parent_id", "size", F.explode("entities").alias("name")),
        "reports": communities.select("id", "level", "parent_id", "size", "summary"), "vectors": vectors,
    }
