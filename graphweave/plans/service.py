"""What an application calls: create, list, delete and inspect indexes, and query them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.tokenizers import Tokenizer
from ..sources.documents import documents_from, guard, with_ids
from ..sources.index_store import IndexStore
from . import indexing, modes
from .embedding import Embedder
from .providers import Provider


class Service:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), provider: Provider | None = None, embedder: Embedder | None = None, tokenizer: Tokenizer | None = None):
        self.spark, self.root, self.config, self.provider, self.embedder, self.tokenizer = spark, root, config, provider, embedder, tokenizer
        self._open: dict[str, tuple[str, indexing.Index]] = {}
        self.store = IndexStore(spark, root)

    def create(self, index_id: str, documents: list[str] | DataFrame, overwrite: bool = False) -> dict:
        """Index a request's texts, or a DataFrame (text, and doc_id if it has any); an index that exists stays unless it may be overwritten."""
        if self.store.exists(index_id) and not overwrite:
            raise FileExistsError(f"index {index_id!r} exists")
        docs = with_ids(documents, index_id) if isinstance(documents, DataFrame) else documents_from(self.spark, index_id, documents)
        index = indexing.build_index(guard(docs, self.config), self.config, self.provider, self.embedder, self.tokenizer)
        indexing.persist(index, self.spark, self.root, index_id, overwrite)
        return self.quality(index_id)

    def list(self) -> list[str]:
        return self.store.list()

    def open(self, index_id: str) -> indexing.Index:
        """The index, loaded once for any number of questions, until another version of it is saved."""
        version = self.store.version(index_id)
        if index_id not in self._open or self._open[index_id][0] != version:
            self._open[index_id] = version, indexing.load(self.spark, self.root, index_id, self.config, self.embedder, self.tokenizer)
        return self._open[index_id][1]

    def delete(self, index_id: str) -> bool:
        self._open.pop(index_id, None)
        return self.store.delete(index_id)

    def quality(self, index_id: str) -> dict:
        return self.store.metadata(index_id).get("quality", {})

    def statistics(self, index_id: str) -> dict:
        """Figures of the stored graph, and its community levels."""
        tables = self.store.load(index_id)
        levels = [r[0] for r in tables["communities"].select("level").distinct().orderBy("level").collect()]
        return tables["statistics"].first().asDict() | {"levels": levels}

    def query(self, index_id: str, text: str, mode: str = "local", **options) -> tuple[str, list[dict]]:
        """(answer, sources) of one question."""
        index = self.open(index_id)
        questions = self.spark.createDataFrame([(0, text)], "question_id long, query string")
        if self.provider is not None:
            options.setdefault("provider", self.provider)
        got = modes.query(index, questions, mode, **options)
        rows = got.sources.orderBy(F.col("type") != "text_unit", "type", "rank").drop("question_id").collect()
        return got.answers.first()["answer"], [r.asDict() for r in rows]
