"""Documents that arrive over time: chunks are appended as files come in.

Each micro-batch is one append of one table, named by its batch number, so a
batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.chunking import chunk_documents


def ingest_chunks(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string", config: EngineConfig = EngineConfig(), format: str = "parquet") -> StreamingQuery:
    """Chunk what is new under source into sink, once, and stop when all is read."""
    docs = spark.readStream.schema(schema).format(format).load(source)

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch, config).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
