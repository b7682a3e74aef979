"""Text units: overlapping windows that prefer to end after a sentence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import EngineConfig
from ..sources.scratch import spread

#: Where a window may end early (fixed values).
MARKS = ".?!。？！\n"
#: Documents whose windows a task holds at a time.
SLICE = 64


def windows(text: str | None, size: int, overlap: int) -> list[dict]:
    out: list[dict] = []
    if not text or text.isspace():
        return out
    at = 0
    while True:
        stop = min(at + size, len(text))
        if stop < len(text):
            stop = max(text.rfind(m, at + size // 2, stop) for m in MARKS) + 1 or stop
        piece = text[at:stop].strip()
        if piece:
            out.append({"chunk_index": len(out), "text": piece})
        if stop == len(text):
            return out
        if stop - overlap <= at:
            raise RuntimeError("the overlap leaves no way forward: it must not exceed half a window")
        at = stop - overlap


def chunk_documents(docs: DataFrame, config: EngineConfig = EngineConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk_index, text), no row for blank documents.

    Where a window starts depends on where the last one ended, so one text is
    read in order; texts are independent and stay where they are, if they come in more parts than there are cores.
    """
    size, overlap = config.chunk_size, config.chunk_overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                found = [(i, w["chunk_index"], w["text"]) for i, t in enumerate(part.column(1)) for w in windows(t.as_py(), size, overlap)]
                own, index, texts = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int32())), pa.array(index, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "chunk_index", "text"])

    rows = spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("chunk_index", IntegerType()), StructField("text", StringType())]))
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "text")
