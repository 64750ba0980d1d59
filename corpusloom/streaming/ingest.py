"""Chunks of documents as they arrive: the expressions of batch chunking on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.operators.chunking import Settings, chunk_documents


def chunk_stream(docs: DataFrame, settings: Settings, text_col: str = "text") -> DataFrame:
    """Stateless: each document's row gives its chunks, so no watermark is needed."""
    return chunk_documents(docs, settings, text_col)


def to_parquet(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
