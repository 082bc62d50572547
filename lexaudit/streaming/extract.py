"""Extraction over a stream of documents; every row is judged alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import extract


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id string, text string") -> DataFrame:
    """Documents that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_citations(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Citations of the documents so far, appended to a Parquet folder exactly once."""
    return extract(docs).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
