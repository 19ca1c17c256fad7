"""Incremental indexing and the search log as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from dossierlake.operators.state import log_rows, not_indexed
from dossierlake.operators.versions import entries


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """New document files of a folder, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _batch_writer(index: str, build: Callable[[DataFrame], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The batch owns one folder: a repeated batch overwrites what the failed try left.
        target = f"{index}/batch={batch_id:010d}"
        fresh = batch.dropDuplicates([key])
        others = [n for n in entries(spark, index) if n.startswith("batch=") and int(n.split("=")[1]) != batch_id]
        if others:
            known = spark.read.option("basePath", index).parquet(*[f"{index}/{n}" for n in others]).select(key)
            fresh = not_indexed(fresh, known, key)
        build(fresh).write.mode("overwrite").parquet(target)

    return write


def index_stream(
    documents: DataFrame, index: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], key: str = "document_id"
) -> DataStreamWriter:
    """Each batch skips the documents the index holds and writes the chunks of the others.

    `build` turns documents into chunk rows that keep the key column.
    """
    return documents.writeStream.foreachBatch(_batch_writer(index, build, key)).option("checkpointLocation", checkpoint)


def search_log_stream(queries: DataFrame, log: str, checkpoint: str, kind: str = "topic") -> DataStreamWriter:
    """K6: query events (query_text, result_count, asked_at) appended to the log."""
    rows = log_rows(queries, kind, F.col("asked_at"))
    return rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append")
