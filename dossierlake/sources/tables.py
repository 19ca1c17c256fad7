"""Readers for the supplied tables and their mapping to the project / document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.functions.text import stable_id


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out to as many tasks as `dossierlake.spread` names; without that setting nothing is moved.

    For small inputs of one split, as in tests and the bench.
    """
    tasks = df.sparkSession.conf.get("dossierlake.spread", None)
    return df.repartition(int(tasks), key) if tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` seen as project files.

    source -> project, lang -> document type, doc_id -> modification time,
    `<source>/<lang>_<doc_id>.docx` -> path.
    """
    raw = table(spark, sf_dir, "documents")
    name = F.concat_ws("_", "lang", F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", F.concat(name, F.lit(".docx")))
    return raw.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        stable_id(path, "doc").alias("document_id"),
        stable_id(F.col("source"), "prj").alias("project_id"),
        F.col("source").alias("project_name"),
        name.alias("document_title"),
        F.concat(name, F.lit(".docx")).alias("file_name"),
        path.alias("file_path"),
        F.col("lang").alias("document_type"),
        F.col("doc_id").cast("double").alias("file_mtime"),
        "text",
    )
