"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import decontaminate, language, neardup, packing, pii
from dossierlake.llm.common import read_table, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Centroids are learned from the labelled rows; documents unlike all of them, or without a letter, go."""
    return language.accepted(docs, language.fit(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id stays for each group; rows without a doc_id stay."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.cleaned(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are masked in the texts; no document goes."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every text in a bucket and a batch."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("personal_data", personal_data), ("packing", pack),
]

# The first stage, a fitted classifier, can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
