"""What the steps of an operator leave on disk."""

import os

from dossierlake.llm import chunks


def shuffled(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for top in disk.localDirs() for _, _, names in os.walk(str(top)) for name in names if name.startswith("shuffle_")}


def test_repeated_passages_leave_no_shuffle_files_of_earlier_steps(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, setting = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = chunks.repeated_passages(docs)
    assert shuffled(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    monkeypatch.setattr(chunks, "PARTS", 1)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows and rows == sorted(tuple(r) for r in chunks.repeated_passages(docs).collect())
