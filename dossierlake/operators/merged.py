"""K2-K4 on written tables: a change rewrites the partitions of its keys with Spark's dynamic partition overwrite.

A table is written by bucket of its key. A change reads the buckets that its keys lie in, and writes these back; all
other files stay as they are. Spark leaves a partition alone that gets no row, so every rewritten bucket also gets a row that
is not `present`; readers never see it. A change that is repeated after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.operators import state as ST
from dossierlake.session import checkpoint

BUCKETS = 64


def _placed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({"present": F.lit(True), "bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")})


def _write(rows: DataFrame, key: str, path: str, files: int) -> None:
    part = F.pmod(F.shiftright(F.xxhash64(key), 8), F.lit(files))
    rows.repartition("bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(rows: DataFrame, key: str, path: str, files: int = 1) -> None:
    """Write a table; `files` is the number of files of a bucket, to be raised with its size."""
    _write(_placed(rows, key), key, path, files)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("present").drop("present", "bucket")


def change(spark: SparkSession, path: str, key: str, keys: DataFrame, rule: Callable[[DataFrame], DataFrame], files: int = 1) -> None:
    """Put `rule(old rows)` in place of the rows in the buckets of `keys`; at most `BUCKETS` numbers pass the driver."""
    touched = sorted(r["bucket"] for r in _placed(keys.select(key), key).select("bucket").distinct().collect())
    if not touched:
        return
    whole = spark.read.parquet(path)
    old = whole.where(F.col("bucket").isin(touched)).where("present").drop("present", "bucket")
    # the files that are read are about to be replaced
    new = checkpoint(_placed(rule(old), key))
    floor = spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("present", F.lit(False))
    _write(new.unionByName(floor, allowMissingColumns=True), key, path, files)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: str, keep: tuple[str, ...] = (), files: int = 1) -> None:
    """K2: incoming rows win, except for the `keep` columns of rows that are there."""
    change(spark, path, key, incoming, lambda old: ST.upsert(old, incoming, key, keep), files)


def replace(spark: SparkSession, path: str, incoming: DataFrame, key: str, files: int = 1) -> None:
    """K3: all rows of the incoming keys are exchanged."""
    change(spark, path, key, incoming, lambda old: ST.replace_by_key(old, incoming, key), files)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str, files: int = 1) -> None:
    """K4: all rows of the keys go."""
    ids = gone.select(key).distinct()
    change(spark, path, key, ids, lambda old: old.join(ids, key, "left_anti").select(*old.columns), files)
