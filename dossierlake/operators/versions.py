"""Versions of the index tables: bucketed run folders and a manifest that is published last.

A run writes every changed bucket of every table to folders of its own and then one manifest, which names
for each table and bucket the folder to read. A run that fails before the manifest leaves the version
before it as it was; a version number is used once; buckets without a change are not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MANIFEST = "version bigint, name string, bucket int, folder string, schema string"


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store Spark reaches; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders `name=number`, ascending."""
    return sorted(int(n.split("=")[1]) for n in entries(spark, path) if n.startswith(f"{name}="))


class Versions:
    """The tables below one path; `files` is the number of files of a bucket, to be raised with its size."""

    def __init__(self, spark: SparkSession, path: str, files: int = 1):
        self.spark, self.path, self.files = spark, path.rstrip("/"), files

    def _list(self, path: str) -> list[str]:
        return entries(self.spark, path)

    def numbers(self) -> list[int]:
        """The published versions, ascending; a folder without its success mark is not one."""
        names = [n for n in self._list(f"{self.path}/manifest") if n.startswith("version=")]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in self._list(f"{self.path}/manifest/{n}"))

    def manifest(self, version: int) -> list:
        """At most tables x BUCKETS rows."""
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={version:010d}").collect()

    def read(self, name: str, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """A table of the newest (or given) version, or only some of its buckets."""
        rows = [r for r in self.manifest(version or self.numbers()[-1]) if r["name"] == name]
        schema = StructType.fromJson(json.loads(rows[0]["schema"]))
        paths = [r["folder"] for r in rows if r["folder"] and (buckets is None or r["bucket"] in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, version: int, tables: dict[str, tuple[DataFrame, str]], touched: dict[str, set[int]] | None = None) -> None:
        """Write (table, key) per name, then the manifest. `touched` names the buckets a table was rebuilt for."""
        known = self.numbers()
        if known and version <= known[-1]:
            raise ValueError(f"version {version} is not newer than {known[-1]}")
        old = {(r["name"], r["bucket"]): r["folder"] for r in self.manifest(known[-1])} if known and touched else {}
        rows = []
        for name, (table, key) in tables.items():
            folder = f"{self.path}/{name}/run-{version:010d}-{uuid.uuid4().hex}"
            placed = table.withColumn("bucket", bucket_of(F.col(key)))
            # a bucket's rows meet in `files` tasks, so a run writes few files and no task a whole large bucket
            part = F.pmod(F.floor(F.xxhash64(F.col(key)) / BUCKETS), F.lit(self.files))
            placed.repartition(F.col("bucket"), part).write.partitionBy("bucket").parquet(folder)
            new = {int(n.split("=")[1]) for n in self._list(folder) if n.startswith("bucket=")}
            schema = table.schema.json()
            rows.append((version, name, -1, None, schema))
            rows += [(version, name, b, f"{folder}/bucket={b}", schema) for b in sorted(new)]
            if touched:
                rows += [(version, name, b, f, schema) for (n, b), f in old.items() if n == name and b >= 0 and b not in touched[name]]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(
            f"{self.path}/manifest/version={version:010d}")

    def clear(self) -> int:
        """K1: a new version with the same tables and no rows; older versions stay readable."""
        newest = self.numbers()[-1]
        names = {r["name"]: StructType.fromJson(json.loads(r["schema"])) for r in self.manifest(newest)}
        self.publish(newest + 1, {n: (self.spark.createDataFrame([], s), s.fieldNames()[0]) for n, s in names.items()})
        return newest + 1


def buckets_of(keys: DataFrame, key: str) -> set[int]:
    """The buckets of some keys: at most BUCKETS numbers."""
    return {r[0] for r in keys.select(bucket_of(F.col(key))).distinct().collect()}
