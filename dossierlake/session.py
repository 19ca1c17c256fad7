"""Session defaults, the reliable checkpoint folder and folders next to it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "dossierlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the SQL defaults above; `conf` keys use `__` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`; only a local master without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="dossierlake-", dir=os.environ.get("TMPDIR"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder named by `spark.checkpoint.dir`.

    Only where no folder is configured (a local run) a temporary one is set, so that
    on a cluster the data always survives the loss of an executor.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="dossierlake-ckpt-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here go when it ends; else those of all steps stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: as `checkpoint`, but Spark knows its size and broadcasts what is small.

    Numbers are stored by their differences (the second version of the format), which sorted ones make small.
    """
    path = shared_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.options(**{"compression": "zstd", "parquet.writer.version": "v2"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
