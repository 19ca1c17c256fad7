"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.session import checkpoint

__all__ = ["bin_of", "checkpoint", "range_bounds", "read_table", "shared_folder", "stored"]

GROUP = 32
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which every executor reaches.

    Only a local master without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="dossierlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *parts: str, mode: str = "error") -> DataFrame:
    """`df` written below `path`, by the columns `parts`, and read again. Shuffle files of this step go when it ends.

    Without that, those of all steps stay until the driver happens to collect its garbage. `df` must not be used again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*parts).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most `parts` values that occur in `column`, ascending, about as many rows between each two.

    The smallest value is always the first. Nulls are left out; no rows give an empty list.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(
        F.min(column).alias("least"),
        F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(20 * parts)).alias("cuts"),
    ).first()
    if found["least"] is None:
        return []
    return sorted({found["least"], *(found["cuts"] or [])})


def bin_of(value: Column, bounds: list) -> Column:
    """How many of `bounds` are at most `value`, found in two steps of `GROUP` comparisons; 0 for null."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]

    def passed(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda x: x <= value))

    group = passed(F.lit([g[0] for g in groups]))
    inside = passed(F.element_at(F.array(*[F.lit(g) for g in groups]), F.greatest(group, F.lit(1))))
    return F.when(value.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * GROUP + inside)
