"""The newest-document rule for a further run, from kept postings of signature prefixes.

Two signatures that reach the threshold share a hash among the first few of either in one order that is the same for all.
The order is fixed when an index is built: common hashes last, by how common they were then. A run adds the postings of its
documents to the kept ones, and only indexed documents that a new one meets there, in a size and place that
still allow the threshold, are compared again. All other indexed documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.operators import dedup as D
from dossierlake.session import tidy, written

BUCKETS = 64
POSTING = ("project", "hash", "leader", "rank", "hashes", "before")


def _sets(profiles: DataFrame, key: str, project: str) -> DataFrame:
    numbered = profiles.where(F.size("signature") > 0)
    numbers = F.sort_array(D.numbers_of(numbered, "signature"))
    return numbered.select(F.col(project).alias("project"), F.col(key).alias("leader"), F.size("signature").alias("hashes"), numbers.alias("numbers"))


def common_hashes(profiles: DataFrame, key: str, project: str, threshold: float = D.DUPLICATE_JACCARD) -> DataFrame:
    """(hash, project, df) of the hashes that are common when an index is built."""
    return D.common_hashes(_sets(profiles, key, project), "project", threshold)


def prefixes(profiles: DataFrame, key: str, project: str, common: DataFrame, threshold: float = D.DUPLICATE_JACCARD) -> DataFrame:
    """The postings of the documents' prefixes in the order that `common` fixes, with the bucket they are kept in."""
    return D.prefixes(_sets(profiles, key, project), "project", common, threshold).select(
        "project", "hash", "leader", F.lit(0).alias("rank"), "hashes", "before",
        F.pmod(F.xxhash64("project", "hash"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def save(postings: DataFrame, path: str) -> None:
    """Add postings to the kept ones; a run that is repeated only repeats postings."""
    dealt = postings.repartition("bucket", F.pmod("leader", F.lit(4)))
    with tidy(postings.sparkSession):
        dealt.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)


def kept(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The kept postings in the buckets of the wanted ones; at most `BUCKETS` numbers pass the driver."""
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    return spark.read.schema(wanted.schema).parquet(path).where(F.col("bucket").isin(buckets))


def near(new: DataFrame, old: DataFrame, threshold: float = D.DUPLICATE_JACCARD) -> DataFrame:
    """`leader` of the old postings' documents that a new one may repeat or be repeated by.

    Lists that only one side has go before each posting is put into its bands of sizes: they are nearly all of them.
    """
    on = ["hash", "project"]
    mine = written(new.select(*POSTING).join(old.select(*on).distinct(), on, "left_semi"), "mine")
    theirs = old.select(*POSTING).join(written(mine.select(*on).distinct(), "lists"), on, "left_semi")
    met = D._met(mine, theirs, "project", threshold)
    return met.where(D._can_reach(threshold)).select(F.col("q.leader").alias("leader")).distinct()


def keep_newest(
    new: DataFrame, indexed: DataFrame, new_postings: DataFrame, old_postings: DataFrame, key: str, project: str, mtime: str,
    threshold: float = D.DUPLICATE_JACCARD,
) -> DataFrame:
    """The sequential rule over the new documents and the indexed ones they meet; both have a `signature`.

    Indexed documents are no copies of each other, so one that meets no new document neither goes nor makes another go.
    """
    again = written(near(new_postings, old_postings, threshold), "again")
    met = indexed.join(again, F.col(key) == F.col("leader"), "left_semi")
    columns = [c for c in (key, project, mtime, "signature", "digest") if c in new.columns]
    return D.keep_newest(new.select(*columns).unionByName(met.select(*columns)), key, "signature", project, mtime, threshold, signed=True)
