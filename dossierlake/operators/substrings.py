"""A substring index, so that `%token%` reads only the files that can hold it.

The searchable text of every row is cut into overlapping groups of three characters. For each file of a written table a
Bloom filter holds its groups: a bit map of 2 ** `BITS` bits with two bits for each group, put together by Spark's bitmap
aggregates. A token can only stand in a file that has all its groups; the rows of those files are tested exactly
afterwards, so nothing is lost and nothing is found wrongly. A token of two characters has no group and reads every file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.functions.text import explode_rows
from dossierlake.functions.tokens import query_terms

GROUP = 3
BITS = 20
PART = 32768  # bits in one bitmap of Spark


def groups(text: Column) -> Column:
    """The different runs of three characters of a text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GROUP}}}))"), F.lit(1)))


def bits_of(group: Column) -> Column:
    """The two places of a group, counted from 1."""
    code = F.xxhash64(group)
    size = F.lit(1 << BITS)
    return F.array_distinct(F.array(F.pmod(code, size) + 1, F.pmod(F.shiftright(code, 32), size) + 1))


def write_filters(spark: SparkSession, table: str, hay: Column, path: str) -> None:
    """(file, part, filled) for every file of the table at `table`; at most 2 ** BITS bits for each file."""
    found = spark.read.parquet(table).select(F.input_file_name().alias("file"), groups(hay).alias("groups"))
    places = explode_rows(explode_rows(found, ["file"], F.col("groups"), "group").select("file", bits_of(F.col("group")).alias("places")), ["file"],
                          F.col("places"), "place")
    # each place once before the bitmaps, which Spark aggregates sorted: what a task holds is bounded by the bits of its files, not by its texts
    filled = places.groupBy("file", "place").agg(F.count(F.lit(1)).alias("rows")).groupBy("file", F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("filled"))
    filled.write.mode("append").parquet(path)


def add(rows: DataFrame, hay: Column, table: str, filters: str, files: int) -> None:
    """Write rows as further files of the table, with their filters; files that have one are not read again."""
    spark = rows.sparkSession
    part = f"{table}/run={len(_runs(spark, table)):06d}"
    rows.repartition(files).write.parquet(part)
    write_filters(spark, part, hay, filters)


def _runs(spark: SparkSession, table: str) -> list[str]:
    from dossierlake.operators.versions import entries

    return [n for n in entries(spark, table) if n.startswith("run=")]


def files_for(spark: SparkSession, filters: str, query: str) -> list[str]:
    """The files that can hold one of the query's tokens."""
    asked = spark.range(1).select(F.explode(query_terms(F.lit(query))).alias("term"))
    known = spark.read.parquet(filters)
    pieces = explode_rows(asked.withColumn("groups", groups(F.col("term"))), ["term"], F.col("groups"), "group").where("group IS NOT NULL")
    places = explode_rows(pieces.select("term", bits_of(F.col("group")).alias("places")), ["term"], F.col("places"), "place").distinct()
    wanted = places.select("term", F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("at"))
    needed = asked.join(wanted, "term", "left").groupBy("term").agg(F.count("part").alias("needed"))
    byte = F.conv(F.hex(F.substring("filled", F.shiftright("at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.getbit(byte, (F.col("at") % 8).cast("int")) == 1
    held = known.join(wanted, "part").where(has).groupBy("file", "term").agg(F.count(F.lit(1)).alias("held"))
    able = held.join(needed.where("needed > 0"), "term").where("held = needed").select("file")
    if not needed.where("needed = 0").isEmpty():
        able = known.select("file")
    return sorted(r["file"] for r in able.distinct().collect())


def candidates(spark: SparkSession, table: str, filters: str, query: str) -> DataFrame:
    """The rows of the files that can hold a token of the query; the exact test is the caller's."""
    schema = spark.read.parquet(table).drop("run").schema
    files = files_for(spark, filters, query)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
