"""Sharding over fixed virtual slots.

A record's slot is a hash of its key and never changes. Bytes are summed per slot, the slots are dealt to
shards, largest first to the lightest shard, and the slot-to-shard map is kept as numbered versions. A
rebalance edits the newest version: a shard gives up only what exceeds its new share, everything else
stays. The map has as many rows as slots, so planning never sees a record.

All steps are DataFrame expressions. Defined cases: a null text has 0 bytes; a null key hashes like any
other value; equal rows share a slot; no rows give an empty map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SLOTS = 4096
ROW_BYTES = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and a fixed share for the rest of the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def slot_table(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes and rows from records with virtual_slot and size."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def dealt(slots: DataFrame, loads: Column) -> DataFrame:
    """Give each slot, largest first, to the shard with the least bytes; `loads` has the bytes shards start with.

    One fold over the slots, whose number is fixed.
    """

    def place(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"]))
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == at - 1, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["places"], F.array(at.cast("int") - 1)).alias("places"),
        )

    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("bytes")).alias("rank"), "virtual_slot", "bytes", "rows")))
    start = F.struct(loads.alias("loads"), F.expr("CAST(array() AS array<int>)").alias("places"))
    return (
        slots.agg(ordered.alias("slots"))
        .withColumn("places", F.aggregate("slots", start, place, lambda s: s["places"]))
        .select(F.explode(F.arrays_zip("slots", "places")).alias("x"))
        .select("x.slots.virtual_slot", F.col("x.places").alias("shard"), "x.slots.bytes", "x.slots.rows")
    )


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 1: version, virtual_slot, shard, bytes, rows."""
    zero = F.expr(f"array_repeat(0L, {int(shards)})")
    return dealt(slots, zero).select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def rebalanced(old: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version for `shards` shards and the bytes measured now.

    A shard keeps its slots, largest first, while they fit into the new share; slots beyond it, those of
    removed shards and new ones are dealt to the lightest shards. Only the shards' totals reach the driver.
    """
    share = -(-(slots.agg(F.sum("bytes")).first()[0] or 0) // shards)
    version = old.agg(F.max("version")).first()[0] + 1
    now = slots.join(old.select("virtual_slot", F.col("shard").alias("was")), "virtual_slot", "left")
    filled = F.sum("bytes").over(Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = now.withColumn("filled", filled).withColumn(
        "stays", F.coalesce((F.col("was") < shards) & (F.col("filled") <= share), F.lit(False)))
    kept, moved = marked.where("stays"), marked.where("NOT stays")
    held = {r["was"]: r["bytes"] for r in kept.groupBy("was").agg(F.sum("bytes").alias("bytes")).collect()}
    loads = F.array(*[F.lit(held.get(i, 0)).cast("bigint") for i in range(shards)])
    placed = kept.select("virtual_slot", F.col("was").alias("shard"), "bytes", "rows").union(dealt(moved, loads))
    return placed.select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def write_map(shard_map: DataFrame, path: str, version: int) -> None:
    """Store one version in its own folder; a version that exists is never overwritten."""
    shard_map.where(F.col("version") == version).drop("version").write.mode("errorifexists").parquet(
        f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == wanted).select("version", "virtual_slot", "shard", "bytes", "rows")


def assigned(records: DataFrame, shard_map: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Records with shard and `slot`, their place in the shard, counted from 0 without gaps.

    Rows are numbered inside their virtual slot and shifted by the rows of the shard's earlier slots, so
    no task sorts a whole shard.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = shard_map.select(
        "version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (
        records.withColumn("inside", inside).join(starts, "virtual_slot")
        .withColumn("slot", (F.col("start") + F.col("inside") - 1).cast("bigint")).drop("inside", "start")
    )
