"""Changes of written tables touch the buckets of their keys only."""

import os

from pyspark.sql import functions as F
import pytest

from dossierlake.operators import merged as M

SCHEMA = "id int, body string, note string"


def files(path):
    return {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("bucket=")}


def buckets(spark, ids):
    rows = M._placed(spark.createDataFrame([(i,) for i in ids], "id int"), "id")
    return {f"bucket={r['bucket']}" for r in rows.select("bucket").collect()}


def content(spark, path):
    return {r["id"]: (r["body"], r["note"]) for r in M.read(spark, path).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = {i: (f"body {i}", f"note {i}") for i in range(500)}
    M.create(spark.createDataFrame([(i, *v) for i, v in rows.items()], SCHEMA), "id", path)
    return path, rows


def test_other_files_keep_their_names(spark, table):
    path, rows = table
    before = files(path)
    incoming = spark.createDataFrame([(3, "new", "ignored"), (1000, "more", "added")], SCHEMA)
    for _ in range(2):  # a repeated change gives the same table
        M.upsert(spark, path, incoming, "id", keep=("note",))
        rows |= {3: ("new", "note 3"), 1000: ("more", "added")}
        assert content(spark, path) == rows
    touched = buckets(spark, [3, 1000])
    after = files(path)
    assert {b for b in before if before[b] != after[b]} == touched & set(before)


def test_replace_and_delete(spark, table):
    path, rows = table
    M.replace(spark, path, spark.createDataFrame([(7, "a", "b")], SCHEMA), "id")
    rows[7] = ("a", "b")
    before = files(path)
    gone = spark.createDataFrame([(9,), (9,), (77777,)], "id int")
    M.delete(spark, path, gone, "id")
    del rows[9]
    assert content(spark, path) == rows
    assert all(before[b] == files(path)[b] for b in before if b not in buckets(spark, [9, 77777]))
    M.delete(spark, path, gone.limit(0), "id")
    M.delete(spark, path, M.read(spark, path).select("id"), "id")
    assert content(spark, path) == {}
    M.upsert(spark, path, spark.createDataFrame([(1, "x", "y")], SCHEMA), "id")
    assert content(spark, path) == {1: ("x", "y")}


def test_a_failed_change_leaves_the_table(spark, table):
    path, rows = table
    with pytest.raises(Exception):
        M.change(spark, path, "id", spark.createDataFrame([(1,)], "id int"),
                 lambda old: old.withColumn("body", F.raise_error(F.lit("broken")).cast("string")))
    assert content(spark, path) == rows


def test_only_touched_buckets_are_read(spark, table):
    path, _ = table
    seen = []
    M.change(spark, path, "id", spark.createDataFrame([(1,)], "id int"), lambda old: seen.append(old._jdf.queryExecution().executedPlan().toString()) or old)
    assert "PartitionFilters: [" in seen[0] and "bucket" in seen[0].split("PartitionFilters: [")[1].split("]")[0]
