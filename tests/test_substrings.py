"""The substring index finds what a full scan finds and leaves files unread."""

import random

from pyspark.sql import functions as F
import pytest

from dossierlake.operators import keyword as KW, substrings as SB

def hay():
    return KW.haystack("body")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("substrings"))
    rng = random.Random(4)
    letters = "abcdefgh äß가나다"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(800)]
    rows[5] = (5, "xx needle-in R&D hay xx")
    rows[6] = (6, None)
    docs = spark.createDataFrame(rows, "id int, body string")
    SB.add(docs.where("id < 700"), hay(), f"{folder}/rows", f"{folder}/filters", 20)
    SB.add(docs.where("id >= 700"), hay(), f"{folder}/rows", f"{folder}/filters", 5)
    return folder, docs


@pytest.mark.parametrize("query", ["needle-in", "abc", "gahd äß가", "zzzz", "r&d", "ab", "xx zzzz", "dle-i", "", "bcade fghab"])
def test_candidates_hold_all_matches(spark, table, query):
    folder, docs = table
    rows = SB.candidates(spark, f"{folder}/rows", f"{folder}/filters", query)
    found = {(r["id"], r["keyword_score"]) for r in KW.coverage_scores(rows, query, hay()).collect()}
    assert found == {(r["id"], r["keyword_score"]) for r in KW.coverage_scores(docs, query, hay()).collect()}


def test_a_rare_token_reads_few_files(spark, table):
    folder, docs = table
    assert len(SB.files_for(spark, f"{folder}/filters", "needle-in")) == 1
    assert SB.files_for(spark, f"{folder}/filters", "zzzz") == []
    assert len(SB.files_for(spark, f"{folder}/filters", "ab")) == 25
    rows = SB.candidates(spark, f"{folder}/rows", f"{folder}/filters", "needle-in")
    assert len(rows.inputFiles()) == 1 and rows.count() < docs.count() / 4
    assert rows.where(F.contains("body", F.lit("needle"))).count() == 1


def test_places_are_told_apart_before_they_are_sorted_into_bitmaps(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    docs, plans = spark.createDataFrame([(1, "abcabcabc")], "id int, body string"), []
    docs.write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(self._df._jdf.queryExecution().executedPlan().toString()))
    SB.write_filters(spark, f"{tmp_path}/rows", hay(), f"{tmp_path}/filters")
    below = plans[0][plans[0].rindex("SortAggregate"):]
    assert "HashAggregate" in below
