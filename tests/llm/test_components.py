"""Components of links: what they are, and that few rounds are written."""

import random

import pytest

from dossierlake.llm import neardup


def reached(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in up}


def chain():
    return [(i, i + 1) if i % 3 else (i + 1, i) for i in range(400)] + [(1000 + i, 1000) for i in range(1, 50)]


def tangle():
    random.seed(4)
    return [(random.randrange(600), random.randrange(600)) for _ in range(400)]


@pytest.mark.parametrize("make,parts,nodes", [(chain, 1, 1 << 20), (chain, 7, 1 << 20), (tangle, 7, 1 << 20), (tangle, 3, 16), (chain, 2, 8)])
def test_components_match_a_plain_loop(spark, monkeypatch, make, parts, nodes):
    monkeypatch.setattr(neardup, "NODES", nodes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        links = [(a, b) for a, b in make() if a != b]
        got = neardup.components(spark.createDataFrame(links, "a bigint, b bigint"))
        assert {r["node"]: r["label"] for r in got.collect()} == reached(links)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_chain_of_links_takes_no_rounds_where_one_task_holds_it(spark, monkeypatch):
    """Each round is a plan of six shuffles in the driver's memory; a chain of 400 took about ten."""
    taken = []
    monkeypatch.setattr(neardup, "checkpoint", lambda df, kept=neardup.checkpoint: taken.append(1) or kept(df))
    labels = neardup.components(spark.createDataFrame(chain(), "a bigint, b bigint"))
    assert len(taken) <= 2 and labels.where("node <= 400 AND label <> 0").isEmpty()
