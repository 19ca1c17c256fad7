"""Whitening against numpy over the whole table."""

import math

import numpy as np

from dossierlake.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, index bigint, x string, at string, fit string, part string"


def checked(found, vectors, components=4):
    """Compare with numpy; `vectors` are (vec_id, entries) of the rows that stay."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors}
    fit = np.array(sorted(set(map(tuple, x.values()))), object)
    n, total = len(fit), fit.sum(0)
    centred = (fit * n - total).astype(float) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    rows = {}
    for r in found:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(rows) == sorted(x)
    projected = {i: ((np.array(v, object) * n - total).astype(float) / n) @ basis / np.sqrt(values) for i, v in x.items()}
    signs = [None] * components
    for i, parts in rows.items():
        assert sorted(parts) == list(range(1, components + 1))
        for c, r in parts.items():
            assert r["n"] == n and r["deviation"] == sum(int(d) ** 2 for d in np.array(x[i], object) * n - total)
            assert abs(r["explained"] - values[c - 1] / np.trace(covariance)) <= 1e-9
            assert 0 <= r["identity_error"] < 1e-9
            expected = projected[i][c - 1]
            if signs[c - 1] is None and abs(expected) > 0.1:
                signs[c - 1] = np.sign(expected * r["whitened"])
            assert abs(abs(expected) - abs(r["whitened"])) < 1e-7
            if abs(expected) > 0.1:
                assert np.sign(expected * r["whitened"]) == signs[c - 1]


def test_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    checked(queries.op11_block_whitening(spark, SF).collect(), [tuple(r) for r in table])


def test_repeated_vectors_count_once_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 35)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * [5, 4, 3, 2, 1]).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000 + i, rows[i][1]) for i in range(20)]
    table = spark.createDataFrame([(*r, 1, "x", "a", "f", "p") for r in rows], SCHEMA).repartition(7)
    found = whitening.whitened(table).collect()
    checked(found, rows)
    same = {(r["component"], r["whitened"]) for r in found if 1000 <= r["vec_id"] < 2000}
    assert len(same) == 4


def test_odd_vectors(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])]
    good = [(5, [1.0, -2.0]), (6, [0.5, 3.0]), (7, [-0.0, 0.25]), (8, [2.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, "x", "a", "f", "p") for r in bad + good], SCHEMA)
    checked(whitening.whitened(table).collect(), good, 2)
    short = spark.createDataFrame([(*r, 1, "x", "a", "f", "p") for r in [(None, [1.0]), (6, [0.5, 3.0]), (6, [0.5, 3.0]), (7, [2.0, 1.0]), (8, [])]], SCHEMA)
    assert len(whitening.whitened(short).collect()) == 10
    one = whitening.whitened(table.where("vec_id = 5")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 2
    assert whitening.whitened(table.where("vec_id < 5")).collect() == []
    assert whitening.whitened(table.where("vec_id < 0")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    rows = [(i, [float(3e12 + i * i * 4e10), float(-i), 1.0]) for i in range(9)]
    found = whitening.whitened(spark.createDataFrame([(*r, 1, "x", "a", "f", "p") for r in rows], SCHEMA.replace("float", "double"))).collect()
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in found) and len(found) == 27
