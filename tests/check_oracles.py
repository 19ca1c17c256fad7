"""Run registered queries against their checking SQL: python tests/check_oracles.py [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from dossierlake.plans.registry import registered  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, item, sf_dir):
    df = item.run(spark, sf_dir)
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not item.oracle:
        return f"rows={len(mine)} (no SQL)"
    result = con.execute(item.oracle)
    cols, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if mine_cols != cols:
        raise AssertionError(f"columns {mine_cols} != {cols}")
    if mine != theirs:
        left = [r for r in mine if r not in set(theirs)][:3]
        right = [r for r in theirs if r not in set(mine)][:3]
        raise AssertionError(f"rows {len(mine)} vs {len(theirs)}\n  spark: {left}\n  sql:   {right}")
    return f"rows={len(mine)} match"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main(names):
    from dossierlake.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g", spark__sql__ansi__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    items = registered()
    bad = 0
    for name in names or items:
        started = time.time()
        try:
            note = compare(spark, con, items[name], sf_dir)
            print(f"ok   {name:34s} {time.time() - started:6.1f}s {note}", flush=True)
        except Exception as exc:  # report every failure, then go on
            bad += 1
            print(f"FAIL {name:34s} {time.time() - started:6.1f}s {str(exc)[:1500]}", flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
