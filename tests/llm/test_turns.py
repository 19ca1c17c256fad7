"""Conversation repair against a plain loop over each conversation."""

from collections import defaultdict
from functools import lru_cache
import hashlib
import random
import re
import sys
import zlib

import duckdb
import pytest

from dossierlake.llm import queries, turns

sys.setrecursionlimit(20000)  # for the plain recursion over long conversations
SF = "/root/testdata/sf0.01"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
OPEN_END = re.compile(r"(?s).*[.!?][\x20\x09-\x0D]*\Z")


def cheapest(roles, faults):
    """Cost and least audit by trying every edit in every state of the grammar; up to three inserts in a row."""

    @lru_cache(None)
    def go(i, state, inserts):
        options = [(0, "")] if i == len(roles) and state in "0a" else []
        wanted = "a" if state == "u" else "u"

        def step(cost, letter, *to):
            rest = go(*to)
            if rest:
                options.append((cost + rest[0], letter + rest[1]))

        if inserts < 3:
            step(turns.INSERT, "I", i, wanted, inserts + 1)
        if i < len(roles):
            role, fault = roles[i], faults[i]
            step(turns.DELETE, "D", i + 1, state, 0)
            if fault < 2:
                extra = turns.TRUNCATED if fault == 1 else 0
                step(extra, "K", i + 1, wanted, 0) if role == wanted else step(extra + turns.REROLE, "R", i + 1, wanted, 0)
                if role == "s" and state == "0":
                    step(extra, "K", i + 1, "s", 0)
        return min(options) if options else None

    return go(0, "0", 0)


def plain(rows):
    """The result of op13 for rows of (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        group = groups[conv_id]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        group += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (2 if kind == 3 else 1)
    for conv_id, group in groups.items():
        group.sort()
        faults, seen = [], set()
        for _, _, role, _, text in group:
            faults.append(2 if BLANK.match(text) else 3 if (role, text) in seen else 0 if OPEN_END.match(text) else 1)
            seen.add((role, text))
        numbers = [g[1] for g in group if g[0]]
        initials = [g[2][:1] for g in group]
        yield_gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest(tuple(initials), tuple(faults))
        lines, i = [], 0
        for letter in audit:
            wanted = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter == "I":
                lines.append(wanted + ":")
                continue
            if letter != "D":
                lines.append((group[i][2] if letter == "K" else wanted) + ":" + group[i][4])
            i += 1
        yield (conv_id, yield_gaps, faults.count(2), faults.count(3), faults.count(1),
               sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compared(found, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    return got


def test_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = compared(queries.op13_wagner_fischer(spark, SF), [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert all(sum(r[k] for r in got) for k in range(1, 7))


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (1, 2, 1, 5), (3, 2, 1, 1), (2, 3, 1, 2)])
def test_alignment_against_all_edits(monkeypatch, costs):
    """Other costs too, because with those of the query an insert never pays."""
    for name, value in zip(("REROLE", "DELETE", "INSERT", "TRUNCATED"), costs, strict=True):
        monkeypatch.setattr(turns, name, value)
    ends = tuple(turns.INSERT * turns.CLOSING[state] for state in range(4))
    turns.cheapest.cache_clear()
    rng = random.Random(5)
    for _ in range(400):
        codes = [rng.choice([0, 4, 4, 8, 8, 12, 5, 9, 6, 11, 1]) for _ in range(rng.randint(0, 9))]
        text = "".join(chr(65 + c) for c in codes)
        expected = cheapest(tuple("suax"[c // 4] for c in codes), tuple(c % 4 for c in codes))
        assert turns.cheapest(text, turns.START, ends, True)[:2] == expected
    turns.cheapest.cache_clear()


def test_long_conversations_are_cut_into_blocks(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "user", "", None]
    rows = [(c, t, rng.choice(roles[:4]) if rng.random() < 0.8 else rng.choice(roles), f"{rng.choice('abc')} {rng.randint(0, n)}{rng.choice(['.', '!', '', ' . '])}")
            for c, n in ((1, 400), (2, 60), (3, 5), (4, 33), (None, 90)) for t in range(n)]
    rows += [(2, None, "user", "early."), (2, None, "system", "first."), (1, 7, "assistant", "again."), (1, 7, "assistant", "again."), (None, None, None, None)]
    rng.shuffle(rows)
    schema = "conv_id bigint, turn bigint, role string, text string, digest string, block string, copy string, conv string, step string"
    table = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    got = compared(turns.repaired(table.repartition(5)), rows)
    assert len(max((r[7] for r in got), key=len)) > 10 * turns.BLOCK


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    rows = [(9, gone, "user", "all of it goes."), (8, None, None, None), (7, 1, "user", ""), (6, 1, "user", "ä" * 300000 + "."), (6, 2, "assistant", "x."),
            (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "assistant", "same.")]
    got = compared(turns.repaired(spark.createDataFrame(rows, schema)), rows)
    assert (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert turns.repaired(spark.createDataFrame([], schema)).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "assistant", "y."), (None, 1, "user", "z.")], schema.replace("conv_id bigint", "conv_id string"))
    assert {r["conv_id"] for r in turns.repaired(named).collect()} == {"a", None}


def test_sql_gives_the_plain_result():
    """The checking SQL against the plain loop."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(queries.ORACLES["op13_wagner_fischer"])
    assert tuple(d[0] for d in found.description) == COLUMNS
    assert sorted(found.fetchall()) == sorted(plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
