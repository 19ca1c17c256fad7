"""Repair of conversation structure by Wagner-Fischer alignment with target strings of the role grammar.

The grammar is `(s?(ua)+)?`. A turn is one symbol: its role's initial and its first fault. A conversation is
cut into blocks of at most `BLOCK` turns. A block is aligned, from a state of the grammar, with each target
string of feasible length; only cells in the Ukkonen band that the cheapest alignment so far leaves open are
filled. Alignments of the cheapest lengths are traced back as audits, each step taking the ASCII-least
edit that is still cheapest, and the least audit is kept. Inserts stand before the turn they precede, so
no audit of a block is the beginning of another and blocks can be decided one by one.

Most conversations are one block. Longer ones, also one that holds most of the table, are blocks in several
tasks: their cheapest costs between states (at most 4 x 4 numbers a block) are chained from the last block to the
first, audits for each entry state follow in parallel, and one pass from the first block on picks them. Turns
are ordered by range partitions of (conversation, turn), never by collecting a conversation. Only the two values that
the whole conversation defines, the audit string and the digest of the repaired text, are put together in
one task; the digest is fed turn by turn from sorted rows.

Defined cases: a null role or text is one space, and so is a null in `conv_id:turn`; rows without a conv_id are
one conversation; rows without a turn come first; turns of equal number are ordered by role and digest of the text, copies
next to each other; a role without initial fits nowhere; an empty table gives no row; further columns of any name are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.llm.common import checkpoint

SPACE = r"\x20\x09-\x0D"
CLASSES, FAULTS = "suax", ("", "truncated", "blank", "duplicate")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 32
START, SYSTEM, USER, ASSISTANT = range(4)  # nothing yet, after s, after u, after a
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # turns missing at the end of a conversation
NEVER = 1 << 60
END = tuple(INSERT * CLOSING[state] for state in range(4))


def symbol(role: Column, fault: Column) -> Column:
    """One letter, A to P: class of the initial times four plus the number of the fault."""
    initial = F.left(role, F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    return F.char(F.lit(65) + place + fault)


def target(state: int, length: int, system: bool) -> str:
    """The grammar's string of that length from a state on."""
    first = "au" if state == USER else "ua"
    return ("s" + first * length)[:length] if system else (first * length)[:length]


def after(state: int, wanted: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[wanted[-1]] if wanted else state


class Needs:
    """The turns of a block, and from each turn on: what has to be paid at least, how many can stay, how many stay free."""

    def __init__(self, turns: str):
        codes = [ord(t) - 65 for t in turns]
        self.roles = [CLASSES[c // 4] for c in codes]
        self.faults = [c % 4 for c in codes]
        self.least, self.able, self.free = ([0] * (len(codes) + 1) for _ in range(3))
        for i in range(len(codes) - 1, -1, -1):
            fault = self.faults[i]
            self.least[i] = self.least[i + 1] + (min(DELETE, TRUNCATED) if fault == 1 else DELETE if fault else 0)
            self.able[i] = self.able[i + 1] + (fault < 2)
            self.free[i] = self.free[i + 1] + (fault == 0)

    def bound(self, length: int) -> int:
        """No alignment with a target string of that length is cheaper."""
        return self.least[0] + INSERT * max(0, length - self.able[0]) + DELETE * max(0, self.free[0] - length)


def aligned(needs: Needs, wanted: str, last: int, limit: int) -> tuple[int, str]:
    """Cost, `last` included, and least audit of aligning the turns with the string, if it is at most `limit`.

    Else (NEVER, ""). No insert follows the last turn.
    """
    least, able, free = needs.least, needs.able, needs.free
    n, size, slack = len(needs.roles), len(wanted), limit - last - least[0]
    if slack < 0:
        return NEVER, ""
    more, fewer = slack // INSERT, slack // DELETE
    rows: list[dict[int, int]] = [{}] * n + [{size: last}]
    for i in range(n - 1, -1, -1):
        low = max(0, size - able[i] - more, free[0] - free[i] - fewer)
        high = min(size, size - free[i] + fewer, able[0] - able[i] + more)
        below, here, role, fault = rows[i + 1], {}, needs.roles[i], needs.faults[i]
        stay, ahead = TRUNCATED if fault == 1 else 0, NEVER
        for j in range(high, low - 1, -1):
            cost = below.get(j, NEVER) + DELETE
            if j < size:
                want = wanted[j]
                if fault < 2 and (want == role or want != "s"):
                    cost = min(cost, below.get(j + 1, NEVER) + stay + (KEEP if want == role else REROLE))
                if want != "s":
                    cost = min(cost, ahead + INSERT)
            ahead = cost
            if cost < NEVER:
                here[j] = cost
        rows[i] = here
    total = rows[0].get(0, NEVER)
    if total > limit:
        return NEVER, ""
    audit, i, j, cost = [], 0, 0, total
    while i < n:
        stay = TRUNCATED if needs.faults[i] == 1 else 0
        if cost == rows[i + 1].get(j, NEVER) + DELETE:
            step, i, cost = "D", i + 1, cost - DELETE
        elif j < size and wanted[j] != "s" and cost == rows[i].get(j + 1, NEVER) + INSERT:
            step, j, cost = "I", j + 1, cost - INSERT
        elif wanted[j] == needs.roles[i]:
            step, i, j, cost = "K", i + 1, j + 1, cost - stay - KEEP
        else:
            step, i, j, cost = "R", i + 1, j + 1, cost - stay - REROLE
        audit.append(step)
    return total, "".join(audit)


@lru_cache(maxsize=1 << 15)
def cheapest(turns: str, state: int, ends: tuple[int, ...], closing: bool) -> tuple[int, str, int]:
    """Cost, least audit and last state of the cheapest way from a state on, where leaving in state q costs ends[q].

    `closing` says that the conversation ends here, so the audit has the inserts that end it.
    """
    needs, best = Needs(turns), (NEVER, "", state)
    longest = 2 * len(turns) + 2  # between two turns that stay, two inserts next to each other are never needed
    wanted = [target(state, k, False) for k in range(longest + 1)]
    if state == START and ("A" in turns or "B" in turns):
        wanted += [target(state, k, True) for k in range(1, longest + 1)]
    bounds = sorted((needs.bound(len(w)) + ends[after(state, w)], w) for w in wanted)
    for bound, string in bounds:
        if bound > best[0] or bound >= NEVER:
            break
        final = after(state, string)
        most = (DELETE + TRUNCATED + REROLE) * len(turns) + INSERT * len(string) + ends[final]
        cost, audit = aligned(needs, string, ends[final], min(best[0], most))
        if closing:
            audit += "I" * CLOSING[final]
        if cost < NEVER and (best[0] == NEVER or (cost, audit) < best[:2]):
            best = (cost, audit, final)
    return best


def illegal_pairs(turns: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    roles = [CLASSES[(ord(t) - 65) // 4] for t in turns]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of `conv_id:turn` decides."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(name) % 20).alias("kind")
    given = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy and symbol of every turn; texts are left behind.

    Equal turns are counted before anything moves; the first of equal role and text is found by a minimum, so a
    text said a million times in one conversation is no group of its own in a task.
    """
    text = F.col("text")
    blank, open_end = ~text.rlike(f"[^{SPACE}]"), ~text.rlike(rf"[.!?][{SPACE}]*\z")
    keys = ("conv_id", "turn", "role", "digest")
    found = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), "copies",
                        F.when(blank, 2).when(open_end, 1).otherwise(0).alias("fault"))
    counted = found.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.max("fault").alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = counted.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first")).select(
        "conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(True).alias("new"))
    marks = counted.unionByName(first, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("copies").alias("copies"), F.max("fault").alias("fault"), F.max("new").alias("new"))
    each = marks.select(*keys, "fault", "new", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    fault = F.when(F.col("fault") == 2, 2).when(F.col("new") & (F.col("copy") == 1), F.col("fault")).otherwise(3)
    return each.select(*keys, "copy", symbol(F.col("role"), fault).alias("symbol"))


def blocks(turns: DataFrame) -> DataFrame:
    """Runs of at most `BLOCK` turns of one conversation: `block`, rising in the order of the turns, `rows` and `symbols`.

    Ranges of (conversation, turn) are sorted in parallel, so one conversation may run through many tasks; only
    the turns of a block, equal in number for all, meet in a group.
    """
    order = (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "copy")
    placed = checkpoint(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = F.sort_array(F.collect_list(F.struct("at", "turn", "role", "digest", "copy", "symbol"))).alias("rows")
    return placed.groupBy("conv_id", F.shiftright("at", BLOCK.bit_length() - 1)).agg(rows).select(
        "conv_id", F.col("rows")[0]["at"].alias("block"), "rows", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"))


AUDIT = "struct<audit: string, cost: bigint, illegal: bigint>"
WAYS = "array<struct<audit: string, state: int, cost: bigint>>"


def alone(symbols: pd.Series) -> pd.DataFrame:
    """The audit of conversations that are one block."""
    found = [cheapest(s, START, END, True) for s in symbols]
    return pd.DataFrame({"audit": [f[1] for f in found], "cost": [f[0] for f in found], "illegal": [illegal_pairs(s) for s in symbols]})


def between(symbols: pd.Series) -> pd.Series:
    """Cheapest cost of a block from each state (four to a row) to each state."""
    only = [tuple(0 if q == end else NEVER for q in range(4)) for end in range(4)]
    return pd.Series([[min(cheapest(s, p, only[q], False)[0], NEVER) for p in range(4) for q in range(4)] for s in symbols])


def ways(symbols: pd.Series, ends: pd.Series, closing: pd.Series) -> pd.Series:
    """For each entry state the audit, the last state, and the cost from there to the end of the conversation."""
    found = []
    for s, e, c in zip(symbols, ends, closing, strict=True):
        tried = [cheapest(s, p, tuple(int(x) for x in e), bool(c)) for p in range(4)]
        found.append([{"audit": audit, "state": state, "cost": cost} for cost, audit, state in tried])
    return pd.Series(found)


def chained(parts: DataFrame) -> DataFrame:
    """conv_id, block, audit, cost and illegal for the blocks of conversations of several blocks.

    Both passes read sorted rows as a stream and remember four numbers; they see one row for `BLOCK` turns.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ends = False, END
        current = None
        for batch in batches:
            all_ends, closing = [], []
            for conv, costs in zip(batch["conv"], batch["costs"], strict=True):
                new = not known or conv != current
                if new:
                    known, current, ends = True, conv, END
                all_ends.append(list(ends))
                closing.append(new)
                ends = tuple(min(NEVER, *(int(costs[4 * p + q]) + ends[q] for q in range(4))) for p in range(4))
            yield pd.DataFrame({"block": batch["block"], "ends": all_ends, "closing": closing})

    def forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, current, state, before = False, None, START, ""
        for batch in batches:
            out = []
            for conv, block, symbols, found in zip(batch["conv"], batch["block"], batch["symbols"], batch["ways"], strict=True):
                new = not known or conv != current
                if new:
                    known, current, state, before = True, conv, START, ""
                way = found[state]
                out.append((block, way["audit"], way["cost"] if new else 0, illegal_pairs(before + symbols)))
                state, before = way["state"], symbols[-1]
            yield pd.DataFrame(out, columns=["block", "audit", "cost", "illegal"])

    # A name as text, because a null and a missing number are one in pandas.
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    priced = parts.select(conv, "block", F.pandas_udf(between, "array<bigint>")("symbols").alias("costs")).repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    ends = priced.mapInPandas(backwards, "block bigint, ends array<bigint>, closing boolean")
    tried = parts.join(ends, "block").select(conv, "block", "symbols", F.pandas_udf(ways, WAYS)("symbols", "ends", "closing").alias("ways"))
    chosen = tried.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(
        forwards, "block bigint, audit string, cost bigint, illegal bigint")
    return parts.select(F.col("conv_id").cast(kind).alias("conv_id"), "block").join(chosen, "block").select("conv_id", "block", "audit", "cost", "illegal")


def audits(parts: DataFrame) -> DataFrame:
    """conv_id, block, audit, cost (of the conversation, at its first block) and illegal of every block."""
    sizes = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("block"), F.min("symbols").alias("symbols"))
    single = sizes.where("n = 1").withColumn("found", F.pandas_udf(alone, AUDIT)("symbols")).select("conv_id", "block", "found.*")
    several = sizes.where("n > 1").select(F.col("conv_id").alias("long"))
    rest = checkpoint(parts.select("conv_id", "block", "symbols").join(several, F.col("conv_id").eqNullSafe(F.col("long")), "left_semi"))
    return single.unionByName(chained(rest))


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the repaired `role:text` lines.

    Edits and texts of a turn lie next to each other after one sort; a digest takes its turns one by one, so no
    conversation is held. Deleted turns are passed over.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    keys = ("conv_id", "turn", "role", "digest")
    none = F.lit(None)
    texts = rows.select(*keys[:3], F.unhex(F.sha2("text", 256)).alias("digest"), none.cast("bigint").alias("copy"),
                        none.cast("string").alias("step"), F.col("text").cast("binary").alias("text"))
    both = edits.select(*keys, "copy", "step", none.cast("binary").alias("text")).unionByName(texts)
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    ordered = both.withColumn("conv", name).repartition("conv").sortWithinPartitions(
        "conv", F.asc_nulls_first("turn"), "role", "digest", F.asc_nulls_last("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv_id, sha, state, lines, key, steps = None, None, None, START, 0, None, []

        def say(role: str, text: bytes = b"") -> None:
            nonlocal lines, state
            sha.update((b"\n" if lines else b"") + role.encode() + b":")
            sha.update(text)
            lines += 1
            state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)

        def expected() -> str:
            return "assistant" if state == USER else "user"

        def closed() -> list:
            for _ in range(CLOSING[state]):
                say(expected())
            return [(conv_id, sha.hexdigest())] if lines else []

        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("conv", "conv_id", "turn", "role", "digest", "step", "text")]
            for conv, whole_id, turn, role, digest, step, text in zip(*columns, strict=True):
                conv = conv.as_py()
                if conv != current:
                    out += closed() if current is not None else []
                    current, conv_id, sha, state, lines, steps = conv, whole_id.as_py(), hashlib.sha256(), START, 0, []
                step = step.as_py()
                if step is not None:
                    steps.append(step)
                elif steps:
                    role, text = role.as_py(), text.as_py()
                    for step in steps:
                        for _ in range(len(step) - 1):
                            say(expected())
                        if step[-1] != "D":
                            say(role if step[-1] == "K" else expected(), text)
                    steps = []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if current is not None:
            out = closed()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], columns[1].type), pa.array([r[1] for r in out], pa.string())],
                                             names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit of the repair, digest of the repaired text."""
    rows = damaged(conversations)
    turns = turn_rows(rows)
    parts = checkpoint(blocks(turns))
    found = checkpoint(audits(parts))
    each = F.inline(F.arrays_zip(F.col("rows"), F.regexp_extract_all("audit", F.lit("(I*[DKR])"), F.lit(1)).alias("step")))
    edits = found.select("block", "audit").join(parts.select("conv_id", "block", "rows"), "block").select("conv_id", each).where("step <> 'D'").select(
        "conv_id", "rows.turn", "rows.role", "rows.digest", "rows.copy", "step")
    fault = (F.ascii("symbol") - 65) % 4
    counts = [F.sum((fault == k).cast("bigint")).alias(name) for k, name in enumerate(FAULTS) if k]
    states = parts.select("conv_id", F.inline("rows"))
    per_turn = states.groupBy("conv_id", "turn").agg(*counts)
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    stats = per_turn.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(name).alias(name) for name in FAULTS[1:]])
    repairs = found.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    everything = conversations.select("conv_id").distinct()
    for part in (stats, repairs, digests(rows, edits)):
        everything = everything.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", *FAULTS[2:], FAULTS[1], "illegal", "cost")
    return everything.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
