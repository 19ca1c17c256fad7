"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: shifted left by one bit and increased by a value of the next byte,
in 16 bits, so it depends on the last 16 bytes alone. A chunk ends where the hash is the least of some
`SPAN` places in a row, hence at the same places of a passage wherever the passage stands; no chunk is longer than
`SPAN` bytes (but of text that repeats itself), so a repeated passage of `SURE` bytes always holds whole chunks, which
reach to less than `MARGIN` bytes from its ends. From each chunk on, chunks are taken together until they have `LEAST`
bytes, because a short chunk alone is shared by chance; such runs are compared by a 64-bit digest, and one that another
document has as well is a seed.

Chunks are cut by the ends of a passage, so seeds say only where to look: within `MARGIN` characters of a seed every
window of `PASSAGE_WORDS` words is hashed over all its characters and compared by a 64-bit hash. Windows that other
documents have as well and that overlap make a passage, which so reaches to its last whole words. Windows that
occur in an earlier document and windows that occur here first make passages of their own, which may overlap.
A passage of fewer than `SURE` bytes is found if a whole chunk of it or near it is shared.
Windows are hashed once and written down, and are compared in `PARTS` parts by their hash, one after the other, so that the
shuffle files of one part only are on disk.

A word is what stands between white space; in scripts written without it (Chinese, Japanese, Thai, Lao, Khmer,
Burmese) every character counts as a word.

Defined cases: null and empty texts have no chunks; repeated rows of one doc_id are one document, and its
texts are laid over each other where they differ; rows without a doc_id take part in nothing; a passage that
only its own document repeats is not reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
import xxhash

from dossierlake.llm.common import checkpoint, shared_folder, stored

WINDOW, SPAN = 16, 63
LEAST = 40
SURE, MARGIN = WINDOW + 4 * SPAN, WINDOW + 2 * SPAN + LEAST
PASSAGE_WORDS = 20
PARTS = 4
BLOCK = 1 << 20
GEAR = np.random.default_rng(11).integers(0, 1 << WINDOW, 256, dtype=np.uint16)


def gear_hashes(block: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sums over 1, 2, 4, 8 and 16 bytes, each from two of the half length."""
    values = GEAR[block]
    reach = 1
    while reach < WINDOW:
        longer = values.copy()
        if reach < len(values):
            longer[reach:] += values[:-reach] << np.uint16(reach)
        values, reach = longer, 2 * reach
    return values


def least_in_span(values: np.ndarray) -> np.ndarray:
    """The least of `values` over each SPAN places in a row, doubling the length of the row."""
    reach = 1
    while 2 * reach <= SPAN:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    return np.minimum(values[: len(values) - (SPAN - reach)], values[SPAN - reach :])


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks; none lies inside a character. The text's end always is one.

    Text that repeats itself within WINDOW bytes has the same hash again and again; of such ends one in SPAN // 2
    bytes is taken, counted from the first.
    """
    raw = np.frombuffer(data, np.uint8)
    ends, marks = [np.empty(0, np.int64)], [np.empty(0, np.uint16)]
    for start in range(0, len(data), BLOCK):
        stop = min(start + BLOCK, len(data))
        low, high = max(0, start - SPAN + 1), min(stop + SPAN - 1, len(data))
        lead = min(low, WINDOW - 1)
        values = gear_hashes(raw[low - lead : high])[lead:]
        inside = (raw[low + 1 : high + 1] & 0xC0) == 0x80
        values[: len(inside)][inside] = 0xFFFF
        if len(values) < SPAN:
            continue
        least = least_in_span(values)
        edge = np.zeros(SPAN - 1, np.uint16)
        most = 0xFFFF - least_in_span(0xFFFF - np.concatenate([edge, least, edge]))
        hit = np.flatnonzero((values == most) & (values < 0xFFFF))
        hit = hit[(hit + low >= start) & (hit + low < stop)]
        ends.append(hit + low + 1)
        marks.append(values[hit])
    found, mark = np.concatenate(ends), np.concatenate(marks)
    if len(found):
        alike = np.concatenate([[False], (np.diff(found) <= WINDOW) & (mark[1:] == mark[:-1])])
        first = np.maximum.accumulate(np.where(alike, 0, np.arange(len(found))))
        step = (found - found[first]) // (SPAN // 2)
        found = found[~alike | np.concatenate([[False], step[1:] != step[:-1]])]
    found = found[found < len(data)]
    return np.append(found, len(data)) if len(data) else found


def packed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Start and end in one number."""
    return starts.astype(np.int64) << 32 | ends.astype(np.int64)


def batch_of(columns: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], [c.split()[0] for c in schema.split(", ")])


CHUNKS = "doc_id bigint, place bigint, digest bigint"


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[np.ndarray]] = [[], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            if not data:
                continue
            ends = boundaries(data)
            starts = np.concatenate([[0], ends[:-1]])
            points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            stops = ends[np.minimum(np.searchsorted(ends, starts + LEAST), len(ends) - 1)]
            long = (stops - starts >= LEAST) | (starts == 0)
            starts, stops = starts[long], stops[long]
            digests = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            columns = (np.full(len(starts), doc_id), packed(points[starts], points[stops]), np.array(digests, np.uint64).view(np.int64))
            for held, column in zip(parts, columns, strict=True):
                held.append(column)
        if parts[0]:
            yield batch_of(parts, CHUNKS)


# Scripts without spaces between words (Thai, Lao; Burmese; Khmer; kana; Han and its extensions).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as code points."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    alone = np.zeros(len(points), bool)
    if len(points) and points.max() >= UNSPACED[0][0]:
        for low, high in UNSPACED:
            alone |= (points >= low) & (points <= high)
    cut = np.ones(len(points) + 1, bool)
    cut[1:-1] = space[1:] | space[:-1] | alone[1:] | alone[:-1]
    return np.flatnonzero(cut[:-1] & ~space), np.flatnonzero(cut[1:] & ~space) + 1


BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the characters of each span: differences of one polynomial's running sums, shifted to the span's start."""
    size = 1 << max(16, len(points).bit_length())
    values = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, size)[: len(points)], dtype=np.uint64)])
    out = (sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), size)[starts]
    return out ^ out >> np.uint64(31)


WINDOWS = "doc_id bigint, word bigint, place bigint, digest bigint"


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of PASSAGE_WORDS words that lies within MARGIN characters of seeds."""
    for batch in batches:
        for doc_id, text, seeds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            points = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
            starts, ends = words_of(points)
            starts, ends = starts[: max(0, len(starts) - PASSAGE_WORDS + 1)], ends[PASSAGE_WORDS - 1 :]
            places = seeds.values.to_numpy()
            change = np.zeros(len(points) + 1, np.int64)
            # a row of a repeated doc_id can be shorter than the one that a seed comes from
            np.add.at(change, np.clip((places >> 32) - MARGIN, 0, len(points)), 1)
            np.add.at(change, np.clip((places & 0xFFFFFFFF) + MARGIN, 0, len(points)), -1)
            near = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
            held = np.flatnonzero(near[ends] - near[starts] == ends - starts)
            if len(held):
                digests = span_hashes(points, starts[held], ends[held]).view(np.int64)
                yield batch_of([[np.full(len(held), doc_id)], [held], [packed(starts[held], ends[held])], [digests]], WINDOWS)


def shared(rows: DataFrame) -> DataFrame:
    """digest, first_doc_id and times of the digests that more than one document has.

    Counts are combined before they are shuffled; a digest that very many rows have meets its count in a
    join, which Spark splits, and is never gathered.
    """
    counts = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count(F.lit(1)).alias("times"))
    return counts.where("first_doc_id < last_doc_id").select("digest", "first_doc_id", "times")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (code points), words, occurrences (of its rarest window), first_doc_id, kept; one row per passage.

    A row with `kept` false holds the words of windows that occur in an earlier document; first_doc_id is the last of
    the documents in which its windows first occur.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    path = shared_folder(docs.sparkSession, "passages")
    chunks = rows.mapInArrow(chunks_of, CHUNKS)
    seeds = stored(chunks.join(shared(chunks).select("digest"), "digest").groupBy("doc_id").agg(F.collect_list("place").alias("seeds")), f"{path}/seeds")
    hashed = rows.join(seeds, "doc_id").mapInArrow(windows_of, WINDOWS)
    windows = stored(hashed.withColumn("part", F.pmod("digest", F.lit(PARTS)).cast("int")), f"{path}/windows", "part")
    for part in range(PARTS):
        some = windows.where(F.col("part") == part).drop("part")
        found = stored(some.join(shared(some), "digest").drop("digest"), f"{path}/found", mode="append")
    found = found.withColumn("kept", F.col("first_doc_id") == F.col("doc_id"))
    order = Window.partitionBy("doc_id", "kept").orderBy("word")
    apart = F.col("word") >= F.lag("word").over(order) + PASSAGE_WORDS
    runs = found.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("apart").over(order))
    return runs.groupBy("doc_id", "kept", "run").agg(
        F.min(F.shiftright("place", 32)).cast("int").alias("start"), F.max(F.col("place").bitwiseAND(0xFFFFFFFF)).cast("int").alias("end"),
        (F.max("word") + PASSAGE_WORDS - F.min("word")).alias("words"), F.min("times").alias("occurrences"),
        F.max("first_doc_id").alias("first_doc_id")).select("doc_id", "start", "end", "words", "occurrences", "first_doc_id", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with all but the first occurrence of every passage cut out of the texts.

    What an earlier document has is cut out, also next to or inside of a passage that first occurs here as a whole.
    """
    passages = checkpoint(repeated_passages(docs).where("NOT kept"))
    cuts = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    joined = docs.join(cuts, "doc_id", "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    kept = F.aggregate("_cuts", begin, lambda s, c: F.struct(
        c["end"].alias("at"), F.concat(s["done"], F.col("text").substr(s["at"] + 1, c["start"] - s["at"])).alias("done")),
        lambda s: F.concat(s["done"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
