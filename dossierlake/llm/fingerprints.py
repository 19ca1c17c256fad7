"""Document fingerprints: context-triggered piecewise hashing.

A hash over the last seven bytes rolls over the UTF-8 text. Where it falls below 2^32 / block size a
piece ends, so boundaries depend on content alone and an edit disturbs only the pieces it touches. Each
piece gives one of 64 letters; the letters at a block size and at its double make the signature. Block
sizes are powers of two, chosen from the length of the text and the boundaries found, so that a
signature has some tens of letters whatever the length.

Defined cases: a null text is the empty text; the empty text has the fingerprint `4::`; equal texts have
equal fingerprints and likeness 1; an empty text is unlike any other (0).
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm.common import bin_of, range_bounds

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
FEWEST, MOST = 32, 128
SMALLEST_LEVEL = 2
PIECE_OF_TEXT = 1 << 20
MULTIPLIER = 0x9E3779B1

POWERS = [np.uint32(pow(MULTIPLIER, j, 1 << 32)) for j in range(WINDOW)]
SCRAMBLED = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)


def rolled(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The hash of the seven bytes that end at each place, block by block."""
    for start in range(0, len(data), PIECE_OF_TEXT):
        lead = min(start, WINDOW - 1)
        block = SCRAMBLED[np.frombuffer(data, np.uint8, min(PIECE_OF_TEXT, len(data) - start) + lead, start - lead)]
        values = np.zeros(len(block), np.uint32)
        for j, power in enumerate(POWERS):
            values[j:] += block[: max(0, len(block) - j)] * power
        values = values[lead:]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(12)
        yield start, values


def boundaries(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the boundaries at block size 2^level; those of larger sizes are among them."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for start, values in rolled(data):
        hit = np.flatnonzero(values < np.uint32(1 << (32 - level)))
        places.append(hit + start)
        hashes.append(values[hit])
    return np.concatenate(places), np.concatenate(hashes)


def letters(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    return "".join(LETTERS[zlib.crc32(view[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    level = max(SMALLEST_LEVEL, int(np.ceil(np.log2(max(len(data), 1) / 64))))
    low = max(SMALLEST_LEVEL, level - 2)
    places, hashes = boundaries(data, low)
    while len(places) < FEWEST and low > SMALLEST_LEVEL:
        low = max(SMALLEST_LEVEL, low - 4)
        places, hashes = boundaries(data, low)

    def at(k: int) -> np.ndarray:
        return places[hashes < np.uint32(1 << (32 - k))]

    while len(at(level)) > MOST and level < 30:
        level += 1
    while level > low and len(at(level)) < FEWEST and len(at(level - 1)) <= MOST:
        level -= 1
    return f"{1 << level}:{letters(data, at(level))}:{letters(data, at(level + 1))}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def short_runs(letters_: str) -> str:
    """Runs of more than three equal letters, which say little, cut to three."""
    return "".join(x for i, x in enumerate(letters_) if letters_[max(0, i - 3) : i] != x * 3)


def alike(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths; 0 where no few letters in a row agree."""
    a, b = short_runs(a), short_runs(b)
    if not a or not b:
        return 0.0
    size = max(2, min(4, min(len(a), len(b)) // 3))
    if len(min(a, b, key=len)) < size:
        return 1.0 if a == b else 0.0
    grams = {a[i : i + size] for i in range(len(a) - size + 1)}
    if not any(b[i : i + size] in grams for i in range(len(b) - size + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1, from the signatures at the block sizes that both fingerprints have."""
    if one == other:
        return 1.0
    size1, *parts1 = one.split(":")
    size2, *parts2 = other.split(":")
    have1 = {int(size1): parts1[0], 2 * int(size1): parts1[1]}
    have2 = {int(size2): parts2[0], 2 * int(size2): parts2[1]}
    return max((alike(have1[s], have2[s]) for s in have1.keys() & have2.keys()), default=0.0)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the fingerprint of every row's whole text; one pass, no shuffle."""

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    return docs.select(key, printed(F.coalesce(text, F.lit(""))).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEIGHBOUR_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def with_following(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bin, halo, doc_id): each is joined with the next row of its bin; halo rows only follow."""
    held = None
    for batch in batches:
        out = []
        for place, halo, doc_id, text in zip(batch["bin"], batch["halo"], batch["doc_id"], batch["text"], strict=True):
            if halo and (held is None or held[0] != place):
                continue
            row = (place, doc_id, text, fingerprint(text))
            if held is not None and held[0] == place:
                changed = edited(held[2], text)
                print_ = fingerprint(changed)
                out.append((
                    held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    held[3], print_, likeness(held[3], print_), likeness(held[3], row[3]),
                ))
            held = None if halo else row
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in NEIGHBOUR_SCHEMA.split(",")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def fingerprints_with_next(docs: DataFrame, bins: int = 1024) -> DataFrame:
    """Fingerprints of every text, of its edit with the following document's text, and how near both are.

    Documents follow each other by ascending doc_id, the first after the last. They are cut into `bins`
    ranges of ids; the first row of a range is sent to the range before as well, so the ranges are
    processed alone, each as a sorted stream, and only once shuffled. Rows without an id sort before all
    others; rows of one id are taken in the order of their texts. A single row follows itself.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", bins) or [0]
    last = len(bounds)
    place = F.greatest(bin_of(F.col("doc_id"), bounds), F.lit(1))
    lone = rows.where("doc_id IS NULL").limit(1).count() > 0
    first_of_all = F.col("doc_id").isNull() if lone else F.col("doc_id") == bounds[0]
    leads = (F.element_at(F.lit(bounds), F.col("place")) == F.col("doc_id")) & (F.col("place") > 1)
    before = F.when(first_of_all, F.lit(last)).when(leads, F.col("place") - 1)
    own = F.struct(F.col("place").alias("bin"), F.lit(0).alias("halo"))
    copy = F.struct(before.cast("int").alias("bin"), F.lit(1).alias("halo"))
    return (
        rows.withColumn("place", place.cast("int"))
        .withColumn("to", F.explode(F.when(before.isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("to.bin", "to.halo", "doc_id", "text")
        .repartition("bin").sortWithinPartitions("bin", "halo", F.asc_nulls_first("doc_id"), "text")
        .mapInPandas(with_following, NEIGHBOUR_SCHEMA)
    )
