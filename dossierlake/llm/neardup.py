"""MinHash near-dedup by an inverted join on signature coordinates.

A document is the set of its five-word shingles (64-bit hashes of lower-cased words). Its signature has
`COORDINATES` coordinates, each a hash of four minima, and the document is posted under every
(coordinate, value) pair. Two documents of Jaccard similarity 0.75 agree in a coordinate with
probability 0.75^4, so `ENOUGH` coordinates all miss such a pair about once in 100,000 times.

Merging the postings never lists the pairs of a group:

1. Documents of equal sets fold into one class before anything is posted.
2. Every member of a posting list meets only the list's smallest set; the pairs found are counted and
   confirmed on the full sets, and confirmed links are joined into components. Sets that are alike
   because of a passage in all of them are most alike with the smallest of them.
3. Lists whose members are then all in one component are skipped whole. Of the rest only pairs across
   components are left. Lists of up to `DIRECT` members give these pairs directly. Longer ones come from
   passages that many documents share, and most of their pairs are not similar. They are skipped for a
   document that keeps `ENOUGH` coordinates outside of them. The others, mostly made of such passages, are
   posted under their rarest shingles instead, which loses none, and meet only if the rest of both sets, from the
   shared shingle on, is large enough: first the smallest set of each such list and one document in `HUBS`
   with all others, then what is still in different components. All pairs are confirmed in the same way.

Defined cases: a null or blank text has no shingles and is linked with nothing; with fewer than five
words the whole sequence is the one shingle; rows without a doc_id are linked with nothing, have no
component and are kept; rows that share a doc_id count as one document with the links of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.llm.common import checkpoint

SHINGLE_WORDS = 5
PERCENT = 75
COORDINATES, MINIMA = 36, 4
MATCHES = 1
DIRECT, ENOUGH = 32, 32
HUBS = 16
NODES = 1 << 20
BLOCK = 1 << 22
COLUMNS_AT_ONCE = 4096

RANDOM = np.random.default_rng(20)
BYTE_VALUES = RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_STEP, WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FACTORS = RANDOM.integers(1, 1 << 32, COORDINATES * MINIMA, dtype=np.uint32) | np.uint32(1)
SHIFTS = RANDOM.integers(1, 1 << 32, COORDINATES * MINIMA, dtype=np.uint32)
JOINING = RANDOM.integers(1, 1 << 63, (COORDINATES, MINIMA), dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


def powers(step: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, step, np.uint64)]))


LETTER_POWERS = powers(BYTE_STEP, 4096)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased; blocks end between words."""
    found, start = [], 0
    while start < len(data):
        end = min(len(data), start + BLOCK)
        while end < len(data) and not IS_SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - start, start)
        inside = ~IS_SPACE[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            lengths = ends - starts
            offsets = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            table = LETTER_POWERS if lengths.max() <= len(LETTER_POWERS) else powers(BYTE_STEP, int(lengths.max()))
            values = LOWER_VALUES[raw[inside]] * table[offsets]
            found.append(mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)))
        start = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    steps = powers(WORD_STEP, size)
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i : len(hashes) - size + 1 + i] * steps[i]
    return np.unique(mixed(total))


def signature(values: np.ndarray) -> np.ndarray:
    """One 64-bit number per coordinate, equal where all of its minima are."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), COLUMNS_AT_ONCE):
        part = FACTORS[:, None] * short[None, i : i + COLUMNS_AT_ONCE]
        part += SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    joined = (least.reshape(COORDINATES, MINIMA).astype(np.uint64) + np.uint64(1)) * JOINING
    return mixed(joined.sum(axis=1)).view(np.int64)


FEATURES = "doc_id bigint, n_shingles bigint, digest binary, signature array<bigint>"


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, signatures = [], [], []
        for text in batch.column(1):
            values = shingles(text.as_py())
            counts.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            signatures.append(signature(values) if len(values) else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, signatures)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *signatures])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["doc_id", "n_shingles", "digest", "signature"])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingles(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())],
            ["id", "members"])


def overlap(one: bytes, other: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column(2), batch.column(3), strict=True):
            both, union = overlap(one.as_py(), other.as_py())
            keep.append(100 * both >= PERCENT * union)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("others")), "b")
        .join(sets.select(F.col("id").alias("a"), "members"), "a")
        .select("a", "b", "members", "others").mapInArrow(confirmed, "a bigint, b bigint")
    )


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of a task as stars: (least node, other node) for each tree that they make, over `NODES` nodes at a time."""
    up: dict[int, int] = {}

    def top(node: int) -> int:
        while (above := up.setdefault(node, node)) != node:
            up[node] = node = up[above]
        return node

    def stars() -> pa.RecordBatch:
        nodes = np.fromiter(up, np.int64, len(up))
        tops = np.fromiter(map(top, nodes.tolist()), np.int64, len(nodes))
        below = nodes != tops
        return pa.RecordBatch.from_arrays([pa.array(tops[below]), pa.array(nodes[below])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            up[high] = low
        if len(up) >= NODES:
            yield stars()
            up.clear()
    if up:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with, for every node of `links` (a, b).

    Each task first makes stars of its links. If these are no stars together, as a node lies in those of several tasks,
    each round takes the least label among the neighbours, then the label of that label; rounds end
    when nothing changes. Every round is written to the checkpoint folder.
    """
    stars = checkpoint(links.distinct().mapInArrow(forest, "a bigint, b bigint"))
    both = stars.union(stars.select("b", "a"))
    # a node with a smaller neighbour and another one is the middle of a path, or of two stars
    begun = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("x"), F.max("b").alias("y")).select(
        "node", F.least("node", "x").alias("label"), (F.col("x") < F.least("node", "y")).alias("open")))
    labels = begun.select("node", "label")
    if begun.where("open").isEmpty():
        return labels
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        ahead = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        new = checkpoint(hooked.join(ahead, "next", "left").select(
            "node", "was", F.least("next", F.coalesce("further", "next")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label < was").limit(1).count() == 0:
            return labels


def sizes_fit(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def collided(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs with the number of posting lists in which they met, at least MATCHES."""
    counted = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("collisions"))
    return counted.where(F.col("collisions") >= MATCHES).select("a", "b")


def across(posts: DataFrame, key: list[str], enough: Column | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """Pairs of different components and fitting sizes that meet under one key; with `hubs` one of each pair is a hub."""
    columns = [c for c in posts.columns if c not in key]
    left, right = (
        side.select(*key, *(F.col(c).alias(f"{c}_{name}") for c in columns))
        for side, name in ((posts if hubs is None else hubs, "a"), (posts, "b")))
    apart = F.col("label_a") < F.col("label_b") if hubs is None else F.col("label_a") != F.col("label_b")
    fit = apart & sizes_fit("n_a", "n_b")
    met = left.join(right, key).where(fit if enough is None else fit & enough)
    return collided(met, F.least("id_a", "id_b"), F.greatest("id_a", "id_b"))


def rare_posts(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """The rarest shingles of each set, as many as must hold one that every similar enough set shares.

    Two sets of similarity 0.75 share at least ceil(0.75 n) of the n members of either, so one of the
    first n - ceil(0.75 n) + 1 in any common order; ordered by how many sets have them, these are the
    shingles that a common passage does not bring. Members of one set alone count in the order only.
    """

    @F.pandas_udf("array<bigint>")
    def unpacked(members: pd.Series) -> pd.Series:
        return members.map(lambda x: np.frombuffer(x, np.int64))

    posts = checkpoint(sets.join(ids, "id").select("id", "n", "label", F.explode(unpacked("members")).alias("shingle")))
    often = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    of_set = Window.partitionBy("id")
    ranked = posts.join(often, "shingle").withColumn("shared", F.count(F.lit(1)).over(of_set)).withColumn(
        "rank", F.row_number().over(of_set.orderBy("sets", "shingle")))
    before = F.col("n") - F.col("shared") + F.col("rank") - 1
    return ranked.withColumn("before", before).where(
        100 * (F.col("n") - F.col("before")) >= PERCENT * F.col("n")).select("id", "n", "label", "shingle", "before")


def rest_is_enough() -> Column:
    """What follows the first shared shingle in both orders can still hold the overlap that the sizes ask for.

    Later shared shingles leave less, so a pair is lost only if its first one fails.
    """
    rest = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    return (100 + PERCENT) * rest >= PERCENT * (F.col("n_a") + F.col("n_b"))


def linked(rows: DataFrame, features: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the class representatives that are linked with others."""
    posts = classes.select("id", "n", F.posexplode("signature").alias("coordinate", "value"))
    lists = posts.groupBy("coordinate", "value").agg(
        F.count(F.lit(1)).alias("length"), F.min(F.struct("n", "id")).alias("head")).where("length > 1")
    shared = checkpoint(posts.join(lists, ["coordinate", "value"]).select(
        "coordinate", "value", "id", "n", "length", F.col("head.id").alias("head"), F.col("head.n").alias("head_n")))
    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    sets = checkpoint(rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        sets_of, "id bigint, members binary"))

    stars = shared.where((F.col("id") != F.col("head")) & sizes_fit("n", "head_n"))
    first = verified(collided(stars, F.col("head"), F.col("id")), sets).union(bridges(features, classes))
    labels = components(first)

    labelled = shared.where("length > 2").join(labels, F.col("id") == F.col("node"), "left").select(
        "coordinate", "value", "length", "id", "n", "head", F.coalesce("label", "id").alias("label"))
    unsettled = labelled.groupBy("coordinate", "value").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("coordinate", "value")
    open_ = checkpoint(labelled.join(unsettled, ["coordinate", "value"]))
    short = across(open_.where((F.col("length") <= DIRECT) & (F.col("id") != F.col("head"))).drop("length", "head"), ["coordinate", "value"])
    in_long = open_.where(F.col("length") > DIRECT).groupBy("id", "n", "label").agg(F.count(F.lit(1)).alias("lists"))
    rare = checkpoint(rare_posts(in_long.where(COORDINATES - F.col("lists") < ENOUGH).drop("lists"), sets))
    hubs = rare.where(F.pmod(F.xxhash64("id"), F.lit(HUBS)) == 0)
    near = to_smallest(rare, ["shingle"], rest_is_enough()).union(across(rare, ["shingle"], rest_is_enough(), hubs))
    tried = checkpoint(short.union(near).distinct())
    labels = extended(labels, checkpoint(verified(tried, sets)))
    rest = across(relabelled(rare, labels), ["shingle"], rest_is_enough()).join(tried, ["a", "b"], "left_anti")
    return extended(labels, checkpoint(verified(rest, sets)))


def relabelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    return posts.drop("label").join(labels, F.col("id") == F.col("node"), "left").select(
        *(c for c in posts.columns if c != "label"), F.coalesce("label", "id").alias("label"))


def to_smallest(posts: DataFrame, key: list[str], enough: Column) -> DataFrame:
    """Pairs of the smallest set under each key with every other of another component."""
    columns = [c for c in posts.columns if c not in key]
    least = posts.groupBy(*key).agg(F.min(F.struct("n", *(c for c in columns if c != "n"))).alias("least"))
    met = posts.select(*key, *(F.col(c).alias(f"{c}_a") for c in columns)).join(
        least.select(*key, *(F.col(f"least.{c}").alias(f"{c}_b") for c in columns)), key)
    fit = (F.col("label_a") != F.col("label_b")) & sizes_fit("n_a", "n_b") & enough
    return collided(met.where(fit), F.least("id_a", "id_b"), F.greatest("id_a", "id_b"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links."""
    if links.limit(1).count() == 0:
        return labels
    return components(labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).union(links))


def bridges(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that has several texts."""
    several = features.where("n_shingles > 0").groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id")
    return features.join(several, "doc_id").join(classes.select("digest", "id"), "digest").select(
        F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, one row per row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    features = checkpoint(rows.mapInArrow(features_of, FEATURES))
    classes = features.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.max("doc_id").alias("highest"), F.first("n_shingles").alias("n"),
        F.first("signature").alias("signature"))
    labels = linked(rows, features, classes)
    grouped = classes.select("digest", "id", "highest").join(labels, F.col("id") == F.col("node"), "left").where(
        "label IS NOT NULL OR highest > id").select("digest", F.coalesce("label", "id").alias("label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return features.join(grouped, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
