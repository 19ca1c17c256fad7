"""Near-duplicate removal: shingle signatures, exact Jaccard matching, newest document kept.

Documents with equal signatures fold into one class first. Between classes, only signatures
that share one of their first hashes in one order, common hashes last, with enough of both sets
behind it, can reach the threshold, so those are the only candidates. A fixed number of leader rounds compares every
class with the newest open class of each posting list only: work linear in the postings,
one round settles a crowd of copies. What is still open meets by posting and size: the larger set of a pair looks only for
sizes that its own place in the list still allows, so a crowd of texts around one passage, too different to be copies, never meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1, sha256
from itertools import chain
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from dossierlake.functions.text import as_col, explode_rows
from dossierlake.functions.tokens import EXPANSIONS, SUFFIX_PATTERN, TOKEN_PATTERN, TOKEN_STOPWORDS, expand_synonyms
from dossierlake.session import checkpoint, written  # noqa: F401 (checkpoint: for the tests)

# Shingle length, signature cut and similarity threshold.
SHINGLE_TOKENS = 5
SIGNATURE_HASHES = 2000
DUPLICATE_JACCARD = 0.8

COMMON = 8  # sets that make a hash common
WORDS_KEPT = 200_000  # words a task remembers
LEADER_ROUNDS = 2
SIZE_BAND = 1.05


class _Words(dict):
    """Raw token -> the tokens it stands for, as `tokenize` has them, with blanks between; a task works out each word once."""

    suffix, stopwords = re.compile(SUFFIX_PATTERN), frozenset(TOKEN_STOPWORDS)

    def __missing__(self, raw: str) -> str:
        token = raw.lower().rstrip(".")
        if token[-1:] >= "가":
            token = self.suffix.sub(r"\1", token).rstrip(".")
        known = self[raw] = " ".join(t for t in EXPANSIONS.get(token, (token,)) if len(t) > 1 and t not in self.stopwords)
        return known


def _smallest(text: str, words: _Words, pattern: re.Pattern, hashes: int) -> np.ndarray:
    """The first `hashes` distinct numbers, the leading 48 bits of each shingle's SHA-1; shorter texts count their tokens."""
    line = " ".join(filter(None, map(words.__getitem__, pattern.findall(text)))).encode()
    if not line:
        return np.empty(0, np.int64)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == ord(" ")), len(line))
    span = SHINGLE_TOKENS if len(ends) >= SHINGLE_TOKENS else 1
    starts = np.append(0, ends[:-1] + 1)[: len(ends) - span + 1]
    digests = b"".join([sha1(line[i:j]).digest() for i, j in zip(starts.tolist(), ends[span - 1:].tolist())])
    leading = np.frombuffer(digests, [("top", ">u8"), ("rest", "V12")])["top"].astype(np.uint64) >> np.uint64(16)
    return np.unique(leading.astype(np.int64))[:hashes]


def signed_numbers(body: Column | str, hashes: int = SIGNATURE_HASHES) -> Column:
    """The signature as `numbers` (twelve hex digits are 48 bits, and numbers sort as their digits do) and the SHA-256 of these."""

    @F.arrow_udf("numbers array<bigint>, digest string")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, pattern = _Words(), re.compile(TOKEN_PATTERN)
        for texts in batches:
            rows = []
            for text in texts:
                if len(words) > WORDS_KEPT:
                    words.clear()
                rows.append(_smallest(text.as_py(), words, pattern, hashes))
            offsets = pa.array(np.cumsum([0] + [len(r) for r in rows], dtype=np.int32))
            numbers = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *rows])))
            yield pa.StructArray.from_arrays([numbers, pa.array([sha256(r.tobytes()).hexdigest() for r in rows], pa.string())], ["numbers", "digest"])

    return signed(expand_synonyms(body))


def signature_numbers(body: Column | str, hashes: int = SIGNATURE_HASHES) -> Column:
    return signed_numbers(body, hashes)["numbers"]


def signature(body: Column | str, hashes: int = SIGNATURE_HASHES) -> Column:
    """X11: sorted distinct hashes of five-token shingles, the first `hashes` of them; what sorts later is never compared."""
    return F.transform(signature_numbers(body, hashes), lambda n: F.lower(F.lpad(F.hex(n), 12, "0")))


def jaccard(left: Column, right: Column) -> Column:
    """Share of common hashes; 0 when either side is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(left) + F.size(right) - shared), F.lit(0.0))


def numbers_of(docs: DataFrame, stored: Column | str) -> Column:
    """A stored signature as numbers, whether it was stored as these or as hex digits."""
    held = docs.select(as_col(stored)).schema[0].dataType.elementType
    return as_col(stored) if isinstance(held, LongType) else F.transform(as_col(stored), lambda h: F.conv(h, 16, 10).cast("bigint"))


def signature_classes(profiles: DataFrame, project: str, key: str, mtime: str) -> tuple[DataFrame, DataFrame]:
    """Members (key -> class) and one row per class, led by its newest document.

    The digest stands for the whole signature; the signature itself travels once per class.
    """
    # MAX over a struct takes the largest mtime and, for equal ones, the smallest key.
    order = F.struct(F.col(mtime).alias("m"), (-F.col(key)).alias("k"))
    members = profiles.filter(F.col("hashes") > 0).select(project, key, mtime, "digest", "hashes", order.alias("rank"))
    leaders = members.groupBy(project, "digest").agg(F.max("rank").alias("rank"), F.max("hashes").alias("hashes"))
    leaders = leaders.select(project, "digest", "rank", "hashes", (-F.col("rank.k")).alias("leader"))
    return members, leaders


def _prefix(threshold: float) -> Column:
    """Two sets with Jaccard >= t share an element among the first n - ceil(t n) + 1 of either set under one global order."""
    return F.col("hashes") - F.ceil(F.col("hashes") * threshold - 1e-9).cast("int") + 1


def _cells(classes: DataFrame, project: str, start: Column | int, length: Column) -> DataFrame:
    """(hash, project, leader) of `length` hashes from place `start` in the order of the numbers."""
    return explode_rows(classes, [project, "leader"], F.slice("numbers", start, F.greatest(length, F.lit(0))), "hash")


def _crowded(cells: DataFrame, project: str) -> DataFrame:
    return cells.groupBy("hash", project).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= COMMON)


def _found(cells: DataFrame, project: str, common: DataFrame) -> DataFrame:
    """(leader, found): the common ones among a set's cells."""
    hits = cells.join(common, ["hash", project]).groupBy("leader").agg(F.collect_list(F.struct("df", "hash")).alias("found"))
    return written(hits, "found")


def _further(classes: DataFrame, found: DataFrame, whole: DataFrame | None) -> DataFrame:
    """The classes in `found` with all their numbers, picked out of `whole` before anything else meets them."""
    return classes.join(found, "leader") if whole is None else whole.join(found, "leader").join(classes.drop("numbers"), "leader")


def common_hashes(classes: DataFrame, project: str, threshold: float, whole: DataFrame | None = None) -> DataFrame:
    """(hash, project, df) of the hashes that make long lists; `numbers` are sorted.

    All sets are looked at with their smallest hashes, those of a prefix. For each hash there that `COMMON` sets have, a set
    is looked at one hash further. Sets with such a hash there, too, are counted with all their hashes. Where the classes
    have only the numbers of their prefix, `whole` (leader, numbers) has the others; only sets looked at further are read there.
    """
    first = _prefix(threshold)
    crowded = written(_crowded(_cells(classes, project, 1, first), project), "crowded")
    further = _further(classes, _found(_cells(classes, project, 1, first), project, crowded), whole)
    there = _cells(further, project, first + 1, F.size("found"))
    beyond = written(_crowded(there, project), "crowded")
    both = crowded.unionByName(beyond)
    again = written(there.join(both.select("hash", project), ["hash", project], "left_semi").select("leader").distinct(), "again")
    everything = _crowded(_cells(_further(classes, again, whole), project, 1, F.col("hashes")), project)
    return written(both.unionByName(everything).groupBy("hash", project).agg(F.max("df").alias("df")), "common")


def prefixes(classes: DataFrame, project: str, common: DataFrame, threshold: float, whole: DataFrame | None = None) -> DataFrame:
    """(hash, project, leader, hashes, before): each set's prefix in one order; `before` counts the hashes in front.

    Common hashes come last, by how common they are, the others by their number; `numbers` are sorted. A set with k common
    hashes among its smallest is looked at k hashes further, and as a whole if there are common ones again: what is found
    then holds every common hash in front of the prefix's end. `whole` as for the common hashes.
    """
    first = _prefix(threshold)
    near = _found(_cells(classes, project, 1, first), project, common)
    further = _further(classes, near.select("leader", F.size("found").alias("k")), whole)
    beyond = _found(_cells(further, project, first + 1, F.col("k")), project, common)
    again = further.join(beyond.select("leader"), "leader", "left_semi")
    rest = _found(_cells(again, project, first + F.col("k") + 1, F.col("hashes")), project, common)
    found = near.unionByName(beyond).unionByName(rest).groupBy("leader").agg(F.flatten(F.collect_list("found")).alias("found"))
    found = written(found.select("leader", F.sort_array("found")["hash"].alias("last")), "found")
    start = F.slice("numbers", 1, first + F.size("last"))
    mixed = F.slice(F.concat(F.array_except(start, "last"), "last"), 1, first)
    sets = classes.join(found, "leader", "left_anti").select(project, "leader", "hashes", F.slice("numbers", 1, first).alias("own"))
    sets = sets.unionByName(_further(classes, found, whole).select(project, "leader", "hashes", mixed.alias("own")))
    return sets.select(project, "leader", "hashes", F.posexplode("own").alias("before", "hash")).select("hash", project, "leader", "hashes", "before")


def prefix_postings(classes: DataFrame, project: str, threshold: float, whole: DataFrame | None = None) -> DataFrame:
    """(project, hash, leader, rank, hashes, before) for the prefix of each class; a hash that no other prefix holds goes."""
    classes = classes.withColumn("numbers", F.sort_array("numbers"))
    postings = prefixes(classes, project, common_hashes(classes, project, threshold, whole), threshold, whole)
    shared = postings.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash", project))).where(F.col("n") > 1).drop("n")
    return shared.join(classes.select("leader", "rank"), "leader").select(project, "hash", "leader", "rank", "hashes", "before")


def _similar(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Exact check of (newer, older) candidate classes; only the sets of candidates leave the place where they are stored."""
    pairs = written(candidates, "candidates")
    asked = written(pairs.select(F.explode(F.array("newer", "older")).alias("leader")).distinct(), "asked")
    body = classes.select("leader", "numbers").join(asked, "leader", "left_semi")
    return (
        pairs.join(body.select(F.col("leader").alias("newer"), F.col("numbers").alias("a")), "newer")
        .join(body.select(F.col("leader").alias("older"), F.col("numbers").alias("b")), "older")
        .filter(jaccard(F.col("a"), F.col("b")) >= threshold)
        .drop("a", "b")
    )


def _can_reach(threshold: float) -> Column:
    """Sets of too different size cannot be that similar, nor sets with too little behind their first shared hash.

    Later shared hashes have less behind them, so a pair is lost only if its first one fails.
    """
    small, large = F.least("p.hashes", "q.hashes"), F.greatest("p.hashes", "q.hashes")
    rest = F.least(F.col("p.hashes") - F.col("p.before"), F.col("q.hashes") - F.col("q.before"))
    overlap = (F.col("p.hashes") + F.col("q.hashes")) * (threshold / (1 + threshold))
    return (small >= large * threshold - 1e-9) & (rest >= overlap - 1e-9)


def _band(size: Column) -> Column:
    """Sizes within about a twentieth of each other."""
    return F.floor(F.log(size.cast("double")) / math.log(SIZE_BAND)).cast("int")


def _seeking(postings: DataFrame, threshold: float) -> DataFrame:
    """Each posting once for every band of sizes, up to its own, that a similar set found here can have.

    A set with `before` rarer hashes in front has hashes - before left; together with a set of size n it needs a share of both sizes.
    """
    most = F.floor((F.col("hashes") - F.col("before")) * ((1 + threshold) / threshold) - F.col("hashes") + 1e-6)
    low, high = F.ceil(F.col("hashes") * threshold - 1e-9), F.least(most, F.col("hashes"))
    bands = F.when((high >= low) & (low > 0), F.sequence(_band(low), _band(high))).otherwise(F.array().cast("array<int>"))
    return explode_rows(postings.withColumn("bands", bands), [c for c in postings.columns], F.col("bands"), "band").where("band IS NOT NULL")


def _met(newer: DataFrame, older: DataFrame, project: str, threshold: float) -> DataFrame:
    """Postings (p of newer, q of older) of one list and of sizes that suit each other, the larger set looking for the smaller."""
    on = ["hash", "band", project]
    sized = F.col("hashes").alias("hashes")
    found = []
    for larger, smaller, names in ((newer, older, ("p", "q")), (older, newer, ("q", "p"))):
        there = smaller.select("*", _band(sized).alias("band"))
        pairs = _seeking(larger, threshold).alias(names[0]).join(there.alias(names[1]), on)
        bigger = F.col(f"{names[0]}.hashes") >= F.col(f"{names[1]}.hashes")
        if names[0] == "q":
            bigger = F.col("q.hashes") > F.col("p.hashes")
        columns = ("leader", "rank", "hashes", "before")
        found.append(pairs.where(bigger).select(*[F.struct(*[F.col(f"{side}.{c}") for c in columns]).alias(side) for side in ("p", "q")]))
    return found[0].unionAll(found[1])


def _candidates(newer: DataFrame, older: DataFrame, project: str, threshold: float) -> DataFrame:
    """(newer, older) class pairs that share a posting list, each once."""
    return (
        _met(newer, older, project, threshold)
        .filter((F.col("p.rank") > F.col("q.rank")) & _can_reach(threshold))
        .select(F.col("p.leader").alias("newer"), F.col("q.leader").alias("older"), F.col("p.rank").alias("rank"))
        .distinct()
    )


def _settle(open_pairs: DataFrame, undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One greedy round over similar pairs: classes without an open newer neighbour stay, their neighbours go."""
    blocked = open_pairs.select(F.col("older").alias("leader")).distinct()
    kept = undecided.join(blocked, "leader", "left_anti")
    dropped = open_pairs.join(kept.select(F.col("leader").alias("newer")), "newer").select(
        F.col("older").alias("leader")
    ).distinct()
    return kept, dropped


def keep_newest(
    docs: DataFrame, key: str, body: Column | str, project: str, mtime: str, threshold: float = DUPLICATE_JACCARD,
    leader_rounds: int = LEADER_ROUNDS, signed: bool = False,
) -> DataFrame:
    """Every document with `kept` and, if dropped, the newest kept document it repeats.

    The rule is the sequential one: from newest to oldest, a document is dropped when a
    document kept before it, of the same project, reaches the threshold. With `signed`, `body` is the
    stored signature; a `digest` stored with it is used. Signatures lie on disk once: those stored as numbers with a digest are
    read again where they are, others are written down here, and every step moves only what it needs of them.
    """
    columns = [F.col(project), F.col(key), F.col(mtime)]
    if signed:
        numbers = F.sort_array(numbers_of(docs, body))
        digest = F.col("digest") if "digest" in docs.columns else F.sha2(F.array_join(numbers.cast("array<string>"), " "), 256)
        held = docs.select(*columns, numbers.alias("numbers"), digest.alias("digest"))
    else:
        held = docs.select(*columns, signed_numbers(body).alias("s")).select(project, key, mtime, "s.numbers", "s.digest")
    if not signed or "digest" not in docs.columns or not isinstance(docs.select(as_col(body)).schema[0].dataType.elementType, LongType):
        held = written(held, "signed")
    sized = held.withColumn("hashes", F.size("numbers"))
    profiles = written(sized.drop("numbers"), "profiles")
    members, leaders = signature_classes(profiles, project, key, mtime)
    start = sized.select(F.col(key).alias("leader"), "digest", F.slice("numbers", 1, F.greatest(_prefix(threshold), F.lit(0))).alias("numbers"))
    classes = written(leaders.join(start.dropDuplicates(["leader", "digest"]), ["leader", "digest"]), "classes")
    sets = held.select(F.col(key).alias("leader"), "numbers")
    postings = written(prefix_postings(classes, project, threshold, sets), "postings")

    kept_parts: list[DataFrame] = []
    open_postings = postings
    for _ in range(leader_rounds):
        lists = open_postings.groupBy("hash", project).agg(F.max("rank").alias("top"))
        headed = open_postings.join(lists, ["hash", project])
        state = headed.groupBy("leader").agg(F.bool_and(F.col("rank") == F.col("top")).alias("leads"))
        kept = written(state.filter("leads").select("leader"), "kept")
        heads = open_postings.join(kept, "leader", "left_semi")
        rest = open_postings.join(kept, "leader", "left_anti")
        dropped = _similar(_candidates(heads, rest, project, threshold), sets, threshold).select(
            F.col("older").alias("leader")
        ).distinct()
        open_postings = written(rest.join(dropped, "leader", "left_anti"), "open")
        kept_parts.append(kept)
    # All similar pairs among the open classes, then greedy rounds over them: as many as a chain of copies is long.
    pairs = written(_similar(_candidates(open_postings, open_postings, project, threshold), sets, threshold), "pairs")
    undecided = open_postings.select("leader").distinct()
    while not pairs.isEmpty():
        kept, dropped = _settle(pairs, undecided)
        kept, dropped = written(kept, "kept"), written(dropped, "dropped")
        kept_parts.append(kept)
        gone = kept.unionByName(dropped)
        undecided = written(undecided.join(gone, "leader", "left_anti"), "undecided")
        pairs = written(
            pairs.join(gone.select(F.col("leader").alias("newer")), "newer", "left_anti").join(
                gone.select(F.col("leader").alias("older")), "older", "left_anti"
            ),
            "pairs",
        )
    kept_parts.append(undecided)
    connected_kept = kept_parts[0]
    for part in kept_parts[1:]:
        connected_kept = connected_kept.unionByName(part)
    connected_kept = written(connected_kept, "kept")

    dropped = postings.select("leader").distinct().join(connected_kept, "leader", "left_anti")
    against = _candidates(
        postings.join(connected_kept, "leader", "left_semi"), postings.join(dropped, "leader", "left_semi"), project, threshold
    )
    newest = _similar(against, sets, threshold).groupBy("older").agg(F.max_by("newer", "rank").alias("duplicate_of"))
    outcome = leaders.join(newest.withColumnRenamed("older", "leader"), "leader", "left").select(
        project, "digest", "leader", "duplicate_of"
    )
    judged = members.join(outcome, [project, "digest"]).select(
        key,
        (F.col("duplicate_of").isNull() & (F.col(key) == F.col("leader"))).alias("kept"),
        F.when(F.col("duplicate_of").isNotNull(), F.col("duplicate_of"))
        .when(F.col(key) != F.col("leader"), F.col("leader")).alias("duplicate_of"),
    )
    return profiles.select(project, key, mtime).join(judged, key, "left").withColumn(
        "kept", F.coalesce("kept", F.lit(True))
    )


def exact_copies(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Groups of equal texts: first key and size. The digest is counted where the text is read."""
    digests = docs.select(F.col(key), F.sha2(body, 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.count("*").cast("bigint").alias("copies"), F.min(key).alias("first_key"))
    return groups.filter(F.col("copies") > 1)
