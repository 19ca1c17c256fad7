"""Packing token pieces into sequences by best-two-fit.

Texts become token ids of a public tokenizer and an end id; only longer documents are cut, into pieces of
`ROOM` ids. All that the packing itself needs is how many pieces there are of each length, at most `ROOM`
numbers whatever the corpus: a sequence is planned over that histogram (fill greedily with the longest piece
that fits; then exchange the smallest piece for two unpacked ones that leave less room) and repeated as
often as the counts allow, which is what planning one sequence at a time would do. So the driver holds
lengths, never pieces, and each planning step uses up a length. Pieces are then ranked inside their length,
in bins of bounded size, and take the places planned for their length and rank.

Defined cases: null and empty texts are the end id alone; null or repeated ids and equal rows are pieces of
their own; of equal lengths any piece may take a place (the result of one run is consistent, and the
number of sequences and their lengths do not depend on it); of equally tight pairs the one with the longer
piece is taken; an empty table gives no row; further columns of any name are ignored. A long text is
tokenised in slices that end at white space, which this tokenizer drops.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dossierlake.llm.common import checkpoint

ROOM, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
BIN_ROWS = 200_000
KNOWN_WORDS, WORD_LENGTH, SLICE = 1 << 19, 64, 1 << 20
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of texts as bytes, four to an id; each word between blanks is tokenised once while it is known.

    Words are independent for a tokenizer that drops white space. Words in Latin-1 letters, with a mark behind them or
    not, go to the library's model in lower case, all others through the whole library. Known words are kept in two
    generations of at most `KNOWN_WORDS`; the older one is dropped when the younger is full, words met again move on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        written = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {c: written(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}

    def encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known."""
        known, older, tokenize, letters = self.known, self.older, self.tokenizer.model.tokenize, self.letters
        found: dict[str, bytes] = {}
        others = []
        for w in words:
            ids = older.get(w)
            if ids is None:
                stem, mark = (w, "") if w.isalpha() else (w[:-1], w[-1])
                if not (mark in ",.;:!?" and stem.isalpha() and (stem.isascii() or max(stem) < "Ā")):
                    others.append(w)
                    continue
                low = stem.lower()
                ids = known.get(low) or found.get(low) or older.get(low)
                if ids is None:
                    ids = array("I", [t.id for t in tokenize(low.translate(letters))]).tobytes()
                    found[low] = ids
                ids += self.mark(mark)
            found[w] = ids
        found.update(zip(others, self.encode(others), strict=True))
        return found

    def mark(self, mark: str) -> bytes:
        if mark not in self.known:
            self.known[mark] = self.encode([mark])[0]
        return self.known[mark]

    def ids(self, text: str) -> bytes:
        if "<|" in text:  # the strings of special tokens, which the library takes out of words
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            words = text[at:end].replace("\n", " ").split(" ")
            ids = list(map(self.known.get, words))
            if None in ids:
                learned = self.learn({w for w, x in zip(words, ids, strict=True) if x is None})
                ids = [learned[w] if x is None else x for w, x in zip(words, ids, strict=True)]
                if len(self.known) + len(learned) > KNOWN_WORDS:
                    self.known, self.older = {"": b""}, self.known
                self.known.update((w, x) for w, x in learned.items() if len(w) <= WORD_LENGTH)
            out += ids
            at = end
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker, read once."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; no shuffle."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in batches:
            doc_ids, piece, start, length, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    doc_ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, sums))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def planned(counts: dict[int, int], room: int = ROOM) -> list[tuple[list[tuple[int, int]], int]]:
    """Contents of the sequences, as (length, number of pieces) from the longest on, and how often each is used."""
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(s)] for s in sizes], np.int64)
    plan = []
    while left.any():
        uses = np.zeros(len(sizes), np.int64)
        gap = room
        while True:
            fits = np.flatnonzero((left > uses) & (sizes <= gap))
            if not len(fits):
                break
            at = fits[-1]
            n = min(int(left[at] - uses[at]), gap // int(sizes[at]))
            uses[at] += n
            gap -= n * int(sizes[at])
        smallest = int(np.flatnonzero(uses)[0])
        pair = tightest_pair(sizes, left - uses, gap + int(sizes[smallest])) if gap else None
        if pair and sizes[list(pair)].sum() > sizes[smallest]:
            uses[smallest] -= 1
            for at in pair:
                uses[at] += 1
        used = np.flatnonzero(uses)
        times = int((left[used] // uses[used]).min())
        left -= times * uses
        plan.append(([(int(sizes[i]), int(uses[i])) for i in used[::-1]], times))
    return plan


def tightest_pair(sizes: np.ndarray, free: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Positions of two free pieces whose sizes come closest to `gap` from below, the longer one as long as possible."""
    have = np.flatnonzero(free > 0)
    lengths = sizes[have]
    first = np.arange(len(have))
    second = np.minimum(np.searchsorted(lengths, gap - lengths, "right") - 1, first)
    second = second - ((second == first) & (free[have] < 2))
    ok = second >= 0
    if not ok.any():
        return None
    sums = np.where(ok, lengths + lengths[np.maximum(second, 0)], -1)
    best = int(np.flatnonzero(sums == sums.max())[-1])
    return int(have[best]), int(have[second[best]])


class Places:
    """Where the r-th piece of a length goes: runs of ranks of one length, one run for each entry of the plan."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]]):
        runs, sequence, ranks = [], 0, {}
        for content, times in plan:
            offset = 0
            for length, n in content:
                rank = ranks.get(length, 0)
                runs.append((length, rank, sequence, n, offset))
                ranks[length] = rank + n * times
                offset += length * n
            sequence += times
        runs.sort()
        self.columns = [np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 5)]

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset."""
        length, rank, sequence, n, offset = self.columns
        begin = np.searchsorted(length, lengths, "left")
        run = np.empty(len(lengths), np.int64)
        for value in np.unique(lengths):
            rows, low = np.flatnonzero(lengths == value), np.searchsorted(length, value)
            high = np.searchsorted(length, value, "right")
            run[rows] = begin[rows] + np.searchsorted(rank[low:high], ranks[rows], "right") - 1
        inside = ranks - rank[run]
        return sequence[run] + inside // n[run], offset[run] + inside % n[run] * lengths


def packed(docs: DataFrame, path: str | None = None, room: int = ROOM, bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    cut = checkpoint(pieces(docs, path, room).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(planned(counts, room))
    most = F.lit([-(-counts.get(n, 0) // bin_rows) or 1 for n in range(1, room + 1)])
    binned = cut.withColumn("bin", F.pmod(F.xxhash64("row"), F.element_at(most, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("length", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"))
    inside = F.row_number().over(Window.partitionBy("length", "bin").orderBy("row")) - 1
    ranked = binned.withColumn("inside", inside).join(starts, ["length", "bin"]).withColumn("rank", F.col("rank_from") + F.col("inside"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.select(*columns, "rank").mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id bigint, offset bigint")
