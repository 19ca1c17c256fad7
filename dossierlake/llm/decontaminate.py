"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, names and units become typed placeholders, each with its value. Windows of
`WINDOW` canonical words are hashed, for the items and for every document, and joined by hash, so a question
whose numbers, names or units were changed still meets its template. Hits on one diagonal (the
same shift between item and document) make an alignment; the words are compared one by one, and the
placeholders must be filled consistently: one value of the item stands for one value of the document. An item
is leaked if `COVERED` of its words agree, over all its alignments, or `RUN` words in a row.

A capital at the start of a sentence may be a name or not, and numbers may be spelled. So all texts are
looked up in a second form too, in which number words are numbers and every capital word is a name. Slots that only
the second form has need not agree and count for nothing: `COVERED` and `RUN` must be reached by the other words. Both forms
depend on the text alone, so whether a document leaks an item depends on nothing else.

Documents are read once, as word numbers in numpy. Of their windows only those leave a task that a bit map of the items'
hashes lets pass (at most 2 ** `MOST_BITS` bits; a larger benchmark lets more windows pass, all the rest is the same join).
Equal texts are compared once. Text pieces and the items they may leak meet in sorted streams, so neither the
texts of an item nor the items of a text are held together.

Defined cases: null and empty texts hold nothing and leak nothing; an item shorter than the window is one
window of its own length; an item without words is never found; repeated items and rows are each reported;
of equally long runs the first is given; item ids of null are left out; further columns of any name stay as they are.
Very long texts are compared in pieces that overlap by more than the longest item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from dossierlake.llm.common import checkpoint

WINDOW = 8
COVERED, RUN = 0.5, 13
PIECE = 1 << 20
LEAST_BITS, MOST_BITS = 21, 27
KNOWN_CHUNKS, AT_ONCE = 1 << 20, 1 << 21
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
PLACEHOLDERS = frozenset((NUMBER, NAME, UNIT))

# Spelled units and their plurals.
UNITS = """
mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l gal ms s sec min h hr hour hours minute minutes second seconds day days week weeks
month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles
inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons
degree degrees celsius fahrenheit percent dollar dollars cent cents euro euros yen usd eur
""".split()

# A capital after a word of the same sentence makes a name; after a stop, a line end or at the start it says nothing.
NAMES = re.compile(r"(?<=[^\s.!?:\"“(|] )[A-ZÀ-ÖØ-Þ][^\W\d_]*")
CAPITALS = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][^\W\d_]*")
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())
NUMBERS = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
UNIT_WORDS = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![^\W\d_])"
FIRST_UNIT = re.compile(rf"[\s-]*(?i:{UNIT_WORDS})")
OPEN_NUMBER = re.compile(r"[0-9][\s-]*\Z")
GAP = re.compile(r"[\s-]*\Z")
DETAILED = re.compile(
    rf"(?P<name>{NAMES.pattern})|(?P<number>{NUMBERS.pattern})(?P<gap>[\s-]*)(?P<unit>(?i:{UNIT_WORDS}))?|(?P<sign>[%$€£¥°])|[^\W\d_]+")
NO_NAME_AFTER = frozenset('.!?:"“(|')


@dataclass
class Canonical:
    """The words again, each with its written form and its place."""

    words: list[str]
    values: list[str]
    places: list[tuple[int, int]]
    weak: np.ndarray | None = None  # slots that only the second form has


def canonical(text: str) -> Canonical:
    text = text.translate(dict.fromkeys(map(ord, PLACEHOLDERS), " "))
    words, values, places = [], [], []
    shouting = text.isupper()

    def add(word: str, match: re.Match, group: str | int = 0) -> None:
        words.append(word)
        values.append(match.group(group).lower())
        places.append(match.span(group))

    for match in DETAILED.finditer(text):
        if match["number"]:
            add(NUMBER, match, "number")
            if match["unit"]:
                add(UNIT, match, "unit")
        elif match["sign"]:
            add(UNIT, match)
        elif match["name"] and not shouting:
            add(NAME, match)
        else:
            add(match.group().lower(), match)
    return Canonical(words, values, places)


def second(text: str, first: Canonical) -> Canonical:
    """The words of the first form with number words and all capitals as placeholders."""
    shouting = text.isupper()
    words = [
        w if w in PLACEHOLDERS else NUMBER if w in NUMBER_WORDS else NAME if not shouting and CAPITALS.match(text, a) else w
        for w, (a, _) in zip(first.words, first.places, strict=True)]
    return Canonical(words, first.values, first.places, np.array([a != b for a, b in zip(words, first.words, strict=True)], bool))


def forms(text: str) -> tuple[Canonical, Canonical]:
    first = canonical(text)
    return first, second(text, first)


STEPS = np.multiply.accumulate(np.array([1] + [0x9E3779B97F4A7C15] * (WINDOW - 1), np.uint64))


def window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    if len(numbers) < size:
        return np.empty(0, np.uint64)
    out = np.full(len(numbers) - size + 1, size, np.uint64)
    for i in range(size):
        out += numbers[i : len(numbers) - size + 1 + i] * STEPS[i]
    return out


def word_number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def hashed(words: list[str], sizes: list[int]) -> dict[int, np.ndarray]:
    numbers = np.array([word_number(w) for w in words], np.uint64)
    return {size: window_hashes(numbers, size) for size in sizes}


BREAK, LINE = 0, 1  # chunks that stand for the end of a text and of a line
# Of a chunk: its first word is a capital; it is a unit if a number goes before; a name may follow; it ends in a number; it is only a gap.
CAPITAL_FIRST, UNIT_FIRST, NAME_FOLLOWS, OPEN_END, IS_GAP = 1, 2, 4, 8, 16


class Scanner:
    """Window hashes of many texts at once, in both forms.

    A text is cut at blanks and line ends; what a chunk gives is worked out once while it is known (at most
    `KNOWN_CHUNKS`), and what depends on the chunks before it (a name in mid-sentence, a unit behind a number) by arrays.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str | None, int] = {None: BREAK, "\n": LINE}
        # For each chunk: where its words begin and how many they are, in both forms, and what the chunks around it have to know.
        self.begin, self.count, self.flags = np.array([0, 1], np.int64), np.array([1, 0], np.int64), np.array([0, IS_GAP], np.uint8)
        self.words = np.array([[word_number("\x00")] * 2], np.uint64)

    def learn(self, chunks: list[str]) -> None:
        counts, flags, first, second_form = [], [], [], []
        number_of = xxhash.xxh3_64_intdigest
        for chunk in chunks:
            mark = "" if chunk.isalpha() else chunk[-1:]
            stem = chunk if not mark else chunk[:-1]
            if stem and mark in ",.;:!?)" and (not mark or stem.isalpha()) and "ſ" not in chunk:
                low = stem.lower()
                number = number_of(low.encode())
                capital = low != stem and is_capital(stem[0])
                counts.append(1)
                flags.append(CAPITAL_FIRST * capital | UNIT_FIRST * (low in UNIT_SET) | NAME_FOLLOWS * (mark not in NO_NAME_AFTER))
                first.append(number)
                second_form.append(NUMBER_NUMBER if low in NUMBER_WORDS else NAME_NUMBER if capital else number)
                continue
            n, capital = 0, False
            for match in DETAILED.finditer(chunk):
                group = match.group()
                if match["number"]:
                    pairs = [(NUMBER_NUMBER, NUMBER_NUMBER)] + [(UNIT_NUMBER, UNIT_NUMBER)] * bool(match["unit"])
                elif match["sign"]:
                    pairs = [(UNIT_NUMBER, UNIT_NUMBER)]
                else:
                    low, named = group.lower(), CAPITALS.match(chunk, match.start()) is not None
                    number = word_number(low)
                    capital = capital or (named and match.start() == 0)
                    pairs = [(number, NUMBER_NUMBER if low in NUMBER_WORDS else NAME_NUMBER if named else number)]
                n += len(pairs)
                for x, y in pairs:
                    first.append(x)
                    second_form.append(y)
            last = chunk[-1:]
            counts.append(n)
            flags.append(
                CAPITAL_FIRST * capital | UNIT_FIRST * (FIRST_UNIT.match(chunk) is not None)
                | NAME_FOLLOWS * (bool(last) and last not in NO_NAME_AFTER and not last.isspace())
                | OPEN_END * (OPEN_NUMBER.search(chunk) is not None) | IS_GAP * (GAP.match(chunk) is not None))
        base = len(self.count)
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.words) + np.cumsum([0, *counts[:-1]])])
        self.count = np.concatenate([self.count, np.array(counts, np.int64)])
        self.flags = np.concatenate([self.flags, np.array(flags, np.uint8)])
        self.words = np.concatenate([self.words, np.stack([np.array(first, np.uint64), np.array(second_form, np.uint64)], 1)])

    def chunk_numbers(self, texts: list[str]) -> np.ndarray:
        """The chunks of the texts, a BREAK after each."""
        chunks: list[str | None] = []
        for text in texts:
            chunks += text.replace("\n", " \n ").split(" ")
            chunks.append(None)
        new = set(chunks).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN_CHUNKS:
                self.forget()
                new = set(chunks).difference(self.known)
            self.learn(list(new))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in both forms (columns), and where each text ends."""
        chunks = self.chunk_numbers(texts)
        flags = self.flags[chunks]
        solid = np.maximum.accumulate(np.where(flags & IS_GAP, -1, np.arange(len(chunks))))
        solid = np.concatenate([[-1], solid[:-1]])
        pending = (solid >= 0) & (flags[solid] & OPEN_END > 0)
        count, begin = self.count[chunks], self.begin[chunks]
        first = np.cumsum(count) - count
        words = self.words[np.repeat(begin - first, count) + np.arange(count.sum())]
        ends = first[chunks == BREAK]
        name = (flags & CAPITAL_FIRST > 0) & (np.concatenate([[0], flags[:-1]]) & NAME_FOLLOWS > 0)
        shouting = np.array([text.isupper() for text in texts])
        if shouting.any():
            loud = np.repeat(shouting, np.diff(np.concatenate([[-1], np.flatnonzero(chunks == BREAK)])))
            name &= ~loud
            low = np.repeat(loud, count) & (words[:, 1] == NAME_NUMBER)
            words[low, 1] = words[low, 0]
        words[first[name]] = NAME_NUMBER
        words[first[(flags & UNIT_FIRST > 0) & pending]] = UNIT_NUMBER
        return words, ends

    def passing(self, texts: list[str], sizes: list[int], bits: int, filled: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, hash) of each different window whose places in the bit map are all set."""
        words, ends = self.numbers(texts)
        for size in sizes:
            found = []
            for form in range(2):
                hashes = window_hashes(words[:, form], size)
                at = np.arange(len(hashes))
                for k in range(64 // bits):
                    place = hashes[at] << np.uint64(k * bits) >> np.uint64(64 - bits)
                    at = at[np.flatnonzero(filled[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)]
                if len(at):
                    found.append(np.stack([np.searchsorted(ends, at).astype(np.uint64), hashes[at]], 1))
            if found:
                yield from map(tuple, np.unique(np.concatenate(found), axis=0).tolist())


def is_capital(letter: str) -> bool:
    return "A" <= letter <= "Z" or "À" <= letter <= "Þ" and letter != "×"


UNIT_SET = frozenset(UNITS)
NUMBER_NUMBER, NAME_NUMBER, UNIT_NUMBER = map(word_number, (NUMBER, NAME, UNIT))


def aligned(item: Canonical, doc: Canonical, shift: int) -> tuple[np.ndarray, int]:
    """Which words of the item agree along one diagonal, and how many slots are filled anew.

    A placeholder agrees if its filling is consistent with those before, in both directions.
    """
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    agree, changed = np.zeros(len(item.words), bool), 0
    for at in range(max(0, -shift), min(len(item.words), len(doc.words) - shift)):
        word = item.words[at]
        same = word == doc.words[at + shift]
        if same and word in PLACEHOLDERS:
            mine, theirs = item.values[at], doc.values[at + shift]
            same = there.setdefault((word, mine), theirs) == theirs and back.setdefault((word, theirs), mine) == mine
            changed += same and mine != theirs
        agree[at] = same
    return agree, changed


def stretches(agree: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of agreeing words."""
    return np.flatnonzero(np.diff(np.concatenate([[False], agree, [False]]).view(np.int8))).reshape(-1, 2)


Leak = tuple[float, int, int, int, int]


class Compared:
    """One piece of text, ready to be compared with items."""

    def __init__(self, text: str):
        self.forms, self.windows = forms(text), {}

    def found(self, form: int, size: int, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in `wanted`, place in the text) of equal windows."""
        if (form, size) not in self.windows:
            hashes = hashed(self.forms[form].words, [size])[size]
            order = np.argsort(hashes, kind="stable")
            self.windows[form, size] = hashes[order], order
        hashes, order = self.windows[form, size]
        low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        for at in np.flatnonzero(low < high).tolist():
            for place in order[low[at] : high[at]].tolist():
                yield at, place

    def leak(self, text: str) -> Leak | None:
        """(covered, run, changed slots, start, end) if the piece leaks the item with that text; the last four of its longest run."""
        best = None
        for form, item in enumerate(forms(text)):
            size = min(WINDOW, len(item.words))
            if size:
                shifts = sorted({place - at for at, place in self.found(form, size, hashed(item.words, [size])[size])})
                found = leak_of_form(item, self.forms[form], shifts) if shifts else None
                if found and (best is None or found[:2] > best[:2]):
                    best = found
        return best


def leak_of_form(item: Canonical, doc: Canonical, shifts: list[int]) -> Leak | None:
    size = len(item.words)
    covered = np.zeros(size, bool)
    counted = np.ones(size, bool) if item.weak is None or item.weak.all() else ~item.weak
    best = (0, 0, 0, 0)
    for shift in shifts:
        agree, changed = aligned(item, doc, shift)
        runs = stretches(agree)
        # words left out or put in move an item to other diagonals: long runs count together
        for start, end in runs[runs[:, 1] - runs[:, 0] >= min(WINDOW, size)].tolist():
            covered[start:end] = True
            length = int(counted[start:end].sum())
            if length > best[0]:
                best = (length, changed, doc.places[start + shift][0], doc.places[end - 1 + shift][1])
        if agree[counted].sum() >= COVERED * counted.sum():
            covered |= agree
    share = float(covered[counted].mean())
    return (share, *best) if share >= COVERED or best[0] >= RUN else None


def cut(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    """Pieces of a text and where they begin."""
    for start in range(0, max(1, len(text)), PIECE):
        begin = max(0, start - overlap)
        yield begin, text[begin : start + PIECE]


def leaks(text: str | None, items: list[tuple[int, str]]) -> list[tuple]:
    """The same comparison without a prefilter: (item id, covered, run, changed slots, start, end) of each item that the text leaks."""
    text, best = text or "", {}
    overlap = overlap_of(max((len(t or "") for _, t in items), default=0))
    for begin, piece in cut(text, overlap):
        compared = Compared(piece)
        for item_id, item in items:
            leak = compared.leak(item or "")
            if leak and (item_id not in best or leak[:2] > best[item_id][:2]):
                best[item_id] = (*leak[:3], leak[3] + begin, leak[4] + begin)
    return [(i, *best[i]) for i in sorted(best)]


def overlap_of(longest: int) -> int:
    return 2 * longest + 1000


LEAK = "covered double, run int, changed_slots int, start int, end int"
SCHEMA = f"doc_id bigint, item_id bigint, {LEAK}"


def item_windows(items: DataFrame) -> DataFrame:
    """item, size and hash of the windows of both forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                both = forms(text)
                size = min(WINDOW, len(both[0].words))
                if size:
                    found = {h for form in both for h in hashed(form.words, [size])[size].view(np.int64).tolist()}
                    out += [(item, size, h) for h in found]
            yield pd.DataFrame(out, columns=["item", "size", "hash"])

    return items.select("item", "text").mapInPandas(run, "item bigint, size int, hash bigint")


def bit_map(windows: DataFrame, bits: int) -> np.ndarray:
    """Of each hash, the bits at the places that its first `bits` bits, its next ones and so on name; put together in Spark in parts of 32,768."""
    places = F.array(*[F.shiftrightunsigned(F.shiftleft("hash", k * bits), 64 - bits) for k in range(64 // bits)])
    place = F.col("place") + 1
    parts = windows.select(F.explode(places).alias("place")).groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("filled"))
    filled = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(bytes(row["filled"]), np.uint8)
        begin = (row["part"] - 1) * len(part)
        filled[begin : begin + len(part)] = part[: len(filled) - begin]
    return filled


_scanner: list[Scanner] = []


def candidates(docs: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    """digest, begin, piece and hash list of the text pieces with a window that may be an item's; equal texts near each other once."""
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * facts["n"]).bit_length()))
    sizes, overlap = facts["sizes"], overlap_of(longest)
    filled = docs.sparkSession.sparkContext.broadcast(bit_map(windows, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())

        def emit(pieces: dict[tuple, str]) -> pa.RecordBatch:
            found: dict[int, list[int]] = {}
            for at, value in _scanner[0].passing(list(pieces.values()), sizes, bits, filled.value):
                found.setdefault(at, []).append(value)
            hashes = [np.array(v, np.uint64).view(np.int64) for v in found.values()]
            rows = [(*key, piece) for key, piece in pieces.items()]
            chosen = [rows[at] for at in found]
            return pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in chosen], pa.binary()), pa.array([p[1] for p in chosen], pa.int64()), pa.array([p[2] for p in chosen], pa.string()),
                pa.array(hashes, pa.list_(pa.int64()))], names=["digest", "begin", "piece", "hashes"])

        pieces, size = {}, 0
        for batch in batches:
            for digest, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                for mark in PLACEHOLDERS:
                    text = text.replace(mark, " ")
                for begin, piece in cut(text, overlap):
                    pieces[digest.as_py(), begin] = piece
                    size += len(piece)
                    if size > AT_ONCE:
                        yield emit(pieces)
                        pieces, size = {}, 0
        if pieces:
            yield emit(pieces)

    return docs.where("text IS NOT NULL AND text <> ''").select(digest_of(F.col("text")).alias("digest"), "text").mapInArrow(
        run, "digest binary, begin bigint, piece string, hashes array<bigint>")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def side_by_side(asked: DataFrame, once: DataFrame) -> DataFrame:
    """The text of every piece in one row without an item, followed in the same task by the items it may leak.

    Dealt out by a column of its own: both sides may come dealt out by the keys, so a repartition by them is dropped from the
    plan, and adaptive execution then merges the partitions of each side differently; a text would miss its items.
    """
    key = ("digest", "begin")
    both = asked.unionByName(once.select(*key, F.col("piece").alias("text")), allowMissingColumns=True)
    home = both.withColumn("home", F.xxhash64(*key)).repartition("home")
    return home.sortWithinPartitions("home", *key, F.asc_nulls_first("item")).select(*key, "item", "item_id", "text")


def leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """digest, item_id and what was found, for each different text of `docs` and each item that it leaks."""
    spark = docs.sparkSession
    listed = checkpoint(items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").withColumn(
        "item", F.monotonically_increasing_id()))
    windows = checkpoint(item_windows(listed))
    longest = listed.agg(F.max(F.length("text")).alias("n")).first()["n"]
    if windows.isEmpty():
        return spark.createDataFrame([], f"digest binary, item_id bigint, {LEAK}")
    pieces = checkpoint(candidates(docs, windows, longest))
    key = ("digest", "begin")
    once = pieces.groupBy(*key).agg(F.any_value("piece").alias("piece"), F.any_value("hashes").alias("hashes"))
    hashes = once.select(*key, F.explode("hashes").alias("hash"))
    pairs = hashes.join(windows.select("item", "hash"), "hash").select(*key, "item").distinct()
    asked = pairs.join(listed, "item").select(*key, "item", "item_id", "text")
    stream = side_by_side(asked, once)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, compared = "", None
        for batch in batches:
            out = []
            for digest, begin, item, item_id, value in zip(*batch.columns, strict=True):
                item = item.as_py()
                if item is None:
                    text, compared = value.as_py(), None
                    continue
                compared = compared or Compared(text)
                leak = compared.leak(value.as_py())
                if leak:
                    shift = begin.as_py()
                    out.append((digest.as_py(), item, item_id.as_py(), *leak[:3], leak[3] + shift, leak[4] + shift))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 4)
            names = ["digest", "item", "item_id", "covered", "run", "changed_slots", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    found = stream.mapInArrow(compare, f"digest binary, item bigint, item_id bigint, {LEAK}")
    rank = F.struct("covered", "run", (-F.col("start")).alias("early"))
    best = F.max_by(F.struct("covered", "run", "changed_slots", "start", "end"), rank).alias("best")
    return checkpoint(found.groupBy("digest", "item", "item_id").agg(best).select("digest", "item_id", "best.*"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that it leaks; documents without a leak have none."""
    found = leaking(docs, items)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), digest_of(F.col("text")).alias("digest"))
    return rows.join(found, "digest").drop("digest")


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that leak no item."""
    found = leaking(docs, items).select("digest").distinct()
    return docs.join(found, digest_of(docs["text"]) == found["digest"], "left_anti")
