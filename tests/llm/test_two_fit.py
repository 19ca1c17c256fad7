"""Best-two-fit packing against the tokenizer library and against packing one sequence at a time."""

from collections import Counter, defaultdict
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from dossierlake.llm import queries, two_fit

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def coder():
    return two_fit.WordIds(public_tokenizers.path(two_fit.TOKENIZER))


def library(coder, text):
    return np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def checked(found, texts, coder, room):
    """Every piece holds its document's ids, and sequences are filled without gap or overlap. Gives the number of sequences."""
    ids = {doc_id: library(coder, text or "") + b"\x01\x00\x00\x00" for doc_id, text in texts.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = {d: [(k, k * room, min(room, len(x) // 4 - k * room), zlib.crc32(x[4 * room * k : 4 * room * (k + 1)]))
                    for k in range(-(-len(x) // (4 * room)))] for d, x in ids.items()}
    assert {d: sorted(p) for d, p in pieces.items()} == expected
    for inside in places.values():
        ends = [0, *np.cumsum([length for _, length in sorted(inside)]).tolist()]
        assert [offset for offset, _ in sorted(inside)] == ends[:-1] and ends[-1] <= room
    return len(places)


def test_documents(spark, coder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_best_two_fit(spark, SF).collect()
    assert checked(found, texts, coder, two_fit.ROOM) == -(-sum(r["length"] for r in found) // two_fit.ROOM)


def test_ids_are_those_of_the_library(coder, monkeypatch):
    rng = random.Random(3)
    alphabet = ["Wort", "ÄRGER", "don't", "l'été", "x.", "...", "1,000", ".,", "ΣΑΣ", "İstanbul", "J̌", "é", "日本語", "\U0001f600", "µm", "ſ.", " ",
                "\x1c", " ", "\t", "\r\n", "\n", " ", "  ", "a" * 70 + ".", "<|endoftext|>", "<| x", "'s", "'S.", "!?", "Straße,", "ß", "́", "²", "ªb."]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for known, piece in ((1 << 20, 1 << 20), (10, 50), (10, 1 << 20)):
        monkeypatch.setattr(two_fit, "KNOWN_WORDS", known)
        monkeypatch.setattr(two_fit, "SLICE", piece)
        coder.known, coder.older = {"": b""}, {}
        for text in texts:
            assert coder.ids(text) == library(coder, text), text
        assert known > 1000 or len(coder.known) < 1000


def one_at_a_time(sizes, room):
    """The same rule on single pieces: contents of the sequences, each from its longest piece on."""
    left, out = sorted(sizes), []
    while left:
        inside, gap = [], room
        while True:
            fits = [s for s in left if s <= gap]
            if not fits:
                break
            inside.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        pairs = [(a + b, a) for i, a in enumerate(left) for b in left[:i] if inside[-1] < a + b <= gap + inside[-1]]
        if pairs:
            total, longer = max(pairs)
            left.append(inside.pop())
            for s in (longer, total - longer):
                left.remove(s)
                inside.append(s)
            left.sort()
        out.append(tuple(sorted(inside)))
    return Counter(out)


@pytest.mark.parametrize("room", [10, 40, 100])
def test_plan_over_counts_is_the_plan_of_single_pieces(room):
    rng = random.Random(room)
    for _ in range(60):
        most = rng.randint(1, room)
        sizes = [rng.randint(1, most) for _ in range(rng.randint(0, 70))]
        plan = Counter()
        for content, times in two_fit.planned(Counter(sizes), room):
            assert times > 0
            plan[tuple(sorted(s for s, n in content for _ in range(n)))] += times
        assert plan == one_at_a_time(sizes, room)


def test_two_pieces_replace_the_smallest():
    """Greedy filling alone takes 6 + 3; 6 + 2 + 2 leaves nothing over."""
    assert two_fit.planned({6: 1, 3: 1, 2: 2}, 10) == [([(6, 1), (2, 2)], 1), ([(3, 1)], 1)]


def test_the_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 4096) for _ in range(5000))
    small = two_fit.planned(counts)
    large = two_fit.planned({s: n * 10**9 for s, n in counts.items()})
    assert len(large) < 4 * len(small) and sum(t for _, t in large) * two_fit.ROOM >= sum(s * n for s, n in counts.items()) * 10**9


def test_hot_lengths_and_odd_rows(spark, coder, odd_docs, no_docs):
    rows = [(i, "same words again and again.", "x", "y", "z") for i in range(3000)] + [(10000 + i, "w " * (i % 97), "x", "y", "z") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, bin string, rank string")
    found = two_fit.packed(docs, room=64, bin_rows=50).collect()
    assert checked(found, {r[0]: r[1] for r in rows}, coder, 64) <= 1.02 * sum(r["length"] for r in found) / 64
    odd = two_fit.packed(odd_docs).collect()
    assert sum(r["piece"] == 0 for r in odd) == odd_docs.count()
    assert sum(r["length"] == 1 for r in odd) == 4
    places = [(r["sequence_id"], r["offset"] + k) for r in odd if r["length"] < 5000 for k in range(r["length"])]
    assert len(places) == len(set(places))
    assert two_fit.packed(no_docs).collect() == []
