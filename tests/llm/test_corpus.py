"""Sharding, repeated passages, near-duplicates, packing, and the pipeline."""

from collections import defaultdict
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest

import corpus_pipeline
from dossierlake.llm import chunks, decontaminate, language, neardup, packing, pii, queries, sharding

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_shards(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = queries.op2_virtual_slots(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    places, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(places) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 40


def brute_dealt(slots, loads):
    loads, out = list(loads), {}
    for size, slot in sorted((-b, s) for s, b in slots):
        at = loads.index(min(loads))
        loads[at] -= size
        out[slot] = at
    return out, loads


def test_maps_and_rebalancing(spark, tmp_path, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    sizes = {i: int(x) for i, x in enumerate(rng.integers(1, 10000, 300))}
    slots = spark.createDataFrame([(i, b, 1) for i, b in sizes.items()], "virtual_slot int, bytes bigint, rows bigint")
    first = sharding.first_map(slots, 7)
    assert {r["virtual_slot"]: r["shard"] for r in first.collect()} == brute_dealt(sizes.items(), [0] * 7)[0]
    path = str(tmp_path / "map")
    sharding.write_map(first, path, 1)
    for shards in (8, 5):
        old = sharding.read_map(spark, path)
        new = sharding.rebalanced(old, slots, shards)
        before, after = ({r["virtual_slot"]: r["shard"] for r in x.collect()} for x in (old, new))
        loads = defaultdict(int)
        for slot, shard in after.items():
            loads[shard] += sizes[slot]
        share = sum(sizes.values()) / shards
        assert set(after) == set(sizes) and set(loads) == set(range(shards)) and max(loads.values()) < 1.05 * share
        moved = sum(sizes[s] for s in sizes if before[s] != after[s])
        assert moved < 0.45 * sum(sizes.values())
        sharding.write_map(new, path, new.first()["version"])
    assert sharding.read_map(spark, path).first()["version"] == 3 and sharding.read_map(spark, path, 1).count() == 300
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.write_map(first, path, 1)
    for docs in (odd_docs, no_docs):
        records = docs.select("doc_id", sharding.record_size(docs["text"]).alias("size"), sharding.slot_of(docs["doc_id"], 16).alias("virtual_slot"))
        placed = sharding.assigned(records, sharding.first_map(sharding.slot_table(records), 4), ("doc_id", "size"))
        assert placed.count() == docs.count()


def test_repeated_passages(spark, odd_docs, no_docs, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen, words = defaultdict(set), 50
    for doc_id, text in texts.items():
        parts = text.split()
        for i in range(len(parts) - words + 1):
            seen[tuple(parts[i : i + words])].add(doc_id)
    expected = {d for x in seen.values() if len(x) > 1 for d in x}
    found = chunks.repeated_passages(docs).collect()
    assert expected <= {r["doc_id"] for r in found}
    for r in found:
        if not r["kept"]:
            part = texts[r["doc_id"]][r["start"] : r["end"]]
            assert r["words"] <= len(part.split()) + 1 and any(part[:40] in texts[d] for d in texts if d != r["doc_id"])
    rest = chunks.without_repeats(docs.where("doc_id < 200"))
    assert rest.count() == docs.where("doc_id < 200").count() and rest.columns == docs.columns
    odd = rows(chunks.repeated_passages(odd_docs))
    assert {r[0] for r in odd} == {5, 6} and rows(chunks.repeated_passages(no_docs)) == []
    text = texts[max(texts, key=lambda d: len(texts[d]))].encode()
    whole = chunks.boundaries(text)
    monkeypatch.setattr(chunks, "BLOCK", 100)
    assert (chunks.boundaries(text) == whole).all() and 20 < len(text) / len(whole) < 50


def test_copies_next_to_first_occurrences(spark):
    """Document 2 is document 1 with one sentence edited, 3 an exact copy of 2."""
    rng = np.random.default_rng(3)
    sentences = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60)) + "." for _ in range(7)]
    one = " ".join(sentences[:6])
    two = " ".join([*sentences[:3], sentences[6], *sentences[4:6]])
    docs = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id bigint, text string")
    found = chunks.repeated_passages(docs).collect()
    repeats = {d: "".join(two[r["start"] : r["end"]] for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] == d and not r["kept"]) for d in (2, 3)}
    assert len(repeats[2]) > 0.7 * len(one) and len(repeats[3]) > 0.9 * len(two)
    texts = {r["doc_id"]: r["text"] for r in chunks.without_repeats(docs).collect()}
    assert texts[1] == one and sentences[6][70:-70] in texts[2] and len(texts[2]) < 0.3 * len(two) and len(texts[3]) < 0.1 * len(two)


def earlier_windows(texts, size):
    """(doc_id, start, end) of every window of `size` words that stands, byte for byte, in an earlier document."""
    first, held = {}, []
    for doc_id in sorted(texts):
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[doc_id])]
        for i in range(len(words) - size + 1):
            start, end = words[i][0], words[i + size - 1][1]
            part = texts[doc_id][start:end]
            if first.setdefault(part, doc_id) != doc_id:
                held.append((doc_id, start, end))
    return held


def test_every_repeated_window_is_reported(spark):
    """All 50-word windows of sf0.01, and single passages of about that size, which chunks alone miss."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    some = lambda n: " ".join(word() for _ in range(n))
    at = max(texts)
    for i in range(300):
        passage = some(int(rng.integers(50, 61)))
        for _ in range(2):
            at += 1
            texts[at] = f"{some(30)} {passage} {some(30)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    repeats = defaultdict(list)
    for r in chunks.repeated_passages(docs).where("NOT kept").collect():
        repeats[r["doc_id"]].append((r["start"], r["end"]))
    windows = earlier_windows(texts, 50)
    assert len({d for d, _, _ in windows}) > 300
    assert [w for w in windows if not any(a <= w[1] and w[2] <= b for a, b in repeats[w[0]])] == []
    twenty = defaultdict(set)
    for d, a, b in earlier_windows(texts, 20):
        twenty[d].update(range(a, b))
    for d, found in repeats.items():
        assert all(set(range(a, b)) <= twenty[d] for a, b in found)


def test_repeats_without_spaces_and_of_one_word(spark):
    rng = np.random.default_rng(5)
    passage = "".join(map(chr, rng.integers(0x4E00, 0x9000, 120)))
    others = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 60))) for _ in range(4)]
    docs = spark.createDataFrame([
        (1, others[0] + passage + others[1]), (2, others[2] + passage + others[3]), (3, "x " * 3000), (4, "y " + "x " * 2000)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in chunks.repeated_passages(docs).where("NOT kept").collect()}
    assert (found[2]["start"], found[2]["end"]) == (60, 180) and set(found) == {2, 4} and found[4]["words"] == 2000


def brute_near(docs):
    sets = {}
    for doc_id, text in docs:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        size = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


@pytest.mark.parametrize("direct, enough", [(32, 32), (1, 32), (1, neardup.COORDINATES + 1)])
def test_near_duplicates(spark, monkeypatch, direct, enough):
    """A crowd that shares a passage, chains of edits, copies; with long lists and without."""
    monkeypatch.setattr(neardup, "DIRECT", direct)
    monkeypatch.setattr(neardup, "ENOUGH", enough)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(120):
        texts.append(passage + [word() for _ in range(int(rng.integers(1, 60)))])
    chain = [word() for _ in range(80)]
    for _ in range(25):
        chain = chain[:]
        chain[int(rng.integers(0, 80))] = word()
        texts.append(chain)
    texts += [texts[3], [w.upper() for w in texts[5]], [], ["one"], ["one"], ["one", "two"], texts[130]]
    docs = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(1000), texts, strict=False)]
    found = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == brute_near(docs)


def test_odd_rows_of_near_duplicates(odd_docs, no_docs):
    found = neardup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count() and neardup.near_duplicates(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[8]["component_id"] == 1 and by_id[6]["component_id"] == 5 and by_id[2]["n_shingles"] == by_id[4]["n_shingles"] == 0
    assert by_id[None]["component_id"] is None and by_id[None]["kept"] and by_id[2]["kept"]


def brute_bounds(levels, counts, buckets):
    from itertools import combinations

    best = None
    for inner in combinations(levels[:-1], min(buckets, len(levels)) - 1):
        bounds = [*inner, levels[-1]]
        cost = sum(n * min(b for b in bounds if b >= x) for x, n in zip(levels, counts, strict=True))
        if best is None or cost < best[0]:
            best = (cost, bounds)
    return best


def test_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        levels = sorted(rng.choice(np.arange(32, 2000, 32), int(rng.integers(1, 9)), replace=False).tolist())
        counts = rng.integers(1, 50, len(levels)).tolist()
        for buckets in (1, 2, 4):
            found = packing.optimal_bounds(levels, counts, buckets)
            cost = sum(n * min(b for b in found if b >= x) for x, n in zip(levels, counts, strict=True))
            assert cost == brute_bounds(levels, counts, buckets)[0] and len(found) == min(buckets, len(levels))
    assert packing.optimal_bounds([], []) == []


def test_packing(odd_docs, no_docs):
    found = packing.packed(odd_docs, buckets=3, budget=5000).collect()
    words = {r["doc_id"]: 0 for r in odd_docs.collect()}
    assert len(found) == 12 + 2 * 22 - 1 and {r["doc_id"] for r in found} == set(words)
    batches = defaultdict(list)
    for r in found:
        if r["tokens"]:
            assert r["tokens"] + r["padding"] == r["bound"] and r["padding"] >= 0
            batches[r["bucket"], r["batch"]].append(r)
        else:
            assert r["bucket"] is None and r["batch"] is None
    for held in batches.values():
        assert sorted(r["place"] for r in held) == list(range(len(held)))
        assert len(held) == 1 or len(held) * held[0]["bound"] <= 5000
    assert packing.packed(no_docs).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "personal_data", "packing"]
    one = stages["language_id"](spark, docs, SF)
    assert one.columns == docs.columns
    model = language.fit(docs.select("doc_id", "text", "lang"))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect() if not model.predict(r["text"])[2]}
    two = stages["near_dedup"](spark, one, SF)
    near = brute_near([(r["doc_id"], r["text"]) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for d, x in near.items() if x[2])
    three = stages["decontamination"](spark, two, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontaminate.contaminated(two, items).collect()}
    assert leaking and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - leaking
    four = stages["personal_data"](spark, three, SF)
    assert four.columns == docs.columns and four.count() == three.count()
    assert sum(len(r["base"]) for r in pii.find(four).collect()) == 0
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in four.collect()}


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd_docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_texts_meet_their_items_when_partitions_are_merged(spark):
    """Both sides come dealt out by the keys; the texts fill their partitions, the items do not and are merged."""
    keys = spark.range(400, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), (F.col("id") % 2).alias("begin"), "id")
    once = keys.groupBy("digest", "begin").agg(F.first(F.concat_ws("-", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(40)])).alias("piece"))
    asked = keys.groupBy("digest", "begin").agg(F.first("id").alias("item")).select(
        "digest", "begin", "item", F.col("item").alias("item_id"), F.lit("x").alias("text"))
    settings = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = rows(decontaminate.side_by_side(asked, once).select("digest", "item", F.spark_partition_id(), F.length("text")))
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(found) == 800
    plan = decontaminate.side_by_side(asked, once)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(home" in plan.split("Union")[0]  # by the keys alone no exchange is left above the union
    for (digest, item, part, _), after in zip(found[::2], found[1::2]):
        assert item is None and after[0] == digest and after[1] is not None and after[2] == part
