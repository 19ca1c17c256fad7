"""Duplicate removal against the sequential rule written out row by row."""

import hashlib
import os
import random
import uuid

from pyspark.sql import functions as F
import pytest

from dossierlake import session
from dossierlake.functions.tokens import tokenize
from dossierlake.operators import dedup as D, delta as DL


def shingles(text):
    tokens = text.split()
    if len(tokens) < 5:
        return {hashlib.sha1(t.encode()).hexdigest()[:12] for t in tokens}
    return {hashlib.sha1(" ".join(tokens[i:i + 5]).encode()).hexdigest()[:12] for i in range(len(tokens) - 4)}


def sequential(rows, threshold=0.8):
    kept, out = {}, {}
    for doc, project, text, mtime in sorted(rows, key=lambda r: (-r[3], r[0])):
        own = shingles(text)
        matches = [
            (k[1], k[0]) for k in kept.get(project, [])
            if own and k[2] and len(own & k[2]) / len(own | k[2]) >= threshold
        ]
        if matches:
            out[doc] = (False, max(matches, key=lambda m: (m[0], -m[1]))[1])
        else:
            kept.setdefault(project, []).append((doc, mtime, own))
            out[doc] = (True, None)
    return out


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[random.choice(words) for _ in range(60)] for _ in range(6)]
    rows = []
    for doc in range(160):
        kind = random.random()
        base = list(bases[0] if kind < 0.4 else random.choice(bases))  # one crowd of near copies
        if kind > 0.3:
            for _ in range(random.randrange(0, 3)):
                base[random.randrange(len(base))] = random.choice(words)
        if kind > 0.9:
            base = [random.choice(words) for _ in range(random.choice([0, 1, 3, 8, 40]))]
        rows.append((doc, f"p{random.randrange(2)}", " ".join(base), float(random.randrange(40))))
    return rows


def crowd(seed):
    """Texts that share a long passage and are not copies of each other, with some that are."""
    random.seed(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for doc in range(120):
        own = [f"x{random.randrange(10**6)}" for _ in range(random.choice([4, 8, 12, 30]))]
        rows.append((doc, "p", " ".join(passage + own), float(random.randrange(60))))
    rows += [(200 + i, "p", rows[i][2] + " tail", 70.0 + i) for i in range(20)]
    return rows


@pytest.mark.parametrize("rounds,make,seed", [(0, corpus, 1), (2, corpus, 1), (2, corpus, 2), (2, crowd, 3), (0, crowd, 3)])
def test_keepers_match_the_sequential_rule(spark, rounds, make, seed):
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc bigint, project string, text string, mtime double")
    got = D.keep_newest(docs, "doc", "text", "project", "mtime", leader_rounds=rounds)
    assert {r.doc: (r.kept, r.duplicate_of) for r in got.collect()} == sequential(rows)


def test_near_copies(spark):
    base = "클라우드 전환 목표 아키텍처 수립 데이터 이관 검증 절차 " * 20
    docs = spark.createDataFrame([(1, base), (2, base + "추가 보완 내용")], "id int, text string").select(
        "id", D.signature("text").alias("s")
    )
    a, b = [r.s for r in docs.orderBy("id").collect()]
    assert len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8


def test_a_crowd_around_one_passage_never_meets_in_pairs(spark):
    """20,000 texts that share a passage and are no copies, and a copy of every tenth: what meets grows with the texts."""
    n = 20_000
    own = F.sequence(F.lit(1000) + F.col("id") * 50, F.lit(1019) + F.col("id") * 50 + F.col("id") % 5)
    numbers = F.concat(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint")), own)
    texts = spark.range(n).select(F.lit("p").alias("project"), F.col("id").alias("leader"), numbers.alias("numbers"))
    copies = texts.where("leader % 10 = 0").select("project", (F.col("leader") + n).alias("leader"), F.array_append("numbers", F.lit(-1) - F.col("leader")).alias("numbers"))
    classes = texts.unionAll(copies).select("*", F.struct(F.col("leader").alias("m"), (-F.col("leader")).alias("k")).alias("rank"), F.size("numbers").alias("hashes"))
    postings = D.checkpoint(D.prefix_postings(classes, "project", 0.8))
    assert postings.where("hash < 100").groupBy("hash").count().agg(F.max("count")).first()[0] >= n  # the lists are as long as the crowd
    met = D._met(postings, postings, "project", 0.8)
    assert n // 10 <= met.count() <= 60 * n
    pairs = D._similar(D._candidates(postings, postings, "project", 0.8), classes, 0.8)
    assert {(r["newer"], r["older"]) for r in pairs.collect()} == {(i + n, i) for i in range(0, n, 10)}


@pytest.mark.parametrize("make,seed", [(corpus, 1), (corpus, 5), (crowd, 3)])
def test_a_further_run_compares_only_what_meets_in_the_kept_postings(spark, tmp_path, make, seed):
    rows = make(seed)
    half = [r for r in rows if r[0] % 2 == 0]
    docs = spark.createDataFrame(rows, "doc bigint, project string, text string, mtime double").withColumn("signature", D.signature("text"))
    first = {d: k for d, (k, _) in sequential(half).items()}
    expected = sequential([r for r in rows if r[0] % 2 or first[r[0]]])
    ids = spark.createDataFrame([(d,) for d, k in first.items() if k], "doc bigint")
    indexed, new = D.checkpoint(docs.join(ids, "doc", "left_semi")), docs.where("doc % 2 = 1")
    common, path = DL.common_hashes(indexed, "doc", "project"), str(tmp_path / "postings")
    for _ in range(2):  # a repeated run only repeats postings
        DL.save(DL.prefixes(indexed, "doc", "project", common), path)
    added = D.checkpoint(DL.prefixes(new, "doc", "project", common))
    old = DL.kept(spark, path, added)
    got = {r["doc"]: (r["kept"], r["duplicate_of"]) for r in DL.keep_newest(new, indexed, added, old, "doc", "project", "mtime").collect()}
    assert got == {d: v for d, v in expected.items() if d in got} and {r[0] for r in rows if r[0] % 2} <= set(got)
    assert all(kept for d, (kept, _) in expected.items() if d not in got)
    assert make is crowd or len(got) < len(expected)


ODD_TEXTS = [
    None, "", " \n", "a b c", "one", "클라우드는", "R&D 사업의 R & D, r/d rnd.", "AI 인공지능 ai. 연구를 연구개발은", "the and of 및 등", "a.. b-- c## x.y.. 가.. 나는.",
    "Größe naïve ＡＩ K ſ 漢字 кот \u0130stanbul 한글ABC는 abc을 \U0001f600 tail", "w. " * 30, " ".join(f"Wort{i % 37}에서 term{i}. R&D" for i in range(3000)),
]


def test_signatures_are_made_from_the_tokens_of_the_tokenizer(spark):
    texts = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string")
    got = {r["id"]: r for r in texts.select("id", tokenize("text").alias("t"), D.signature("text").alias("s"), D.signed_numbers("text").alias("n")).collect()}
    for i, r in got.items():
        expected = sorted(shingles(" ".join(r["t"])))[:D.SIGNATURE_HASHES]
        assert r["s"] == expected and r["n"]["numbers"] == [int(h, 16) for h in expected], i
    assert max(len(r["s"]) for r in got.values()) == D.SIGNATURE_HASHES and got[0]["n"]["digest"] == got[1]["n"]["digest"]


def in_one_order(sets, common, threshold=0.8):
    """(hash, project, leader, before) of each set's prefix, from all its hashes."""
    out = set()
    for (project, leader), numbers in sets.items():
        ordered = sorted(numbers, key=lambda h: (common.get((h, project), 0), h))
        room = len(ordered) + 1 - -(-len(ordered) * 4 // 5)
        out |= {(h, project, leader, i) for i, h in enumerate(ordered[:room])}
    return out


def test_prefixes_are_those_of_all_hashes_in_one_order(spark):
    """Common hashes at the start, at the end, throughout and in runs that reach past the smallest hashes."""
    random.seed(7)
    sets = {}
    for leader in range(150):
        own = random.sample(range(10_000), random.choice([1, 2, 5, 40, 120]))
        shared = random.choice([[], range(0, 30), range(0, 300, 5), range(9_900, 9_950), range(2_000, 2_060), range(0, 400)])
        sets[(f"p{leader % 2}", leader)] = sorted(set(own) | set(random.sample(list(shared), len(shared) * 4 // 5)))
    rows = [(p, i, float(i), n, len(n)) for (p, i), n in sets.items()]
    classes = spark.createDataFrame(rows, "project string, leader bigint, rank double, numbers array<bigint>, hashes int")
    common = D.common_hashes(classes, "project", 0.8)
    known = {(r["hash"], r["project"]): r["df"] for r in common.collect()}
    got = [tuple(r) for r in D.prefixes(classes, "project", common, 0.8).select("hash", "project", "leader", "before").collect()]
    assert known and len(got) == len(set(got)) and set(got) == in_one_order(sets, known)
    lists = {}
    for h, p, i, _ in got:
        lists.setdefault((h, p), []).append(i)
    assert all(len(x) < 2 * D.COMMON for k, x in lists.items() if k not in known)
    assert all(known[h, p] <= sum(h in n for (q, _), n in sets.items() if q == p) for h, p in known)


def shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_the_prefixes_of_the_signatures_are_shuffled(spark):
    sets = spark.range(400).select(
        F.lit("p").alias("project"), F.col("id").alias("leader"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64(i, "id")).alias("numbers"))
    classes = D.checkpoint(sets.select("*", F.struct(F.col("leader").alias("m"), (-F.col("leader")).alias("k")).alias("rank"), F.size("numbers").alias("hashes")))
    before = shuffled(spark)
    assert D.prefix_postings(classes, "project", 0.8).count() == 0
    assert 400 * 200 < shuffled(spark) - before < 400 * 500  # of 400,000 hashes


def test_postings_that_meet_none_are_not_put_into_bands(spark, tmp_path):
    sets = spark.range(800).select(
        F.lit("p").alias("project"), F.col("id").alias("leader"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64(i, F.col("id") % 790)).alias("numbers"))
    classes = sets.select("*", F.size("numbers").alias("hashes"))
    none = spark.createDataFrame([], "hash bigint, project string, df bigint")
    postings = D.checkpoint(D.prefixes(classes, "project", none, 0.8).withColumn("rank", F.lit(0)))
    before = shuffled(spark)
    met = DL.near(postings.where("leader >= 400"), postings.where("leader < 400"))
    assert sorted(r["leader"] for r in met.collect()) == list(range(10))
    assert shuffled(spark) - before < 3 * postings.count()


def test_stored_signatures_are_neither_copied_nor_shuffled_and_no_shuffle_file_stays(spark, tmp_path, monkeypatch):
    def files(top):
        return {os.path.join(at, n): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(str(top)) for n in names}

    def shuffle_files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for top in disk.localDirs() for f in files(top) if os.path.basename(f).startswith("shuffle_")}

    common = F.when(F.col("id") % 3 == 0, F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64(i, F.col("id") % 1990).bitwiseAND(2**48 - 1))
    sets = spark.range(2000).select("id", F.lit("p").alias("project"), F.col("id").cast("double").alias("mtime"), F.array_sort(F.array_distinct(F.concat(common, own))).alias("signature"))
    sets.withColumn("digest", F.sha2(F.array_join(F.col("signature").cast("array<string>"), " "), 256)).write.parquet(f"{tmp_path}/stored")
    stored, before = spark.read.parquet(f"{tmp_path}/stored"), shuffle_files()
    monkeypatch.setattr(session, "shared_folder", lambda spark, name: f"{tmp_path}/kept/{name}-{uuid.uuid4().hex}")
    judged = D.keep_newest(stored, "id", "signature", "project", "mtime", signed=True)
    assert shuffle_files() <= before
    assert sum(files(f"{tmp_path}/kept").values()) < sum(files(f"{tmp_path}/stored").values()) / 2
    got = {r["id"]: (r["kept"], r["duplicate_of"]) for r in judged.collect()}
    assert got == {i: (i >= 10, i + 1990 if i < 10 else None) for i in range(2000)}
