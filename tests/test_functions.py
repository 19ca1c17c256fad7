"""Literal cases of the text, token, label and heading functions."""

import re

from pyspark.sql import functions as F
import pytest

from dossierlake.functions import headings as HD, labels as L, tables as TB, text as T, tokens as K
from dossierlake.operators import tagging as TG, taxonomy as TX, vectors as V
from dossierlake.operators.ranking import MAX_RECENCY_BOOST


@pytest.mark.parametrize("text,tokens", [
    ("클린룸 복구와 관련된 산출물 찾아줘", ["클린룸", "복구"]),
    ("the. a RND", ["the", "rnd", "연구개발", "연구", "연구개발", "rnd", "연구"]),
])
def test_tokenize(one, text, tokens):
    assert one(K.tokenize(F.lit(text))) == tokens


def test_synonyms_are_added(one):
    tokens = one(K.tokenize(F.lit("AI 기반 R&D")))
    assert {"ai", "인공지능", "rnd", "연구개발", "연구"} <= set(tokens)
    assert one(K.expand_synonyms(F.lit("AI기반"))) == "AI기반"


def test_matched_tokens(one):
    query = F.lit("클라우드 전환 근거 페이지 검색")
    assert one(K.matched_tokens(K.unique_tokens(query), F.lit("클라우드 전환 계획"))) == ["클라우드", "전환"]


@pytest.mark.parametrize("text,fallback,label", [
    ("표지\n본문 내용\n- 12 -", "3", "12"), ("본문 내용\nⅢ-67", "70", "Ⅲ-67"), ("본문 내용", "5", "5"), ("a\n0\nb", "9", "9"),
    ("Page 7\n" + "\n".join(f"line {i}x" for i in range(30)), "1", "7"),
])
def test_display_page(one, text, fallback, label):
    assert one(L.display_page(F.lit(text), F.lit(fallback))) == label


@pytest.mark.parametrize("token,year", [("20210818", "2021"), ("210927", "2021"), ("2025", "2025"), ("991231", "1999"), ("x", "")])
def test_year(one, token, year):
    assert one(L.year_of(F.lit(token))) == year


@pytest.mark.parametrize("name,kind", [
    ("사업_제안서.pdf", "제안서"), ("신규_RFP.docx", "RFP"), ("요구사항정의서.pptx", "요구사항정의서"), ("memo.pdf", "기타 산출물"),
])
def test_document_type(one, name, kind):
    assert one(L.document_type(F.lit(name))) == kind


def test_project_folder(one):
    row = one(L.parse_project_folder(F.lit("20210818_인천공항_원스톱 입주자서비스 플랫폼 설계 용역")))
    assert (row.year, row.client_name, row.project_name) == ("2021", "인천공항", "원스톱 입주자서비스 플랫폼 설계 용역")


def test_clean_and_snippet(one):
    assert one(T.clean_text(F.lit(" a \t b\r\n\r\n　\n c "))) == "a b\nc"
    assert one(T.trim_snippet(F.lit("x" * 600))) == "x" * 499 + "..."
    assert one(T.evidence_sentence(F.lit("복구를 수행한다. 다음 문장"))) == "복구를 수행한"


@pytest.mark.parametrize("text,norm", [("Ⅲ. 목표모델 수립", "목표모델수립"), ("III. Target", "target"), ("1.2 인프라 설계", "인프라설계"), ("DR", "dr")])
def test_normalize_chapter(one, text, norm):
    assert one(HD.normalize_chapter(F.lit(text))) == norm


def test_normalize_taxonomy(one):
    assert one(HD.normalize_taxonomy(F.lit("Ⅲ. 목표 아키텍처 수립"))) == "목표아키텍처수립"


@pytest.mark.parametrize("text,chapter", [("TO-BE 아키텍처", "목표모델"), ("Requirements", "요구사항분석"), ("기타", "기타"), ("회사 소개", "")])
def test_canonical_chapter(one, text, chapter):
    assert one(HD.canonical_chapter(F.lit(text))) == chapter


def test_taxonomy_match(one):
    levels = [TX.Lexicon(a, TX.HEADING_THRESHOLD).match for a in TX.KOREAN_TAXONOMY]
    chapters, sections, subsections = levels
    assert chapters("Ⅲ. 목표 아키텍처 수립")[0] == "목표모델"
    assert sections("3.1 인프라 구성 방안")[0] == "인프라 아키텍처"
    assert subsections("3.1.2 원격지 재해복구센터 구축")[0] == "DR/백업/이중화"
    assert chapters("목표모델") == ("목표모델", 1.0, "exact:목표모델")
    assert chapters("zzzz") == chapters("") == ("", 0.0, "")
    several = one(TX.best_of(TX.KOREAN_TAXONOMY[0])(F.array(F.lit("zzzz"), F.lit("목표모델"), F.lit("기타"))))
    assert several["canonical"] == "목표모델" and several["confidence"] == 1.0


def test_table_type(one):
    body = F.lit("성명 | 등급 | 역할\n홍길동 | 특급 | PM")
    assert one(TB.looks_like_table(body)) and one(TB.table_type(body)) == "staff"
    assert not one(TB.looks_like_table(F.lit("plain text")))


def test_domain_tags(one):
    tags = one(TG.domain_tags(F.lit("MSA 컨테이너 기반 클라우드 전환")))
    assert tags[:4] == ["CLOUD_COST", "클라우드", "MSA", "컨테이너"] and "CLOUD" in tags and len(tags) <= 24


def test_hashed_cosine(spark, one):
    import hashlib
    import math

    def plain(tokens):
        cells = {}
        for token in tokens:
            digest = hashlib.md5(token.encode()).digest()
            slot = int.from_bytes(digest[:4], "big") % 384
            cells[slot] = cells.get(slot, 0) + (1 if digest[4] % 2 == 0 else -1)
        return {k: v for k, v in cells.items() if v}

    left, right = "alpha beta gamma beta delta", "beta delta omega"
    got = {c.slot: c.weight for c in one(V.sparse_cells(F.lit(left)))}
    a, b = plain(left.split()), plain(right.split())
    assert got == a
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = sum(a[k] * b.get(k, 0) for k in a) / norm(a) / norm(b)
    rows = spark.createDataFrame([(left, right), ("", right)], "l string, r string")
    cells = rows.select(V.sparse_cells("l").alias("l"), V.sparse_cells("r").alias("r"))
    assert [r.c for r in cells.select(V.cells_cosine(F.col("l"), F.col("r")).alias("c")).collect()] == [pytest.approx(want), 0.0]


def test_recency_boost(spark):
    from dossierlake.operators.ranking import recency_factor

    rows = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 0.0)], "id int, m double").withColumn("q", F.lit(1))
    got = {r.id: r.b for r in rows.select("id", recency_factor(F.col("m"), "q").alias("b")).collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(MAX_RECENCY_BOOST) and got[3] == 1.0


def test_long_headings_are_not_compared_letter_by_letter(monkeypatch):
    from dossierlake.lexicons.corpus import CORPUS_CHAPTERS
    from dossierlake.operators import taxonomy

    asked = []
    counted = taxonomy.SequenceMatcher.quick_ratio
    monkeypatch.setattr(taxonomy.SequenceMatcher, "quick_ratio", lambda self: asked.append(len(self.a)) or counted(self))
    lexicon = taxonomy.Lexicon(CORPUS_CHAPTERS, taxonomy.HEADING_THRESHOLD)
    lexicon.match("zqj " * 1000)
    assert not asked
    lexicon.match(lexicon.aliases[0][:-1] + "zq")
    assert asked


ODD = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x85", "\u00a0", "\u2028", "\u3000", ".", "a", "Ai", "인공지능", "R & D", "r-d", "xrnd", "𝐀rnd", "é", "İ",
       "Chapter 3", "chap ter", "장", "챕터", "제 3 장", "Ⅲ. ", "IV. ", "1.2 ", "Ni-cht", "목표모델", "기타", "99", "_", "~", "{", "\x00"]


def test_guarded_patterns_do_what_the_plain_ones_do(spark):
    import random

    from dossierlake.functions import headings as HD, text as T, tokens as K

    rng = random.Random(3)
    rows = spark.createDataFrame([("".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))),) for _ in range(4000)], "t string")
    text = F.col("t")
    words = F.regexp_replace(text, f"(?i)(?<![{K.WORD}])(?:r\\s*&\\s*d|r\\s*[-_/]\\s*d|rnd)(?![{K.WORD}])", " RND 연구개발 ")
    blank = f"[{T.BLANKS}]"
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " "), f"{blank}*\n{blank}*", "\n")
    norm = F.trim(text)
    for prefix in (HD.CHAPTER_PREFIX, HD.NUMERAL_PREFIX, HD.NUMBER_PREFIX):
        norm = F.regexp_replace(norm, prefix, "")
    pairs = [
        (T.strip(text), F.regexp_replace(text, T.EDGE_BLANKS, "")), (T.squeeze(text), F.trim(F.regexp_replace(text, f"{blank}+", " "))),
        (T.clean_text(text), F.regexp_replace(lines, T.EDGE_BLANKS, "")),
        (F.regexp_replace(text, K.RND_PATTERN, " RND 연구개발 "), words),
        (F.rlike(text, F.lit(K.AI_PATTERN)), F.rlike(text, F.lit(f"(?i)(?<![{K.WORD}])ai(?![{K.WORD}])"))),
        (HD.normalize_chapter(text), F.regexp_replace(F.regexp_replace(F.lower(norm), HD.DROPPED_WORDS, ""), HD.NOT_TITLE_CHARS, "")),
    ]
    different = rows.select(*[F.sum((a != b).cast("int")).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    assert list(different) == [0] * len(pairs)


def test_the_title_marks_of_a_long_line_are_not_replaced_one_by_one():
    from dossierlake.functions import headings as HD, text as T

    # blanks between words, the most frequent match by far, are no work for a pattern any more
    assert "replace(" in str(HD._title_chars(F.col("t"))) and T.NOT_PRINTED in str(T.squeeze("t"))


def test_requirements_are_worked_out_once_for_all_queries_of_a_request(spark):
    from dossierlake.operators import requests as RQ

    reads = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(body):
        reads.add(1)
        return [s for s in body.split("|") if s]

    texts = ["클라우드 전환 전략 수립|데이터 이관 방안 수립", "", "api 연계 구축 1,000만원", "요구사항 3.5 분석|api 연계 구축"]
    rows = [(i, texts[i % 4]) for i in range(20)] + [(0, texts[1]), (None, texts[0]), (None, texts[3])]
    requests = spark.createDataFrame(rows, "id int, body string").coalesce(1).withColumn("sections", counted("body"))
    found = RQ.weighted_queries(requests, "id", "sections", "body").collect()
    assert reads.value == len(rows)
    assert {r["query_text"] for r in found if r["id"] == 2} and {r["position"] for r in found if r["id"] == 3} >= {0, 100, 101}


def test_words_of_letters_alone_are_judged_as_the_others(one):
    from dossierlake.operators import requests as RQ

    def judged(word):
        c = RQ.plain_compact(word)
        money = re.search(RQ.MONEY_OR_PERIOD, word)
        return 2 <= len(c) <= 20 and not money and not c.isdigit() and not any(n in c for n in RQ._compacts(RQ.KOREAN_REQUESTS.noise))

    words = ["a", "ab", "Api", "클라우드", "x" * 20, "x" * 21, "가" * 21, "10개월", "2024.01", "1,000원", "12", "1.2", "a.b", "a-", "c++", "r&d", "é", "éa", "3d", *RQ.KOREAN_REQUESTS.noise]
    assert one(F.array(*[RQ.is_valid_keyword(F.lit(w)) for w in words])) == [judged(w) for w in words]
