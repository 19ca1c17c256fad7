"""Units, heading inheritance, chunk windows and the chunk table."""

import re

from pyspark.sql import functions as F

from dossierlake.operators import ingest as IN


def units(spark, pages):
    rows = [(1, [(i, text, section) for i, (text, section) in enumerate(pages, start=1)])]
    docs = spark.createDataFrame(rows, "doc int, units array<struct<page_no:int,text:string,section_title:string>>")
    return IN.with_headings(docs).orderBy("page_no").collect()


def test_chapter_is_inherited(spark):
    got = units(spark, [("Ⅲ. 목표모델 수립\n본문입니다", ""), ("이어지는 본문", ""), ("1.1 인프라 설계\n본문", "")])
    assert [r.chapter_title for r in got] == ["목표모델"] * 3
    assert got[2].section_title == "1.1 인프라 설계"
    assert got[2].heading_path == "목표모델 > 1.1 인프라 설계"


def test_unknown_headings_fall_back(spark):
    got = units(spark, [("Ⅰ. 사업 개요\n본문", ""), ("1. 수행 조직\n본문", "")])
    assert [r.chapter_title for r in got] == ["기타", "기타"]
    assert got[0].section_title == "Ⅰ. 사업 개요" and got[1].section_title == "1. 수행 조직"


def test_latin_words_are_no_numerals(spark):
    got = units(spark, [("Ⅲ. 목표모델 수립", ""), ("Cloud migration in detail", ""), ("Mixed content", "")])
    assert [r.chapter_title for r in got] == ["목표모델"] * 3 and got[2].section_title == ""


def test_paragraph_bundling(spark):
    lines = ["a" * 700, "b" * 600, "제목", "c" * 10, "d" * 1300]
    paragraphs = [(t, t == "제목") for t in lines]
    docs = spark.createDataFrame([(1, paragraphs)], "doc int, paragraphs array<struct<text:string,heading:boolean>>")
    got = IN.with_units(docs).first().units
    assert [len(u.text.split("\n")) for u in got] == [2, 3]
    assert [u.section_title for u in got] == ["", "제목"] and [u.page_no for u in got] == [1, 2]


def test_windows_overlap_and_cover():
    text = ("문장입니다. " * 400).strip()
    cuts = list(IN._cuts(text, 1000, 150, IN.SOFT_BREAKS, re.compile(IN.STATUTE)))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, end), (start, _) in zip(cuts, cuts[1:]):
        assert start == end - 150


def test_statute_names_stay_whole():
    name = "개인정보 보호에 관한 법률"
    text = "가" * 990 + " " + name + " 나" * 300
    cuts = list(IN._cuts(text, 1000, 150, IN.SOFT_BREAKS, re.compile(IN.STATUTE)))
    assert text[: cuts[0][1]].endswith("법률")


def test_chunk_table(spark):
    body = "Ⅲ. 목표 아키텍처 수립\n" + "\n".join(f"{i}. 성명 | 등급 | 역할" for i in range(3))
    docs = spark.createDataFrame(
        [("doc_1", "prj_1", "사업", "보고서", "보고서.docx", "a/보고서.docx", "보고서", 1.0, body)],
        "document_id string, project_id string, project_name string, document_title string, file_name string, "
        "file_path string, document_type string, file_mtime double, text string",
    )
    row = IN.chunk_table(docs).first()
    assert row.canonical_chapter_title == "목표모델" and row.table_type == "staff"
    assert row.embedding_text.startswith("문서명: 보고서") and row.chunk_id.startswith("chk_")
    assert row.index_version == IN.INDEX_VERSION and "목표모델" in row.heading_norm


def test_ingestion_never_shuffles(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc int, text string").coalesce(1)
    plan = IN.with_chunks(IN.units_of(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_heading_tree_derives_its_chunks_once(spark):
    from dossierlake.operators import reports as RP

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        reads.add(1)
        return value

    rows = [(f"d{i}", 1, "A", "s", "x, y", "") for i in range(20)]
    chunks = spark.createDataFrame(rows, "document_id string, page_no int, chapter_title string, section_title string, domain_keywords string, third string")
    chunks = chunks.withColumn("chapter_title", counted("chapter_title")).withColumns(
        {c: F.lit(None).cast("string") for c in ("canonical_chapter_title", "canonical_section_title", "canonical_subsection_title")})
    tree = RP.heading_tree(chunks).collect()
    assert {(r.level, r.label, r.chunk_count, r.top_keywords) for r in tree} == {(1, "A", 20, "x, y"), (2, "s", 20, "x, y")}
    assert reads.value == 20


def test_texts_without_a_statute_word_do_not_try_the_statute_pattern():
    class Never:
        def finditer(self, *_):
            raise AssertionError("tried")

    assert list(IN._cuts("word " * 900, 1000, 150, IN.SOFT_BREAKS, Never()))


def test_headings_are_read_once_for_their_names_and_norms(spark):
    from dossierlake.functions import headings as HD
    from dossierlake.lexicons.corpus import CORPUS_CHAPTERS

    def steps(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    titles = spark.createDataFrame([("a", "b", "c")], "chapter string, section string, path string")
    norms = steps(titles.select(HD.search_norm(F.col("chapter"), F.col("section"), F.col("path"), CORPUS_CHAPTERS).alias("x")))
    assert norms.count(HD.CHAPTER_PREFIX) == 3
    from dossierlake.operators import taxonomy as TX

    weighed = steps(TX.classify(titles, (CORPUS_CHAPTERS,) * 3, "chapter", "section", "path"))
    assert weighed.count("choose(") == 1


def test_levels_are_weighed_as_one_by_one(spark):
    from dossierlake.operators import taxonomy as TX

    titles = ["목표모델", "3. 목표 아키텍처 수립", "사업 개요 / 추진 배경", "", None, "현황분석 결과 요약", "a > b > 목표모델", " > 기대효과 >", "word " * 400 + "추진 방안"]
    rows = [(i, c, s, p) for i, (c, s, p) in enumerate((c, s, p) for c in titles[:4] for s in titles for p in titles)]
    units = spark.createDataFrame(rows, "id int, chapter string, section string, path string")
    parts = F.filter(F.transform(F.split("path", ">"), lambda p: F.trim(p)), lambda p: p != "")
    texts = [F.concat(F.array(own, "path"), parts) for own in ("chapter", "section", "section")]
    single = units.select("id", *[TX.best_of(level)(t).alias(f"m{i}") for i, (level, t) in enumerate(zip(TX.KOREAN_TAXONOMY, texts))])
    got = {r["id"]: r for r in TX.classify(units, TX.KOREAN_TAXONOMY, "chapter", "section", "path").collect()}
    for r in single.collect():
        hits = [m for m in (r["m0"], r["m1"], r["m2"]) if m["canonical"]]
        now = got[r["id"]]
        assert (now["canonical_chapter_title"], now["canonical_section_title"], now["canonical_subsection_title"]) == tuple(r[f"m{i}"]["canonical"] for i in range(3))
        assert now["canonical_heading_path"] == " > ".join(m["canonical"] for m in hits)
        assert now["heading_classification_confidence"] == max((m["confidence"] for m in hits), default=0.0)
        assert now["heading_classification_reason"] == " | ".join(m["reason"] for m in hits if m["reason"])
    assert any(r["canonical_heading_path"] for r in got.values())
