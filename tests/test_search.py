"""Retrieval, fusion, boosts, query understanding, extraction and requests on literal fixtures."""

from pyspark.sql import functions as F
import pytest

from dossierlake.functions.headings import chapter_norms
from dossierlake.operators import batch as B, evidence as EV, intents as Q, keyword as KW, ranking as R, requests as RQ, rerank as RR, search as H

COLUMNS = (
    "chunk_id string, document_id string, document_title string, document_type string, file_path string, project_name string, "
    "file_mtime double, page_no int, section_title string, chunk_text string, embedding_text string"
)


def chunk(name, title, path, text, project="사업", mtime=0.0):
    return (name, "d" + name, title, "보고서", path, project, mtime, 42, "", text, text)


def search(spark, rows, query, **options):
    return [r.chunk_id for r in H.search(spark.createDataFrame(rows, COLUMNS), query, 3, **options).orderBy("rank").collect()]


def test_single_hit(spark):
    rows = [chunk("1", "결과", "a/report.pdf", "클린룸 복구 절차"), chunk("2", "다른 문서", "a/other.pdf", "무관한 내용")]
    assert search(spark, rows, "클린룸 복구") == ["1"]


def test_prefix_scope(spark):
    rows = [chunk("1", "a", "root/one/a.pdf", "데이터 이관"), chunk("2", "b", "root\\two\\b.pdf", "데이터 이관")]
    assert set(search(spark, rows, "데이터 이관")) == {"1", "2"}
    assert search(spark, rows, "데이터 이관", filters={"path_prefixes": ["root/two/"]}) == ["2"]


@pytest.mark.parametrize("scope,first", [("report", "2"), ("proposal", "1")])
def test_scope_boost(spark, scope, first):
    rows = [chunk("1", "기술 및 기능", "x/a.pdf", "클라우드 전환 계획"), chunk("2", "목표모델", "x/b.pdf", "클라우드 전환 계획")]
    assert search(spark, rows, "클라우드 전환", scope={"scope": scope})[0] == first


def test_rnd_expansion(spark):
    rows = [chunk("1", "a", "x/a", "AI 모델", project="R&D 사업"), chunk("2", "b", "x/b", "다른 모델")]
    assert search(spark, rows, "R&D")[0] == "1" and search(spark, rows, "AI 기반 연구")[0] == "1"


def test_batch_equals_single(spark):
    texts = ["alpha beta", "alphabet gamma", "beta.gamma-x", "x" * 300 + "needle" + "y" * 300, "r&d alpha", "가나다 알파"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "needle beta"), (3, "lpha"), (4, "R&D 가나"), (5, "")], "query_id int, query_text string")
    got = {(r.query_id, r.id): r.keyword_score for r in B.coverage_top(rows, "id", KW.haystack("body"), queries, 100).collect()}
    want = {}
    for query in queries.collect():
        for r in KW.coverage_scores(rows, query.query_text, KW.haystack("body")).collect():
            want[(query.query_id, r.id)] = r.keyword_score
    assert got == want and len(want) >= 8


def test_the_best_rows_are_taken_before_texts_are_embedded(spark, monkeypatch):
    """The scan ends in a top-k without sorting all rows, and the Python function is above it, on k rows."""
    plans = []
    kept = KW.checkpoint
    monkeypatch.setattr(KW, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "chunk_text").withColumns(
        {"file_mtime": F.lit(1.0), "file_path": F.col("source"), "document_title": F.col("lang"), "document_type": F.col("lang"), "project_name": F.col("source")})
    ranked = H.search(docs, "the nicht", 5, key="doc_id", body="chunk_text")
    (scan,) = plans
    assert "TakeOrderedAndProject" in scan and "Python" not in scan and "rangepartitioning" not in scan and scan.count("Scan parquet") == 1
    above = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Python" in above and "Scan parquet" not in above
    assert ranked.count() == 5


def test_fusion(spark):
    keyword = spark.createDataFrame([("keyword_hit", 0.5)], "id string, keyword_score double")
    vector = spark.createDataFrame([("vector_only", 1.0), ("keyword_hit", 0.2)], "id string, vector_score double")
    strict = R.fuse(keyword, vector, ["id"], allow_vector_only=False).collect()
    assert [(r.id, r.score) for r in strict] == [("keyword_hit", 0.32)]
    assert R.fuse(keyword, vector, ["id"]).count() == 2


def test_chapter_filter():
    assert chapter_norms("To-Be")[0] == "목표모델" and "tobe" in chapter_norms("목표모델")


NATURAL = [
    ("목표모델에서 DR 관련 산출물 찾아줘", "architecture_evidence", "목표모델", {}),
    ("클라우드 비용 산정 관련 산출물 찾아줘", "cost_estimation", "비용산정", {}),
    ("정보기술동향에서 MSA 관련 내용 찾아줘", "technology_trend", "정보기술동향", {}),
    ("한국공항공사 사업 경험 있는 PM 찾아줘", "staff_experience", "", {"client": "한국공항공사", "role": "PM"}),
    ("ISP 수행 경험 있는 특급 PM 찾아줘", "staff_experience", "", {"project_type": "ISP", "role": "PM", "grade": "특급"}),
]


def parsed(spark, queries):
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id int, query_text string")
    return Q.expand_queries(Q.parse_queries(rows)).orderBy("query_id").collect()


def test_natural_queries(spark):
    for row, (query, domain, chapter, conditions) in zip(parsed(spark, [n[0] for n in NATURAL]), NATURAL):
        assert (row.search_domain, row.target_chapter) == (domain, chapter), query
        assert conditions.items() <= row.conditions.items(), query
        assert 0.0 <= row.confidence <= 0.95 and row.topic and row.expanded_keywords
    dr = parsed(spark, [NATURAL[0][0]])[0]
    assert dr.topic == "DR" and "재해복구" in dr.expanded_keywords


@pytest.mark.parametrize("query,chapter,topic", [
    ("목표모델에서 클라우드 구성 찾아줘", "목표모델", "클라우드 구성"),
    ("로드맵 챕터에서 단계별 일정을 알려줘", "이행계획", "단계별 일정"),
    ("재해복구 방안 검색해줘", "", "재해복구 방안"),
])
def test_chapter_split(spark, query, chapter, topic):
    row = Q.split_chapter_query(spark.createDataFrame([(1, query)], "query_id int, query_text string")).first()
    assert (row.chapter_filter, row.semantic_query) == (chapter, topic)


def test_rerank_and_extraction(spark):
    query = Q.expand_queries(Q.parse_queries(spark.createDataFrame([(0, NATURAL[4][0])], "query_id int, query_text string")))
    results = spark.createDataFrame(
        [(0, f"c{i}", "제안서", "홍길동 특급 PM ISP 수행. 뒤 문장", 1.0 - 0.01 * i, 0.8, 0.7) for i in range(12)],
        "query_id int, chunk_id string, document_title string, matched_text string, score double, keyword_score double, vector_score double",
    ).join(query, "query_id")
    ranked = RR.rerank(results, "chunk_id", 10)
    assert ranked.count() == 10
    row = EV.staff_rows(ranked).first()
    assert (row.name, row.grade, row.role, row.project_kind) == ("홍길동", "특급", "PM", "ISP")
    unnamed = EV.staff_rows(ranked.withColumn("matched_text", F.lit("특급 인력 투입 계획"))).first()
    assert unnamed.name == EV.UNKNOWN
    assert EV.structured_rows(ranked, "chunk_id").filter(F.col("fields")["성명"] == "홍길동").count() == 10


def test_weights_sum_to_one():
    assert all(abs(sum(w) - 1.0) < 1e-9 for w in RR.WEIGHTS.values())


REQUEST = """사업명: 차세대 플랫폼 구축
발주기관: 한국공사
사업기간: 12개월
사업예산: 1,000백만원
상세 요구사항
클라우드 네이티브 기반 MSA 아키텍처를 설계하고 API 연계 방안을 제시
데이터 아키텍처 현황분석 및 목표모델을 수립
평가항목 및 배점 기준
"""


def test_request(spark):
    rows = spark.createDataFrame([("r", REQUEST)], "id string, text string")
    summary = RQ.summarize(rows, "text").first()
    assert summary.business_name == "차세대 플랫폼 구축" and summary.client_name == "한국공사" and summary.business_type == "PI"  # the hint list is read in order, and API holds PI
    assert any("MSA" in s for s in summary.sections) and not any("사업예산" in s for s in summary.sections)
    sections = rows.withColumn("sections", RQ.requirement_sections(F.col("text")))
    words = [r.keyword for r in RQ.request_keywords(sections, "id", "sections", "text").orderBy("place").collect()]
    assert "클라우드네이티브" in words and any(w.lower() == "msa" for w in words) and any(w.lower() == "api" for w in words)
    assert not any("사업기간" in w or "예산" in w or "개월" in w for w in words)
    queries = RQ.weighted_queries(sections, "id", "sections", "text").orderBy("position").collect()
    assert {q.weight for q in queries} == {1.45, 1.35}
    assert queries[0].query_text == " ".join(words[:4])
    assert len({q.query_text for q in queries}) == len(queries)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_search_is_one_scan_with_top_k(spark):
    rows = spark.createDataFrame([chunk("1", "a", "x/a", "데이터")], COLUMNS)
    plan = plan_of(H.search(rows, "데이터", 3))
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_batch_coverage_joins_nothing(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, body string")
    queries = spark.createDataFrame([(1, "ab cd")], "query_id int, query_text string")
    plan = plan_of(B.coverage_top(rows, "id", KW.haystack("body"), queries, 5))
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_top_k_per_query_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 as q", "id", "cast(id as double) as s")
    assert "WindowGroupLimit" in plan_of(KW.top_rows_per(rows, "q", "s", "id", 5))


def test_request_keywords_read_their_sections_once(spark):
    """The plan of the result starts at what was written down, so no branch works out the sections again."""
    rows = spark.createDataFrame([(1, "alpha beta. gamma delta")], "id bigint, text string")
    rows = rows.withColumn("sections", F.split(F.concat("text", F.lit(" zzmark")), "[.]"))
    words = RQ.request_keywords(rows, "id", "sections", "text")
    assert "zzmark" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert {"alpha", "zzmark"} <= {r["keyword"] for r in words.collect()}


def test_pairs_of_a_common_word_do_not_wait_for_the_end_of_a_batch(spark, monkeypatch):
    import pandas as pd
    from dossierlake.operators import batch as B

    sizes, taken = [], {}
    monkeypatch.setattr(B.Best, "add", lambda self, query, key, score, **more: sizes.append(len(query)))
    monkeypatch.setattr(B, "scanned", lambda rows, queries, key, columns, start, k: taken.update(start=start) or (_ for _ in ()).throw(StopIteration))
    rows = spark.createDataFrame([(1, "common")], "id bigint, body string")
    asked = spark.createDataFrame([(1, "common")], "query_id bigint, query_text string")
    with pytest.raises(StopIteration):
        B.coverage_top(rows, "id", F.col("body"), asked, 5)
    add = taken["start"]([{"query_id": i, "terms": ["common"]} for i in range(1000)])
    add(pd.DataFrame({"id": range(2000), "hay": ["a common word"] * 2000, "within": [None] * 2000}), B.Best(1000, 5))
    assert sum(sizes) == 2_000_000 and max(sizes) <= B.PAIRS_WAITING + 1000
