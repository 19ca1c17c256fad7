"""Structured rows extracted from search results: evidence, staff, cost and technology tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import labels as L
from dossierlake.functions.text import bind, contains_any, evidence_sentence, first_contained, first_filled, text_or_empty
from dossierlake.functions.tokens import WORD
from dossierlake.operators.reports import UNKNOWN, document_area

# Terms, name patterns, output labels.
ROLE_TERMS = ("PM", "PL", "TA", "AA", "DA", "DBA", "개발", "컨설턴트")
GRADE_TERMS = ("특급", "고급", "중급", "초급")
PROJECT_TERMS = ("ISP", "ISMP", "BPR", "구축", "운영", "감리", "컨설팅", "전환", "표준화")
TREND_TERMS = ("동향", "트렌드", "최신", "적용", "사례", "시사점", "기술")
NAME_LABEL = "(?:성명|이름)\\s*[:：]?\\s*([가-힣]{2,4})"
NAME_BEFORE_ROLE = (
    f"(?<![{WORD}])([가-힣]{{2,4}})\\s+(?:특급|고급|중급|초급)?\\s*(?:PM|PL|TA|AA|DA|DBA|개발|컨설턴트)(?![{WORD}])"
)
LABELS = {
    "subject": "주제", "checked_items": "확인 항목", "document": "문서명", "page": "페이지", "chapter": "챕터",
    "evidence": "근거 문장", "confidence": "신뢰도", "name": "성명", "grade": "등급", "role": "역할",
    "matched_conditions": "조건 매칭 근거", "client_project": "발주기관/사업명", "project_kind": "사업성격",
    "related_work": "관련 업무", "cost_item": "비용 항목", "quantity": "수량", "unit_price": "단가", "amount": "금액",
    "technology": "기술/키워드", "trend": "동향/시사점", "project": "프로젝트명", "client": "고객기관",
    "area": "문서영역", "raw_path": "원본경로", "matched": "매칭 키워드", "points": "점수",
}
EVIDENCE_HAYSTACK = ("document_title", "chapter_title", "section_title", "heading_path", "matched_text")
STAFF_HAYSTACK = ("project_name", "client_name") + EVIDENCE_HAYSTACK
EXPANDED_HAYSTACK = (
    "document_title", "project_name", "client_name", "canonical_heading_path", "heading_path", "domain_keywords",
    "matched_text", "parent_context",
)


def _known(value: Column) -> Column:
    return first_filled(value, F.lit(UNKNOWN))


def _hay(columns: list[str], wanted: tuple[str, ...]) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in wanted if c in columns]))


def _found(words: Column, hay: Column) -> Column:
    return F.filter(words, lambda w: F.contains(hay, F.lower(w)))


def _listed(words: Column, limit: int) -> Column:
    return F.concat_ws(", ", F.slice(words, 1, limit))


def _two_digits(score: Column) -> Column:
    return F.format_string("%.2f", F.least(score, F.lit(0.95)))


def _has(value: Column, points: float) -> Column:
    return F.when(value != "", points).otherwise(0.0)


def with_sentence(results: DataFrame) -> DataFrame:
    """The columns all extractors share."""
    columns = results.columns
    chapter = F.col("chapter_title") if "chapter_title" in columns else F.lit("")
    pages = [c for c in ("display_page", "page_no") if c in columns]
    return results.withColumns({
        "sentence": evidence_sentence("matched_text"),
        "document": _known(F.col("document_title")),
        "page": first_filled(*[F.col(c).cast("string") for c in pages], F.lit(UNKNOWN)),
        "chapter": _known(chapter),
    })


def evidence_rows(results: DataFrame) -> DataFrame:
    """Topic, matched keywords, sentence, confidence."""
    rows = with_sentence(results).withColumn("evidence_hay", _hay(results.columns, EVIDENCE_HAYSTACK))
    rows = rows.withColumn("found", _found(F.col("expanded_keywords"), F.col("evidence_hay")))
    score = 0.35 + _has(F.col("sentence"), 0.25) + F.least(F.size("found"), F.lit(4)) * 0.08
    return rows.withColumns({
        "subject": _known(F.col("topic")), "checked_items": _known(_listed(F.col("found"), 6)),
        "evidence": _known(F.col("sentence")), "confidence": _two_digits(score),
    }).drop("evidence_hay", "found", "sentence")


def _condition(name: str) -> Column:
    return F.coalesce(F.try_element_at("conditions", F.lit(name)), F.lit(""))


def _condition_in(name: str, text: Column) -> Column:
    value = _condition(name)
    return F.when((value != "") & F.contains(text, F.lower(value)), value).otherwise(F.lit(""))


def staff_rows(results: DataFrame) -> DataFrame:
    """Person, grade, role and conditions as far as the sentence states them; nothing is invented."""
    rows = with_sentence(results).withColumns({"low": F.lower("sentence"), "staff_hay": _hay(results.columns, STAFF_HAYSTACK)})
    low, hay = F.col("low"), F.col("staff_hay")
    rows = rows.withColumns({
        "role_found": first_filled(first_contained(low, ROLE_TERMS), _condition_in("role", low)),
        "grade_found": first_filled(first_contained(low, GRADE_TERMS), _condition_in("grade", low)),
        "kind_found": first_filled(first_contained(low, PROJECT_TERMS), _condition_in("project_type", low)),
        "met": _found(F.filter(F.map_values("conditions"), lambda v: v != ""), hay),
        "work": first_filled(_condition_in("business_domain", hay), _condition_in("business_content", hay)),
    })
    score = (
        0.35 + _has(F.col("sentence"), 0.2) + F.least(F.size("met"), F.lit(3)) * 0.1
        + _has(F.col("role_found"), 0.1) + _has(F.col("grade_found"), 0.05)
    )
    owners = [F.nullif(text_or_empty(c), F.lit("")) for c in ("client_name", "project_name") if c in results.columns]
    return rows.withColumns({
        "name": first_filled(
            F.regexp_extract("sentence", NAME_LABEL, 1), F.regexp_extract("sentence", NAME_BEFORE_ROLE, 1), F.lit(UNKNOWN)
        ),
        "grade": _known(F.col("grade_found")), "role": _known(F.col("role_found")),
        "matched_conditions": _known(F.concat_ws(", ", "met")), "client_project": _known(F.concat_ws(" / ", *owners)),
        "project_kind": _known(F.col("kind_found")), "related_work": _known(F.col("work")),
        "evidence": _known(F.col("sentence")), "confidence": _two_digits(score),
    }).drop("low", "staff_hay", "role_found", "grade_found", "kind_found", "met", "work", "sentence")


def cost_rows(results: DataFrame) -> DataFrame:
    """Cost item, quantity, unit price and amount."""
    rows = with_sentence(results).withColumn("low", F.lower("sentence")).withColumns({
        "amount_found": F.regexp_extract("sentence", L.AMOUNT, 0), "quantity_found": F.regexp_extract("sentence", L.QUANTITY, 0),
        "price_found": F.regexp_extract("sentence", L.UNIT_PRICE, 0),
    })
    item = F.get(_found(F.col("expanded_keywords"), F.col("low")), F.lit(0))
    score = (
        0.2 + _has(F.col("sentence"), 0.2) + _has(F.col("amount_found"), 0.25) + _has(F.col("quantity_found"), 0.15)
        + _has(F.col("price_found"), 0.15)
    )
    return rows.withColumns({
        "cost_item": _known(item), "quantity": _known(F.col("quantity_found")), "unit_price": _known(F.col("price_found")),
        "amount": _known(F.col("amount_found")), "evidence": _known(F.col("sentence")), "confidence": _two_digits(score),
    }).drop("low", "amount_found", "quantity_found", "price_found", "sentence")


def technology_rows(results: DataFrame) -> DataFrame:
    """Technology keywords and the trend sentence."""
    rows = with_sentence(results).withColumn("low", F.lower("sentence"))
    rows = rows.withColumns({
        "found": _found(F.col("expanded_keywords"), F.col("low")), "is_trend": contains_any(F.col("sentence"), TREND_TERMS),
    })
    score = (
        0.35 + _has(F.col("sentence"), 0.25) + F.least(F.size("found"), F.lit(4)) * 0.08
        + F.when(F.col("is_trend"), 0.1).otherwise(0.0)
    )
    return rows.withColumns({
        "technology": first_filled(_listed(F.col("found"), 5), F.col("topic"), F.lit(UNKNOWN)),
        "trend": F.when(F.col("is_trend"), F.col("sentence")).otherwise(F.lit(UNKNOWN)),
        "evidence": _known(F.col("sentence")), "confidence": _two_digits(score),
    }).drop("low", "found", "is_trend", "sentence")


EXTRACTORS = {
    "staff_table": (staff_rows, ("name", "grade", "role", "matched_conditions", "client_project", "project_kind", "related_work")),
    "cost_table": (cost_rows, ("cost_item", "quantity", "unit_price", "amount")),
    "technology_table": (technology_rows, ("technology", "trend")),
    "evidence_table": (evidence_rows, ("subject", "checked_items")),
}
SHARED = ("document", "page", "chapter", "evidence", "confidence")


def structured_rows(results: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """E5: each result through the extractor of its query's output type.

    The columns of the four tables differ, so the fields travel as a map next to the
    common columns.
    """
    columns = results.columns
    hay = _hay(columns, EXPANDED_HAYSTACK)
    matched = F.col("matched_keywords") if "matched_keywords" in columns else F.array().cast("array<string>")
    for name in ("canonical_heading_path", "heading_path", "canonical_chapter_title", "chapter_title", "section_title"):
        if name not in columns:
            results = results.withColumn(name, F.lit(""))
    common = results.withColumns({
        "area": document_area(),
        "matched": first_filled(
            F.concat_ws(", ", F.when(F.size(matched) > 0, matched).otherwise(bind(hay, lambda h: _found(F.col("expanded_keywords"), h)))),
            F.lit(UNKNOWN),
        ),
        "points": F.round("score", 4),
    })
    parts = []
    for output, (extract, fields) in EXTRACTORS.items():
        rows = extract(common.filter(F.col("output_type") == output))
        entries = F.create_map(*[x for f in fields + SHARED for x in (F.lit(LABELS[f]), F.col(f))])
        parts.append(rows.select(query, key, "output_type", entries.alias("fields"), "area", "matched", "points"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
