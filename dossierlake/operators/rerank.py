"""Intent-aware reranking of search results: seven features, weights per domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.text import bind, contains_any, text_or_empty
from dossierlake.operators.keyword import SCORE_DIGITS, top_rows_per

# Feature weights per domain, patterns and quality terms.
FEATURES = (
    "keyword_feature", "vector_feature", "chapter_feature", "condition_feature", "domain_feature", "structure_feature",
    "quality_feature",
)
WEIGHTS = {
    "staff_experience": (0.20, 0.10, 0.25, 0.20, 0.00, 0.20, 0.05),
    "architecture_evidence": (0.20, 0.15, 0.25, 0.10, 0.15, 0.10, 0.05),
    "technology_trend": (0.20, 0.15, 0.25, 0.05, 0.20, 0.10, 0.05),
    "cost_estimation": (0.20, 0.10, 0.15, 0.15, 0.20, 0.15, 0.05),
    "general": (0.25, 0.25, 0.10, 0.10, 0.20, 0.05, 0.05),
}
STRUCTURE_PATTERNS = {
    "staff_experience": (
        "(?i)[가-힣]{2,4}\\s*(?:PM|PL|TA|AA|DA|DBA|개발|컨설턴트)",
        "(?:특급|고급|중급|초급)",
        "(?:성명|이름|역할|등급|주요경력|참여사업|수행경험|투입인력|참여인력)",
    ),
    "cost_estimation": ("(?:원|천원|백만원|억원|비용|단가|수량|금액|라이선스|사용량)", "\\d[\\d,]*(?:\\.\\d+)?"),
    "technology_trend": ("(?:동향|트렌드|최신기술|적용사례|시사점|기술)",),
    "architecture_evidence": ("(?i)(?:목표모델|아키텍처|구성도|설계|To-Be|DR|MSA|클라우드|보안|데이터)",),
    "general": ("(?:근거|사례|방안|구성|계획)",),
}
QUALITY_TERMS = {
    "staff_experience": ("제안", "인력", "경력", "정성"),
    "cost_estimation": ("비용", "견적", "예산", "가격"),
    "technology_trend": ("동향", "기술", "trend"),
    "architecture_evidence": ("목표", "모델", "설계", "아키텍처"),
}
FINISHED_TERMS = ("최종", "final", "정성")
STAFF_CHAPTER_TERMS = ("투입인력", "참여인력", "주요경력", "경력")
HAYSTACK_COLUMNS = (
    "project_name", "client_name", "document_title", "document_type", "file_path", "chapter_title", "section_title",
    "heading_path", "canonical_chapter_title", "canonical_section_title", "canonical_subsection_title",
    "canonical_heading_path", "raw_heading_path", "table_type", "domain_keywords", "parent_context", "matched_text",
    "keywords",
)
QUALITY_COLUMNS = (
    "document_title", "file_path", "chapter_title", "heading_path", "canonical_heading_path", "domain_keywords",
)


def _joined(columns: list[str], wanted: tuple[str, ...]) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in wanted if c in columns]))


def _unspaced(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit(""))


def _share(terms: Column, hay: Column) -> Column:
    found = F.filter(terms, lambda t: (F.trim(t) != "") & F.contains(hay, F.trim(F.lower(t))))
    return F.size(found).cast("double") / F.size(terms)


def _or_half(terms: Column, hay: Column) -> Column:
    return bind(terms, lambda ts: F.when(F.size(ts) > 0, _share(ts, hay)).otherwise(F.lit(0.5)))


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def _chapter(hay: Column) -> Column:
    targets = F.filter(F.array("target_chapter", "target_section", "target_subsection"), lambda t: t != "")
    hit = F.exists(targets, lambda t: F.contains(F.replace(hay, F.lit(" "), F.lit("")), _unspaced(t)))
    staff = (F.col("search_domain") == "staff_experience") & contains_any(hay, STAFF_CHAPTER_TERMS)
    return F.when(F.size(targets) == 0, 0.5).when(hit, 1.0).when(staff, 0.85).otherwise(0.2)


def _structure(hay: Column, columns: list[str]) -> Column:
    domain = F.col("search_domain")
    score = F.lit(0.0)
    for name, patterns in STRUCTURE_PATTERNS.items():
        hits = sum((F.rlike(hay, F.lit(p)).cast("int") for p in patterns), F.lit(0))
        score = F.when(domain == name, F.least(F.lit(1.0), hits / len(patterns))).otherwise(score)
    if "table_type" not in columns:
        return score
    typed = ((domain == "staff_experience") & (F.col("table_type") == "staff")) | (
        (domain == "cost_estimation") & (F.col("table_type") == "cost")
    )
    return F.when(typed, F.lit(1.0)).otherwise(score)


def _quality(text: Column) -> Column:
    chapter = F.col("target_chapter")
    named = (chapter != "") & F.contains(F.replace(text, F.lit(" "), F.lit("")), _unspaced(chapter))
    fitting = F.lit(False)
    for name, terms in QUALITY_TERMS.items():
        fitting = fitting | ((F.col("search_domain") == name) & contains_any(text, terms))
    return _clamp(
        0.45 + F.when(named, 0.25).otherwise(0.0) + F.when(fitting, 0.2).otherwise(0.0)
        + F.when(contains_any(text, FINISHED_TERMS), 0.1).otherwise(0.0)
    )


def features(results: DataFrame) -> DataFrame:
    """R11-R14 for rows that carry a result and its parsed, expanded query."""
    columns = results.columns
    rows = results.withColumns({"hay": _joined(columns, HAYSTACK_COLUMNS), "about": _joined(columns, QUALITY_COLUMNS)})
    hay = F.col("hay")
    long_words = lambda values: F.filter(values, lambda t: F.length(t) >= 2)
    by_conditions = _or_half(F.map_values("conditions"), hay)
    by_topic = _or_half(long_words(F.split("topic", "\\s+")), hay)
    covered = F.col("keyword_coverage") if "keyword_coverage" in columns else F.lit(0.0)
    return rows.withColumns({
        "keyword_feature": _clamp(F.coalesce(F.nullif(F.col("keyword_score"), F.lit(0.0)), covered, F.lit(0.0))),
        "vector_feature": _clamp(F.coalesce("vector_score", F.lit(0.0))),
        "chapter_feature": _chapter(hay),
        "condition_feature": F.when(F.size("conditions") > 0, by_conditions).otherwise(by_topic),
        "domain_feature": _or_half(long_words(F.col("expanded_keywords")), hay),
        "structure_feature": _structure(hay, columns),
        "quality_feature": _quality(F.col("about")),
    }).drop("hay", "about")


def rerank(results: DataFrame, key: str, k: int, query: str = "query_id") -> DataFrame:
    """Weighted sum of the features, best k per query."""
    scored = features(results)
    total = F.lit(0.0)
    for name, weights in WEIGHTS.items():
        own = sum((F.col(f) * w for f, w in zip(FEATURES, weights)), F.lit(0.0)) / sum(weights)
        total = F.when(F.col("search_domain") == name, own).otherwise(total)
    rounded = scored.withColumn("final_score", F.round(total, SCORE_DIGITS)).withColumns(
        {f: F.round(f, SCORE_DIGITS) for f in FEATURES}
    )
    ranked = rounded.drop("rank") if "rank" in rounded.columns else rounded
    return top_rows_per(ranked, query, "final_score", key, k)
