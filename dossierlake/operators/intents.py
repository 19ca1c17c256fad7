"""Query understanding for a table of queries: chapter, domain, conditions, topic, expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.headings import canonical_chapter
from dossierlake.functions.labels import EXPERIENCE_YEARS
from dossierlake.functions.text import contains_any, count_contained, first_filled, literal_array, squeeze
from dossierlake.functions.tokens import WORD
from dossierlake.lexicons import fixed_values as V
from dossierlake.operators import taxonomy as TX

# Domains in tie order, their trigger terms, base keywords and word lists.
DOMAINS = ("staff_experience", "architecture_evidence", "technology_trend", "cost_estimation")
GENERAL = "general"
CHAPTER_BONUS = 3
OUTPUT_TYPES = {
    "staff_experience": "staff_table", "architecture_evidence": "evidence_table",
    "technology_trend": "technology_table", "cost_estimation": "cost_table", GENERAL: "evidence_table",
}
ARCHITECTURE_TERMS = ("목표모델", "목표 모델", "목표 아키텍처", "to-be", "tobe", "설계", "구성도")
TREND_TERMS = ("정보기술동향", "기술동향", "최신기술", "최신 기술", "트렌드", "technology trend")
COST_TERMS = ("비용", "비용산정", "비용 산정", "tco", "견적", "단가", "수량", "소요예산", "예산")
BONUS_CHAPTERS = {
    "staff_experience": "투입인력", "architecture_evidence": "목표모델",
    "technology_trend": "정보기술동향", "cost_estimation": "비용산정",
}
ARCHITECTURE_BASE = ("목표모델", "목표 아키텍처", "To-Be", "설계", "구성도", "아키텍처")
COST_BASE = ("비용산정", "TCO", "단가", "수량", "금액", "구축비", "운영비", "라이선스", "사용량")
TREND_BASE = ("기술동향", "최신기술", "트렌드", "적용사례", "시사점")
UTILITY_STOPWORDS = (
    "근거", "사례", "산출물", "문서", "페이지", "관련", "내용", "찾아줘", "찾아", "검색", "보여줘", "알려줘",
)
SUBJECT_KEYWORDS = (
    (("dr",), ("재해", "복구"), V.DR_KEYWORDS),
    (("msa",), ("마이크로",), V.MSA_KEYWORDS),
    ((), ("클라우드",), ("클라우드", "Cloud", "전환", "마이그레이션", "인프라")),
    ((), ("보안",), ("보안", "인증", "권한", "암호화", "접근통제")),
    ((), ("데이터",), ("데이터", "표준화", "품질", "거버넌스", "이관")),
    (("ai",), ("인공지능",), ("AI", "인공지능", "모델", "서비스", "학습")),
)
TOPIC_NOISE = f"(?<![{WORD}])(?:에서|의|관련|내용|산출물|찾아줘|찾아|검색|보여줘|알려줘)(?![{WORD}])"
TOPIC_PARTICLES = ("에서", "관련", "찾아줘")
BUSINESS_PATTERNS = (
    "([가-힣A-Za-z0-9·&()._\\-\\s]+?업무)\\s*경력",
    "([가-힣A-Za-z0-9·&()._\\-\\s]+?)\\s*(?:사업|서비스|시스템|플랫폼)?\\s*(?:수행\\s*)?경험",
    "([가-힣A-Za-z0-9·&()._\\-\\s]+?)\\s*(?:관련|기반)?\\s*인력",
)
BUSINESS_NOISE = (
    "투입인력", "투입 인력", "투입", "참여인력", "참여 인력", "에서", "있는", "인력", "명단", "찾아줘", "찾아", "관련",
    "기반", "사업", "경험", "경력", "수행",
)
BUSINESS_DOMAINS = ("공공기관", "클라우드", "데이터", "AI", "인공지능", "보안", "재해복구", "DR", "금융", "의료")
CLIENT_PREFIX = "^(?:발주기관|고객기관|고객|기관)\\s*"
CLIENT_CHARS = "[가-힣A-Za-z0-9·&()._-]{2,}"
COMMAND_SUFFIX = "\\s*(?:을|를)?\\s*(?:찾아줘|찾아|검색해줘|검색|알려줘|보여줘)\\s*$"
TOPIC_PREFIX = "^\\s*(?:관련\\s*)?(?:내용|문서|산출물)\\s*(?:중|에서|에\\s*관한)?\\s*"
CHAPTER_LINKS = "\\s*(?:챕터|장|절)?\\s*(?:에서|내에서|부분에서|중)\\s*"
STAFF_EXPANSION_KEYS = (
    "client", "business_domain", "business_content", "project_type", "role", "grade", "participation_type",
    "experience_years",
)
STAFF_TOPIC_KEYS = ("client", "business_content", "business_domain", "project_type", "role", "grade")

Groups = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class IntentLexicon:
    """The word groups query understanding reads; the default is the Korean set."""

    chapters: Groups = field(default_factory=lambda: {**V.CHAPTER_ALIASES, **V.CANONICAL_CHAPTER_ALIASES})
    topic_chapters: Groups = field(default_factory=lambda: V.CHAPTER_ALIASES)
    staff_triggers: Sequence[str] = V.STAFF_QUERY_TRIGGERS
    architecture: Sequence[str] = ARCHITECTURE_TERMS
    trend: Sequence[str] = TREND_TERMS
    cost: Sequence[str] = COST_TERMS
    bonus: Mapping[str, str] = field(default_factory=lambda: BONUS_CHAPTERS)
    roles: Groups = field(default_factory=lambda: V.ROLE_ALIASES)
    grades: Groups = field(default_factory=lambda: V.GRADE_ALIASES)
    project_types: Groups = field(default_factory=lambda: V.PROJECT_TYPE_ALIASES)
    participation: Groups = field(default_factory=lambda: V.PARTICIPATION_ALIASES)


KOREAN_INTENTS = IntentLexicon()


def _has_alias(low: Column, alias: str) -> Column:
    """A Latin alias must stand alone; any other alias may be part of a word."""
    if re.fullmatch(r"[a-z0-9]+", alias):
        return F.rlike(low, F.lit(f"(^|[^a-z0-9]){alias}([^a-z0-9]|$)"))
    return F.contains(low, F.lit(alias))


def longest_alias(low: Column, groups: Groups, alone: bool) -> Column:
    """Q3: the group whose longest alias occurs; equally long aliases in lexicon order."""
    entries = [(name, alias.lower()) for name, aliases in groups.items() for alias in aliases if alias]
    entries.sort(key=lambda e: -len(e[1]))
    choice = None
    for name, alias in entries:
        hit = _has_alias(low, alias) if alone else F.contains(low, F.lit(alias))
        choice = F.when(hit, F.lit(name)) if choice is None else choice.when(hit, F.lit(name))
    return choice.otherwise(F.lit(""))


def _longest(values: Column) -> Column:
    ranked = F.transform(values, lambda v, i: F.struct(F.length(v).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.coalesce(F.array_max(ranked)["v"], F.lit(""))


def extract_client(query: Column) -> Column:
    suffixes = "|".join(sorted(V.ORGANIZATION_SUFFIXES, key=len, reverse=True))
    found = F.regexp_extract_all(query, F.lit(f"{CLIENT_CHARS}(?:{suffixes})"), F.lit(0))
    cleaned = F.transform(found, lambda m: F.trim(F.regexp_replace(m, CLIENT_PREFIX, "")))
    return _longest(F.filter(cleaned, lambda m: (m != "") & ~F.endswith(m, F.lit("업무"))))


def _business_phrase(query: Column, known: Sequence[str]) -> Column:
    def cleaned(pattern: str) -> Column:
        phrase = squeeze(F.regexp_extract(query, pattern, 1))
        for name in known:
            phrase = F.replace(phrase, F.col(name), F.lit(" "))  # an empty search string changes nothing
        for word in BUSINESS_NOISE:
            phrase = F.replace(phrase, F.lit(word), F.lit(" "))
        return F.regexp_replace(squeeze(phrase), "^[ ,]+|[ ,]+$", "")

    return first_filled(*[cleaned(p) for p in BUSINESS_PATTERNS])


def _business_domain(phrase: Column) -> Column:
    low = F.lower(phrase)
    terms = F.filter(literal_array(BUSINESS_DOMAINS), lambda t: F.contains(low, F.lower(t)))
    return F.when(F.endswith(phrase, F.lit("업무")), phrase).otherwise(
        first_filled(F.concat_ws(" ", terms), phrase)
    )


def clean_topic(query: Column, chapter: Column, groups: Groups) -> Column:
    """Q7: the query without the names of its chapter and without request words."""
    topic = query
    for name, aliases in groups.items():
        bare = query
        for alias in aliases:
            bare = F.regexp_replace(bare, f"(?i){re.escape(alias)}", " ")
        topic = F.when(chapter == name, bare).otherwise(topic)
    topic = F.when((chapter != "") & ~chapter.isin(*groups), F.replace(query, chapter, F.lit(" "))).otherwise(topic)
    topic = F.regexp_replace(topic, TOPIC_NOISE, " ")
    for word in TOPIC_PARTICLES:
        topic = F.replace(topic, F.lit(word), F.lit(" "))
    return squeeze(topic)


def _staff_topic(conditions: Column) -> Column:
    values = F.filter(
        F.transform(literal_array(STAFF_TOPIC_KEYS), lambda k: F.coalesce(F.try_element_at(conditions, k), F.lit(""))),
        lambda v: v != "",
    )
    parts = F.aggregate(
        values, F.array().cast("array<string>"),
        lambda acc, v: F.when(F.exists(acc, lambda p: F.contains(p, v)), acc).otherwise(F.concat(acc, F.array(v))),
    )
    return F.concat_ws(" ", parts)


def confidence(domain: Column, chapter: Column, conditions: Column) -> Column:
    """Q8: from the winning score, its margin, the chapter and the number of conditions."""
    own = F.lit(0)
    others = []
    for name in DOMAINS:
        own = F.when(domain == name, F.col(f"score_{name}")).otherwise(own)
        others.append(F.when(domain == name, F.lit(-1)).otherwise(F.col(f"score_{name}")))
    margin = own - F.greatest(*others)
    value = (
        0.45 + F.least(own, F.lit(4)) * 0.08 + F.when(chapter != "", 0.12).otherwise(0.0)
        + F.least(F.size(conditions), F.lit(5)) * 0.04
        - F.when(margin <= 0, 0.12).when(margin == 1, 0.04).otherwise(0.0)
    )
    return F.when(domain == GENERAL, F.when(chapter != "", 0.45).otherwise(0.35)).otherwise(
        F.round(F.greatest(F.lit(0.0), F.least(value, F.lit(0.95))), 2)
    )


def parse_queries(queries: DataFrame, lexicon: IntentLexicon = KOREAN_INTENTS, taxonomy: bool = True) -> DataFrame:
    """Q2-Q9 for a table (query_id, query_text)."""
    q = queries.withColumn("query_text", squeeze("query_text")).withColumn("low", F.lower("query_text"))
    low = F.col("low")
    q = q.withColumn("target_chapter", longest_alias(low, lexicon.chapters, alone=False))
    raw = {
        "staff_experience": sum((_has_alias(low, t.lower()).cast("int") for t in lexicon.staff_triggers), F.lit(0)),
        "architecture_evidence": count_contained(low, lexicon.architecture),
        "technology_trend": count_contained(low, lexicon.trend),
        "cost_estimation": count_contained(low, lexicon.cost),
    }
    q = q.withColumns({
        f"score_{name}": score
        + F.when(F.col("target_chapter") == lexicon.bonus.get(name, "-"), CHAPTER_BONUS).otherwise(0)
        for name, score in raw.items()
    })
    best = F.greatest(*[F.col(f"score_{n}") for n in DOMAINS])
    domain = F.when(best <= 0, F.lit(GENERAL))
    for name in DOMAINS:
        domain = domain.when(F.col(f"score_{name}") == best, F.lit(name))
    q = q.withColumn("search_domain", domain)

    text = F.col("query_text")
    q = q.withColumns({
        "client": extract_client(text),
        "role": longest_alias(low, lexicon.roles, alone=True),
        "grade": longest_alias(low, lexicon.grades, alone=True),
        "project_type": longest_alias(low, lexicon.project_types, alone=True),
        "participation_type": longest_alias(low, lexicon.participation, alone=True),
        "experience_years": squeeze(F.regexp_extract(text, EXPERIENCE_YEARS, 0)),
    })
    q = q.withColumn(
        "business_content",
        _business_phrase(text, ("client", "role", "grade", "participation_type", "experience_years")),
    )
    q = q.withColumn(
        "business_domain",
        F.when(F.col("business_content") == "", F.lit("")).otherwise(_business_domain(F.col("business_content"))),
    )
    names = (
        "client", "role", "grade", "project_type", "participation_type", "experience_years", "business_content",
        "business_domain",
    )
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]), lambda e: e["value"] != "")
    none = F.map_from_entries(F.filter(found, lambda e: F.lit(False)))
    q = q.withColumn(
        "conditions", F.when(F.col("search_domain") == "staff_experience", F.map_from_entries(found)).otherwise(none)
    ).drop(*names)
    plain = clean_topic(text, F.col("target_chapter"), lexicon.topic_chapters)
    q = q.withColumn(
        "topic",
        F.when(F.col("search_domain") == "staff_experience", first_filled(_staff_topic(F.col("conditions")), plain)).otherwise(plain),
    )
    output = F.create_map(*[F.lit(x) for pair in OUTPUT_TYPES.items() for x in pair])
    q = q.withColumns({
        "output_type": output[F.col("search_domain")],
        "confidence": confidence(F.col("search_domain"), F.col("target_chapter"), F.col("conditions")),
    }).drop("low")
    if not taxonomy:
        return q.withColumns({"target_section": F.lit(""), "target_subsection": F.lit("")})
    levels = TX.KOREAN_TAXONOMY
    return q.withColumns({
        "target_section": TX.best_of(levels[1], TX.QUERY_THRESHOLD)(F.array("query_text"))["canonical"],
        "target_subsection": TX.best_of(levels[2], TX.QUERY_THRESHOLD)(F.array("query_text"))["canonical"],
    })


def _is_search_word(value: Column) -> Column:
    return (F.length(F.trim(value)) >= 2) & ~F.lower(F.trim(value)).isin(*UTILITY_STOPWORDS)


def _subject_words(topic: Column) -> Column:
    low = F.lower(topic)
    none = F.array().cast("array<string>")
    parts = [
        F.when(contains_any(low, latin) | contains_any(topic, korean), literal_array(words)).otherwise(none)
        for latin, korean, words in SUBJECT_KEYWORDS
    ]
    return F.flatten(F.array(*parts))


def expand_queries(parsed: DataFrame) -> DataFrame:
    """Q10: search keywords of each query and the text that stands for it in vector search."""
    topic = first_filled("topic", "query_text")
    domain = F.col("search_domain")
    conditions = F.filter(
        F.transform(literal_array(STAFF_EXPANSION_KEYS), lambda k: F.try_element_at("conditions", k)), lambda v: v.isNotNull()
    )
    more = (
        F.when(domain == "staff_experience", F.concat(literal_array(V.COMMON_STAFF_TERMS), conditions))
        .when(domain == "architecture_evidence", F.concat(literal_array(ARCHITECTURE_BASE), _subject_words(topic)))
        .when(domain == "cost_estimation", literal_array(COST_BASE + V.CLOUD_COST_KEYWORDS))
        .when(domain == "technology_trend", F.concat(literal_array(TREND_BASE), _subject_words(topic)))
        .otherwise(_subject_words(topic))
    )
    words = F.concat(F.split(topic, "[ ,/|()\\[\\]{}]"), more)
    keywords = F.array_distinct(F.transform(F.filter(words, _is_search_word), lambda w: F.trim(w)))
    expanded = parsed.withColumn("expanded_keywords", keywords)
    values = F.concat(F.array(topic, "target_chapter", "target_section", "target_subsection"), F.col("expanded_keywords"))
    semantic = F.concat_ws(" ", F.array_distinct(F.filter(values, lambda v: v != "")))
    return expanded.withColumn("semantic_query", semantic)


def split_chapter_query(queries: DataFrame, groups: Groups = V.CHAPTER_SYNONYMS) -> DataFrame:
    """Q1: `<chapter> 에서 <topic>` -> chapter filter and topic; request words dropped."""
    phrases = sorted({p for name, aliases in groups.items() for p in (name, *aliases)}, key=lambda p: (-len(p), p))
    pattern = f"(?i)^({'|'.join(re.escape(p) for p in phrases)}){CHAPTER_LINKS}(.+)$"
    text = squeeze("query_text")
    named = F.regexp_extract(text, pattern, 1)
    rest = F.regexp_extract(text, pattern, 2)
    topic = squeeze(F.regexp_replace(F.regexp_replace(F.when(named != "", rest).otherwise(text), COMMAND_SUFFIX, ""), TOPIC_PREFIX, ""))
    return queries.withColumns({
        "chapter_filter": F.when(named == "", F.lit("")).otherwise(first_filled(canonical_chapter(named, groups), F.trim(named))),
        "semantic_query": first_filled(topic, text),
    })
