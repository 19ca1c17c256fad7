"""Query understanding and reranking over tables of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.lexicons.corpus import CORPUS_CHAPTERS
from dossierlake.operators import batch as B, intents as Q, keyword as KW, rerank as RR, state as ST
from dossierlake.plans import sqltext as S
from dossierlake.plans.keyword_plans import BATCH_COVERAGE_SQL, benchmark_queries, doc_haystack, searchable
from dossierlake.plans.registry import register
from dossierlake.sources.tables import table

# Groups of corpus words that make every branch of query understanding fire on the corpus.
CORPUS_INTENTS = Q.IntentLexicon(
    chapters=CORPUS_CHAPTERS, topic_chapters=CORPUS_CHAPTERS,
    staff_triggers=("nicht", "der", "und", "the"), architecture=("than", "wh", "tion"), trend=("que", "eaux"),
    cost=("mente", "los", "ado"),
    bonus={"staff_experience": "methods", "architecture_evidence": "results", "technology_trend": "outlook", "cost_estimation": "context"},
    roles={"lead": ("the", "un"), "member": ("of", "le", "die")}, grades={"senior": ("and", "la"), "junior": ("was", "des")},
    project_types={"plan": ("inth", "ouan")}, participation={"full": ("with",), "part": ("not", "avec")},
)


def user_queries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query_text"))


def _alias_hit(alias: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){alias}([^a-z0-9]|$)')"


def _longest_sql(groups, alone: bool) -> str:
    entries = [(n, a.lower()) for n, aliases in groups.items() for a in aliases]
    entries.sort(key=lambda e: -len(e[1]))
    hit = _alias_hit if alone else (lambda a: f"contains(low, {S.quote(a)})")
    return "CASE " + " ".join(f"WHEN {hit(a)} THEN {S.quote(n)}" for n, a in entries) + " ELSE '' END"


def _count_sql(terms) -> str:
    return " + ".join(f"CAST(contains(low, {S.quote(t)}) AS INT)" for t in terms)


def intents_sql(source: str) -> str:
    """CTEs from a SELECT of (query_id, query_text) to parsed(query_id, ...)."""
    lx = CORPUS_INTENTS
    bonus = lambda d: f"CASE WHEN target_chapter = {S.quote(lx.bonus[d])} THEN 3 ELSE 0 END"
    removal = " ".join(
        f"WHEN target_chapter = {S.quote(n)} THEN "
        + "regexp_replace(" * len(al) + "query_text" + "".join(f", '(?i){a}', ' ', 'g')" for a in al)
        for n, al in lx.topic_chapters.items()
    )
    return f"""
    q0 AS (SELECT query_id, {S.squeeze('query_text')} AS query_text FROM ({source})),
    q1 AS (SELECT *, lower(query_text) AS low FROM q0),
    q2 AS (SELECT *, {_longest_sql(lx.chapters, False)} AS target_chapter FROM q1),
    q3 AS (SELECT *,
        {' + '.join(f'CAST({_alias_hit(t)} AS INT)' for t in lx.staff_triggers)} + {bonus('staff_experience')} AS s1,
        {_count_sql(lx.architecture)} + {bonus('architecture_evidence')} AS s2,
        {_count_sql(lx.trend)} + {bonus('technology_trend')} AS s3,
        {_count_sql(lx.cost)} + {bonus('cost_estimation')} AS s4 FROM q2),
    q4 AS (SELECT *, greatest(s1, s2, s3, s4) AS best, CASE WHEN greatest(s1, s2, s3, s4) <= 0 THEN 'general'
        WHEN s1 = greatest(s1, s2, s3, s4) THEN 'staff_experience' WHEN s2 = greatest(s1, s2, s3, s4) THEN 'architecture_evidence'
        WHEN s3 = greatest(s1, s2, s3, s4) THEN 'technology_trend' ELSE 'cost_estimation' END AS search_domain FROM q3),
    q5 AS (SELECT *, CASE WHEN search_domain = 'staff_experience' THEN list_filter([
          {{'k': 'role', 'v': {_longest_sql(lx.roles, True)}}}, {{'k': 'grade', 'v': {_longest_sql(lx.grades, True)}}},
          {{'k': 'project_type', 'v': {_longest_sql(lx.project_types, True)}}}, {{'k': 'participation_type', 'v': {_longest_sql(lx.participation, True)}}}],
          lambda e: e.v <> '') ELSE [] END AS conds,
        {S.squeeze(f"CASE {removal} ELSE query_text END")} AS plain FROM q4),
    q6 AS (SELECT *, list_filter(conds, lambda e: e.k = 'project_type') || list_filter(conds, lambda e: e.k = 'role')
          || list_filter(conds, lambda e: e.k = 'grade') AS tp FROM q5),
    q7 AS (SELECT *, CASE WHEN len(tp) > 0 THEN array_to_string(list_transform(tp, lambda e: e.v), ' ') ELSE plain END AS topic,
        CASE search_domain WHEN 'staff_experience' THEN greatest(s2, s3, s4) WHEN 'architecture_evidence' THEN greatest(s1, s3, s4)
          WHEN 'technology_trend' THEN greatest(s1, s2, s4) ELSE greatest(s1, s2, s3) END AS rival FROM q6),
    parsed AS MATERIALIZED (SELECT *, CASE search_domain WHEN 'staff_experience' THEN 'staff_table' WHEN 'technology_trend' THEN 'technology_table'
          WHEN 'cost_estimation' THEN 'cost_table' ELSE 'evidence_table' END AS output_type,
        CASE WHEN search_domain = 'general' THEN CASE WHEN target_chapter <> '' THEN 0.45::DOUBLE ELSE 0.35::DOUBLE END
          ELSE round(greatest(0.0::DOUBLE, least(0.45::DOUBLE + least(best, 4) * 0.08::DOUBLE
            + CASE WHEN target_chapter <> '' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + least(len(conds), 5) * 0.04::DOUBLE
            - CASE WHEN best - rival <= 0 THEN 0.12::DOUBLE WHEN best - rival = 1 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END, 0.95::DOUBLE)), 2) END AS confidence
        FROM q7)"""


_SUBJECT_SQL = ", ".join(
    "CASE WHEN "
    + " OR ".join([f"contains(lower(tt), {S.quote(t)})" for t in latin] + [f"contains(tt, {S.quote(t)})" for t in korean])
    + f" THEN {S.str_list(words)} ELSE [] END" for latin, korean, words in Q.SUBJECT_KEYWORDS
)


def expansion_sql() -> str:
    """CTEs from parsed to expanded(query_id, ..., kw, semantic_query)."""
    from dossierlake.lexicons import fixed_values as V

    return f"""
    x0 AS (SELECT *, coalesce(nullif(topic, ''), query_text) AS tt FROM parsed),
    x1 AS (SELECT *, flatten([{_SUBJECT_SQL}]) AS subj,
        list_filter(conds, lambda e: e.k = 'project_type') || list_filter(conds, lambda e: e.k = 'role')
          || list_filter(conds, lambda e: e.k = 'grade') || list_filter(conds, lambda e: e.k = 'participation_type') AS ce FROM x0),
    x2 AS (SELECT *, list_concat(string_split_regex(tt, '[ ,/|()\\[\\]{{}}]'), CASE search_domain
        WHEN 'staff_experience' THEN list_concat({S.str_list(V.COMMON_STAFF_TERMS)}, list_transform(ce, lambda e: e.v))
        WHEN 'architecture_evidence' THEN list_concat({S.str_list(Q.ARCHITECTURE_BASE)}, subj)
        WHEN 'cost_estimation' THEN {S.str_list(Q.COST_BASE + V.CLOUD_COST_KEYWORDS)}
        WHEN 'technology_trend' THEN list_concat({S.str_list(Q.TREND_BASE)}, subj) ELSE subj END) AS ws FROM x1),
    x3 AS (SELECT *, list_filter(ws, lambda w: length(trim(w)) >= 2 AND NOT list_contains({S.str_list(Q.UTILITY_STOPWORDS)}, lower(trim(w)))) AS fw FROM x2),
    x4 AS (SELECT *, {S.ordered_distinct('fw')} AS kw FROM x3),
    x5 AS (SELECT *, list_filter(list_concat([tt, target_chapter], kw), lambda v: v <> '') AS sv FROM x4),
    expanded AS MATERIALIZED (SELECT *, array_to_string({S.ordered_distinct('sv')}, ' ') AS semantic_query FROM x5)"""


_USER_SQL = "SELECT conv_id * 1000 + turn AS query_id, text AS query_text FROM conversations WHERE role = 'user'"
_CONDS = "array_to_string(list_transform(conds, lambda e: e.k || '=' || e.v), ';')"


def conditions_text():
    entries = F.map_entries("conditions")
    return F.concat_ws(";", F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])))


@register(
    "query_intent_scores",
    f"""WITH {intents_sql(_USER_SQL)}
    SELECT query_id, target_chapter, search_domain, output_type, confidence, topic, {_CONDS} AS conditions,
      CAST(s1 AS BIGINT) AS staff, CAST(s2 AS BIGINT) AS architecture, CAST(s3 AS BIGINT) AS trend, CAST(s4 AS BIGINT) AS cost FROM parsed""",
    covers="Q2-Q8, Q12",
)
def query_intent_scores(spark, sf_dir):
    parsed = Q.parse_queries(user_queries(spark, sf_dir), CORPUS_INTENTS, taxonomy=False)
    return parsed.select(
        "query_id", "target_chapter", "search_domain", "output_type", "confidence", "topic",
        conditions_text().alias("conditions"),
        F.col("score_staff_experience").cast("bigint").alias("staff"),
        F.col("score_architecture_evidence").cast("bigint").alias("architecture"),
        F.col("score_technology_trend").cast("bigint").alias("trend"),
        F.col("score_cost_estimation").cast("bigint").alias("cost"),
    )


@register(
    "query_expansion",
    f"""WITH {intents_sql(_USER_SQL)}, {expansion_sql()}
    SELECT query_id, array_to_string(kw, '|') AS expanded_keywords, semantic_query FROM expanded""",
    covers="Q10, U5",
)
def query_expansion(spark, sf_dir):
    parsed = Q.parse_queries(user_queries(spark, sf_dir), CORPUS_INTENTS, taxonomy=False)
    return Q.expand_queries(parsed).select(
        "query_id", F.concat_ws("|", "expanded_keywords").alias("expanded_keywords"), "semantic_query"
    )


@register(
    "saved_search_rows",
    f"""WITH {intents_sql(_USER_SQL)}, {expansion_sql()}
    SELECT 'ss_' || substr(sha1('saved:' || query_text || ':2024-01-01 00:00:00'), 1, 16) AS saved_search_id, query_text, e.search_domain, e.target_chapter, e.topic,
      e.confidence, len(conds) AS conditions, array_to_string(kw, '|') AS keywords, CAST(query_id % 100 AS BIGINT) AS result_count FROM expanded e""",
    covers="K6, X24: parsed queries as JSON, read back",
)
def saved_search_rows(spark, sf_dir):
    """Each user turn saved as a search; the JSON is read again, so every field has survived it."""
    parsed = Q.expand_queries(Q.parse_queries(user_queries(spark, sf_dir), CORPUS_INTENTS, taxonomy=False))
    saved = ST.saved_searches(parsed.withColumn("result_count", F.col("query_id") % 100), F.lit("2024-01-01 00:00:00"))
    kind = "struct<search_domain:string,target_chapter:string,topic:string,conditions:map<string,string>,expanded_keywords:array<string>,confidence:double>"
    read = saved.withColumn("read", F.from_json("parsed_query_json", kind))
    return read.select(
        "saved_search_id", "query_text", "read.search_domain", "read.target_chapter", "read.topic", "read.confidence",
        F.size("read.conditions").cast("bigint").alias("conditions"), F.concat_ws("|", "read.expanded_keywords").alias("keywords"),
        F.col("result_count").cast("bigint").alias("result_count"))


@register("query_intent_korean_lexicon", covers="Q2-Q10 with the fuzzy section match, which has no SQL form")
def query_intent_korean_lexicon(spark, sf_dir):
    expanded = Q.expand_queries(Q.parse_queries(user_queries(spark, sf_dir)))
    return expanded.select(
        "query_id", "search_domain", "target_chapter", "target_section", "target_subsection", "confidence", "semantic_query"
    )


@register(
    "chapter_query_split",
    f"""WITH q AS (SELECT query_id, {S.squeeze('query_text')} AS t FROM
        (SELECT conv_id * 1000 + turn AS query_id,
           CASE turn % 3 WHEN 0 THEN '목표 모델에서 ' || text || '를 찾아줘' WHEN 1 THEN '관련 내용 중 ' || text ELSE 'Roadmap 챕터에서 ' || text END AS query_text FROM conversations)),
    r AS (SELECT *, starts_with(t, '목표 모델에서 ') AS a, starts_with(t, 'Roadmap 챕터에서 ') AS b FROM q),
    s AS (SELECT *, CASE WHEN a THEN substr(t, length('목표 모델에서 ') + 1) WHEN b THEN substr(t, length('Roadmap 챕터에서 ') + 1) ELSE t END AS rest FROM r),
    u AS (SELECT *, {S.squeeze(f"regexp_replace(regexp_replace(rest, {S.quote(Q.COMMAND_SUFFIX)}, ''), {S.quote(Q.TOPIC_PREFIX)}, '')")} AS topic FROM s)
    SELECT query_id, CASE WHEN a THEN '목표모델' WHEN b THEN '이행계획' ELSE '' END AS chapter_filter, coalesce(nullif(topic, ''), t) AS semantic_query FROM u""",
    covers="Q1",
)
def chapter_query_split(spark, sf_dir):
    text = F.col("text")
    wrapped = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("목표 모델에서 "), text, F.lit("를 찾아줘")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("관련 내용 중 "), text))
        .otherwise(F.concat(F.lit("Roadmap 챕터에서 "), text))
    )
    queries = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), wrapped.alias("query_text")
    )
    return Q.split_chapter_query(queries).select("query_id", "chapter_filter", "semantic_query")


_BENCH_SQL = "SELECT item_id AS query_id, text AS query_text FROM benchmark"
_HAY = "lower(concat_ws(' ', project_name, document_title, document_type, file_path, snip))"
_ABOUT = "lower(concat_ws(' ', document_title, file_path))"


def _matches(hay: str, domain: str) -> str:
    patterns = RR.STRUCTURE_PATTERNS[domain]
    hits = " + ".join(f"CAST(regexp_matches({hay}, {S.quote(p)}) AS INT)" for p in patterns)
    return f"WHEN {S.quote(domain)} THEN least(1.0::DOUBLE, CAST({hits} AS DOUBLE) / {len(patterns)})"


def _weights_sql() -> str:
    names = ("kf", "vf", "cf", "xf", "df", "sf", "qf")
    return "CASE search_domain " + " ".join(
        f"WHEN {S.quote(d)} THEN (" + " + ".join(f"{n} * {w}::DOUBLE" for n, w in zip(names, ws)) + ")"
        for d, ws in RR.WEIGHTS.items()
    ) + " END"


def _share_sql(terms: str) -> str:
    return (
        f"CASE WHEN len({terms}) = 0 THEN 0.5::DOUBLE ELSE CAST(len(list_filter({terms}, "
        f"lambda t: contains(hay, trim(lower(t))))) AS DOUBLE) / len({terms}) END"
    )


RERANK_SQL = f"""{S.DOCS}, {BATCH_COVERAGE_SQL}, {intents_sql(_BENCH_SQL)}, {expansion_sql()},
cand AS MATERIALIZED (SELECT query_id, doc_id, round(CAST(hits AS DOUBLE) / n, 6) AS keyword_score FROM allhits WHERE hits > 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(hits AS DOUBLE) / n, 6) DESC, doc_id) <= 40),
rs AS MATERIALIZED (SELECT cand.*, docs.document_title, docs.file_path, docs.document_type, docs.project_name, {S.snippet('text')} AS snip
    FROM cand JOIN docs USING (doc_id)),
fx AS (SELECT rs.*, e.* EXCLUDE (query_id), {_HAY} AS hay, {_ABOUT} AS about FROM rs JOIN expanded e USING (query_id)),
fy AS (SELECT *, keyword_score AS kf, 0.0::DOUBLE AS vf,
    CASE WHEN target_chapter = '' THEN 0.5::DOUBLE WHEN contains(replace(hay, ' ', ''), lower(target_chapter)) THEN 1.0::DOUBLE
      WHEN search_domain = 'staff_experience' AND {S.contains_any('hay', RR.STAFF_CHAPTER_TERMS)} THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END AS cf,
    CASE WHEN len(conds) > 0 THEN {_share_sql('list_transform(conds, lambda e: e.v)')}
      ELSE {_share_sql("list_filter(string_split_regex(topic, '\\s+'), lambda t: length(t) >= 2)")} END AS xf,
    {_share_sql('list_filter(kw, lambda t: length(t) >= 2)')} AS df,
    CASE search_domain {' '.join(_matches('hay', d) for d in RR.STRUCTURE_PATTERNS)} END AS sf,
    least(1.0::DOUBLE, 0.45::DOUBLE + CASE WHEN target_chapter <> '' AND contains(replace(about, ' ', ''), lower(target_chapter)) THEN 0.25::DOUBLE ELSE 0 END
      + CASE WHEN {' OR '.join(f"(search_domain = {S.quote(d)} AND {S.contains_any('about', t)})" for d, t in RR.QUALITY_TERMS.items())} THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN {S.contains_any('about', RR.FINISHED_TERMS)} THEN 0.1::DOUBLE ELSE 0 END) AS qf FROM fx),
fz AS (SELECT *, round({_weights_sql()}, 6) AS final_score FROM fy),
reranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank FROM fz
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) <= 10)"""


def benchmark_results(spark, sf_dir):
    """Keyword candidates of every benchmark query with the parsed query next to each."""
    from dossierlake.functions.text import trim_snippet

    queries = benchmark_queries(spark, sf_dir)
    rows = searchable(spark, sf_dir)
    top = B.coverage_top(rows, "doc_id", doc_haystack(), queries, 40).select("query_id", "doc_id", "keyword_score")
    parsed = Q.expand_queries(Q.parse_queries(queries, CORPUS_INTENTS, taxonomy=False))
    described = rows.select(
        "doc_id", "document_id", "project_id", "document_title", "file_path", "document_type", "project_name",
        trim_snippet("chunk_text").alias("matched_text"),
    )
    return top.join(described, "doc_id").join(parsed, "query_id").withColumn("vector_score", F.lit(0.0))


@register(
    "rerank_scores",
    f"""WITH {RERANK_SQL}
    SELECT query_id, doc_id, final_score, CAST(rank AS BIGINT) AS rank, round(kf, 6) AS keyword_feature, round(vf, 6) AS vector_feature,
      round(cf, 6) AS chapter_feature, round(xf, 6) AS condition_feature, round(df, 6) AS domain_feature, round(sf, 6) AS structure_feature,
      round(qf, 6) AS quality_feature FROM reranked""",
    covers="R10-R14",
)
def rerank_scores(spark, sf_dir):
    ranked = RR.rerank(benchmark_results(spark, sf_dir), "doc_id", 10)
    return ranked.select("query_id", "doc_id", "final_score", F.col("rank").cast("bigint").alias("rank"), *RR.FEATURES)


@register(
    "label_quality_at_k",
    f"""WITH {RERANK_SQL}
    SELECT query_id, CAST(count(*) AS BIGINT) AS judged, CAST(sum(quality) AS BIGINT) AS good, round(sum(final_score), 6) AS total_score
    FROM reranked JOIN labels USING (doc_id) GROUP BY query_id""",
    covers="E7",
)
def label_quality_at_k(spark, sf_dir):
    ranked = RR.rerank(benchmark_results(spark, sf_dir), "doc_id", 10)
    judged = ranked.join(table(spark, sf_dir, "labels"), "doc_id")
    return judged.groupBy("query_id").agg(
        F.count("*").cast("bigint").alias("judged"), F.sum("quality").cast("bigint").alias("good"),
        F.round(F.sum("final_score"), 6).alias("total_score"),
    )
