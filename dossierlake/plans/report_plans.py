"""Reports over the chunk table of the corpus, and the same forms over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import headings as HD, tables as TB
from dossierlake.functions.text import first_filled
from dossierlake.lexicons.corpus import CORPUS_CHAPTERS, CORPUS_TAGS
from dossierlake.operators import ingest as IN, keyword as KW, reports as RP, search as H, tagging as TG
from dossierlake.plans import sqltext as S
from dossierlake.plans.ingest_plans import CHUNKS_SQL, CORPUS_TABLE_TYPES, _IS_TABLE, _KINDS, corpus_units, tags_sql
from dossierlake.plans.keyword_plans import TOPIC, TOPIC_TERMS
from dossierlake.plans.registry import register
from dossierlake.sources.tables import table

EXPECTED_VERSION = IN.INDEX_VERSION


def report_chunks(spark, sf_dir):
    """Chunks with headings, table type and tags; the fuzzy heading match is left out so that SQL can follow."""
    units = TB.with_table_columns(corpus_units(spark, sf_dir), path="heading_path", kinds=CORPUS_TABLE_TYPES)
    units = units.withColumn(
        "domain_keywords", F.concat_ws(", ", TG.domain_tags(F.concat_ws(" ", "unit_text", "document_title"), CORPUS_TAGS))
    )
    absent = F.lit(None).cast("string")
    units = units.withColumns({
        "canonical_chapter_title": F.nullif(F.col("chapter_title"), F.lit(HD.DEFAULT_CHAPTER)),
        "canonical_section_title": absent, "canonical_subsection_title": absent, "canonical_heading_path": absent,
    })
    chunks = IN.with_chunks(units)
    return chunks.withColumn("chunk_id", IN.chunk_id("document_id", "file_name", "page_no", "chunk_index", "chunk_text"))


REPORT_SQL = f"""{S.UNITS}, {S.headings(CORPUS_CHAPTERS)}, {CHUNKS_SQL}, {S.DOCS},
tagged AS MATERIALIZED (SELECT doc_id, page_no, array_to_string({S.ordered_distinct('tg')}[1:24], ', ') AS domain_keywords,
     CASE WHEN {_IS_TABLE} THEN CASE {_KINDS} ELSE 'general' END ELSE '' END AS table_type
   FROM (SELECT doc_id, page_no, unit_text, heading_path || ' ' || section_title || ' ' || unit_text AS hay,
           {tags_sql("lower(unit_text || ' ' || document_title)", CORPUS_TAGS)} AS tg
         FROM units JOIN chaptered USING (doc_id, page_no) JOIN docs USING (doc_id))),
rc AS MATERIALIZED (SELECT c.*, h.chapter_title, h.section_title, h.heading_path, t.domain_keywords, t.table_type,
     document_id, document_title, project_id, project_name,
     'chk_' || substr(sha1(document_id || ':' || document_title || '.docx:' || c.page_no || ':' || chunk_index || ':' || substr(chunk_text, 1, 50)), 1, 16) AS chunk_id
   FROM chunks c JOIN chaptered h USING (doc_id, page_no) JOIN tagged t USING (doc_id, page_no) JOIN docs USING (doc_id))"""


@register(
    "index_stats",
    f"""WITH RECURSIVE {S.UNITS}, {CHUNKS_SQL}
    SELECT 'projects' AS name, CAST(count(DISTINCT source) AS BIGINT) AS n FROM documents
    UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks
    UNION ALL SELECT 'search_logs', count(*) FROM events""",
    covers="A1",
)
def index_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return RP.index_stats(
        docs.select("source").distinct(), docs, IN.with_chunks(corpus_units(spark, sf_dir)), table(spark, sf_dir, "events")
    )


@register(
    "chapter_names",
    f"WITH RECURSIVE {REPORT_SQL} SELECT chapter_title, CAST(count(*) AS BIGINT) AS n FROM rc GROUP BY 1",
    covers="A2",
)
def chapter_names(spark, sf_dir):
    return RP.chapter_names(report_chunks(spark, sf_dir))


@register(
    "chapter_report",
    f"""WITH RECURSIVE {REPORT_SQL}
    SELECT chapter_title AS chapter, CAST(count(DISTINCT document_id) AS BIGINT) AS document_count, CAST(count(*) AS BIGINT) AS chunk_count,
           min(page_no) || '-' || max(page_no) AS page_range FROM rc GROUP BY 1""",
    covers="A3, J1",
)
def chapter_report(spark, sf_dir):
    return RP.chapter_report(report_chunks(spark, sf_dir))


_SUB = HD.canonical_chapter  # the third level reuses containment with the tag lexicon
_SUB_SQL = S.canonical_case(
    S.norm_chapter("section_title"), f"regexp_replace(lower(section_title), {S.quote(HD.NOT_TITLE_CHARS)}, '', 'g')", CORPUS_TAGS
)


@register(
    "heading_tree",
    f"""WITH RECURSIVE {REPORT_SQL},
    lv AS (SELECT 1 AS level, chapter_title AS label, document_id, page_no, domain_keywords FROM rc
      UNION ALL SELECT 2, section_title, document_id, page_no, domain_keywords FROM rc WHERE section_title <> ''
      UNION ALL SELECT 3, sub, document_id, page_no, domain_keywords FROM (SELECT *, {_SUB_SQL} AS sub FROM rc) WHERE sub <> ''),
    ct AS (SELECT level, label, count(*) AS chunk_count, count(DISTINCT document_id) AS document_count,
             count(DISTINCT document_id || ':' || page_no) AS page_count FROM lv GROUP BY level, label
           QUALIFY row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, label) <= 200),
    wd AS (SELECT level, label, unnest(string_split_regex(domain_keywords, '[,;\\s]+')) AS w FROM lv),
    wc AS (SELECT level, label, w, count(*) AS n FROM wd WHERE w <> '' GROUP BY level, label, w
           QUALIFY row_number() OVER (PARTITION BY level, label ORDER BY count(*) DESC, w) <= 5),
    tk AS (SELECT level, label, string_agg(w, ', ' ORDER BY n DESC, w) AS top_keywords FROM wc GROUP BY ALL)
    SELECT CAST(level AS INT) AS level, label, CAST(chunk_count AS BIGINT) AS chunk_count, CAST(document_count AS BIGINT) AS document_count,
      CAST(page_count AS BIGINT) AS page_count, coalesce(top_keywords, '') AS top_keywords FROM ct LEFT JOIN tk USING (level, label)""",
    covers="A4, X17",
)
def heading_tree(spark, sf_dir):
    chunks = report_chunks(spark, sf_dir)
    return RP.heading_tree(chunks, subsection=_SUB(F.col("section_title"), CORPUS_TAGS))


@register(
    "validation_counts",
    f"""WITH RECURSIVE {REPORT_SQL},
    v AS (SELECT count(*) AS chunks, count(DISTINCT chapter_title) AS distinct_chapters,
      count_if(chapter_title <> '' AND heading_path <> '' AND {S.norm_chapter('heading_path')} <> '') AS chunks_with_heading_metadata,
      count_if(chapter_title = '') AS missing_chapter_title, count_if(heading_path = '') AS missing_heading_path,
      count_if(chapter_title = '기타') AS canonical_chapter_missing_count, count_if({_SUB_SQL} = '') AS canonical_section_missing_count,
      count_if(heading_path = '기타') AS canonical_heading_path_missing_count,
      count_if(length(section_title) > 0 AND length(section_title) < 72) AS heading_classification_low_confidence_count,
      count_if(table_type <> '') AS table_chunk_count,
      count_if(table_type = 'staff' OR contains(domain_keywords, 'STAFF')) AS staff_chunk_count,
      count_if(table_type = 'cost' OR contains(domain_keywords, 'CLOUD_COST')) AS cost_chunk_count,
      0 AS vector_missing_chunk_count, count_if({S.norm_chapter('heading_path')} = '') AS missing_normalized_heading_path,
      count_if({S.norm_chapter('heading_path')} = '') AS missing_heading_norm, count_if(chapter_title = '기타') AS other_chunks,
      count_if(chunk_index > 1) AS index_version_mismatch_chunks FROM rc)
    SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in (
        'chunks', 'distinct_chapters', 'chunks_with_heading_metadata', 'missing_chapter_title', 'missing_heading_path',
        'canonical_chapter_missing_count', 'canonical_section_missing_count', 'canonical_heading_path_missing_count',
        'heading_classification_low_confidence_count', 'table_chunk_count', 'staff_chunk_count', 'cost_chunk_count',
        'vector_missing_chunk_count', 'missing_normalized_heading_path', 'missing_heading_norm', 'other_chunks',
        'index_version_mismatch_chunks'))},
      (SELECT CAST(count(*) AS BIGINT) FROM documents) AS documents,
      chunks > 0 AND chunks_with_heading_metadata = chunks AND missing_chapter_title = 0 AND missing_heading_path = 0
        AND missing_normalized_heading_path = 0 AND missing_heading_norm = 0 AND index_version_mismatch_chunks = 0 AS metadata_ready,
      NOT (chunks > 0 AND chunks_with_heading_metadata = chunks AND missing_chapter_title = 0 AND missing_heading_path = 0
        AND missing_normalized_heading_path = 0 AND missing_heading_norm = 0 AND index_version_mismatch_chunks = 0) AS reindex_required
    FROM v""",
    covers="A5",
)
def validation_counts(spark, sf_dir):
    section = F.col("section_title")
    chunks = report_chunks(spark, sf_dir).withColumns({
        "canonical_section_title": _SUB(section, CORPUS_TAGS),
        "canonical_heading_path": F.nullif(F.col("heading_path"), F.lit(HD.DEFAULT_CHAPTER)),
        "normalized_heading_path": HD.normalize_chapter("heading_path"),
        "heading_norm": HD.normalize_chapter("heading_path"),
        "heading_classification_confidence": F.length(section) / 100.0,
        "embedding_id": F.col("chunk_id"),
        "index_version": F.when(F.col("chunk_index") > 1, F.lit("older")).otherwise(F.lit(EXPECTED_VERSION)),
    })
    return RP.validation_counts(chunks, table(spark, sf_dir, "documents"), EXPECTED_VERSION)


@register(
    "distribution_topn",
    f"""WITH RECURSIVE {REPORT_SQL}
    SELECT coalesce(nullif(section_title, ''), '기타') AS label, CAST(count(*) AS BIGINT) AS chunk_count,
           CAST(count(DISTINCT document_id) AS BIGINT) AS document_count FROM rc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    covers="A6",
)
def distribution_topn(spark, sf_dir):
    return RP.distribution(report_chunks(spark, sf_dir), first_filled("section_title", F.lit(HD.DEFAULT_CHAPTER)))


CANDIDATE_SQL = "lower(concat_ws(chr(10), chunk_text, chapter_title, section_title, heading_path, document_title, project_name))"
CHUNK_HAY_SQL = f"""lower({S.synonyms("concat_ws(' ', chunk_text, domain_keywords, chapter_title, coalesce(nullif(chapter_title, '기타'), ''), section_title, heading_path, table_headers, table_row_text, parent_context, document_title, project_name)")})"""
RESULTS_SQL = f"""{REPORT_SQL},
contexts AS (SELECT doc_id, heading_path, substr(string_agg(unit_text, chr(10) ORDER BY page_no), 1, 1800) AS parent_context
    FROM units JOIN chaptered USING (doc_id, page_no) GROUP BY ALL),
tabled AS (SELECT rc.*, contexts.parent_context, CASE WHEN table_type <> '' THEN substr(string_split(unit_text, chr(10))[1], 1, 400) ELSE '' END AS table_headers,
    CASE WHEN table_type <> '' THEN substr(unit_text, 1, 1800) ELSE '' END AS table_row_text FROM rc JOIN units USING (doc_id, page_no) JOIN contexts USING (doc_id, heading_path)),
hayed AS (SELECT *, {CHUNK_HAY_SQL} AS hay, {CANDIDATE_SQL} AS within FROM tabled),
scored AS (SELECT h.*, list_filter(q.terms, lambda t: contains(hay, t)) AS matched,
    round(CAST(len(list_filter(q.terms, lambda t: contains(hay, t))) AS DOUBLE) / len(q.terms), 6) AS score
  FROM hayed h, (SELECT {TOPIC_TERMS} AS terms) q),
results AS MATERIALIZED (SELECT * FROM scored WHERE score > 0 AND len(list_filter((SELECT {TOPIC_TERMS}), lambda t: contains(within, t))) > 0 ORDER BY score DESC, chunk_id LIMIT 100)"""


def chunk_results(spark, sf_dir, k=100):
    """R1 over the chunk table: the best k chunks for the topic."""
    chunks = report_chunks(spark, sf_dir)
    scored = KW.coverage_scores(chunks, TOPIC, H.row_haystack(chunks.columns), H.candidate_text(chunks.columns), positive=False)
    top = KW.best_rows(scored, "keyword_score", "chunk_id", k)
    return H.result_rows(top, F.lit(TOPIC)).withColumns({"score": F.col("keyword_score"), "query_id": F.lit(0).cast("bigint")})


_RESULT_WORDS = """rw AS (SELECT heading_path AS area, trim(unnest(list_concat(matched, string_split(domain_keywords, ',')))) AS w FROM results)"""


@register(
    "chunk_keyword_search",
    f"""WITH RECURSIVE {RESULTS_SQL}
    SELECT chunk_id, document_id, CAST(page_no AS BIGINT) AS page_no, score, array_to_string(matched, ',') AS matched_keywords,
      {S.snippet('chunk_text')} AS matched_text FROM results""",
    covers="R1, R9, F1 over chunks",
)
def chunk_keyword_search(spark, sf_dir):
    return chunk_results(spark, sf_dir).select(
        "chunk_id", "document_id", F.col("page_no").cast("bigint").alias("page_no"), "score",
        F.concat_ws(",", "matched_keywords").alias("matched_keywords"), "matched_text",
    )


@register(
    "result_metrics",
    f"""WITH RECURSIVE {RESULTS_SQL}, {_RESULT_WORDS}
    SELECT 0::BIGINT AS query_id, CAST(count(DISTINCT document_id) AS BIGINT) AS document_count,
      CAST(count(DISTINCT document_id || ':' || page_no) AS BIGINT) AS page_count, max(score) AS max_score,
      (SELECT heading_path FROM results GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_area,
      (SELECT string_agg(w, ', ' ORDER BY n DESC, w) FROM (SELECT w, count(*) AS n FROM rw WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 5)) AS top_keywords
    FROM results""",
    covers="A10",
)
def result_metrics(spark, sf_dir):
    return RP.result_metrics(chunk_results(spark, sf_dir))


@register(
    "area_distribution",
    f"""WITH RECURSIVE {RESULTS_SQL}, {_RESULT_WORDS},
    wc AS (SELECT area, w, count(*) AS n FROM rw WHERE w <> '' GROUP BY area, w
           QUALIFY row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, w) <= 6),
    tk AS (SELECT area, string_agg(w, ', ' ORDER BY n DESC, w) AS top_keywords FROM wc GROUP BY area),
    ct AS (SELECT heading_path AS area, count(*) AS c, count(DISTINCT document_id) AS d, count(DISTINCT document_id || ':' || page_no) AS p FROM results GROUP BY 1)
    SELECT 0::BIGINT AS query_id, area, CAST(c AS BIGINT) AS chunk_count, CAST(d AS BIGINT) AS document_count, CAST(p AS BIGINT) AS page_count,
      coalesce(top_keywords, '') AS top_keywords FROM ct LEFT JOIN tk USING (area)""",
    covers="A11",
)
def area_distribution(spark, sf_dir):
    return RP.area_distribution(chunk_results(spark, sf_dir))


@register(
    "document_groups",
    f"""WITH RECURSIVE {RESULTS_SQL}
    SELECT 0::BIGINT AS query_id, document_id, max(score) AS best_score, CAST(count(*) AS BIGINT) AS hits,
      string_agg(chunk_id, ',' ORDER BY score DESC, chunk_id) AS keys,
      CAST(row_number() OVER (ORDER BY max(score) DESC, document_id) AS BIGINT) AS rank FROM results GROUP BY document_id""",
    covers="A8",
)
def document_groups(spark, sf_dir):
    return RP.document_groups(chunk_results(spark, sf_dir))


@register(
    "nation_supplier_report",
    """SELECT n_name AS chapter, CAST(count(*) AS BIGINT) AS chunk_count, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS document_count,
      CAST(min(l_linenumber) AS BIGINT) AS first_page, CAST(max(l_linenumber) AS BIGINT) AS last_page
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    covers="A3, J1 on the star schema",
)
def nation_supplier_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("chapter"))
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    counted = RP.label_counts(joined, ["chapter"], "l_orderkey", "l_linenumber")
    return counted.select(
        "chapter", "chunk_count", "document_count", F.col("first_page").cast("bigint").alias("first_page"),
        F.col("last_page").cast("bigint").alias("last_page"),
    )
