"""Ingestion queries: units, headings, chunks, tables, tags and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import headings as HD, tables as TB, text as T
from dossierlake.lexicons import fixed_values as V
from dossierlake.lexicons.corpus import CORPUS_CHAPTERS, CORPUS_TAGS
from dossierlake.operators import ingest as IN, tagging as TG
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.sources.tables import corpus_documents, table

CORPUS_TABLE_TYPES = (("staff", ("the", "than")), ("cost", ("que",)), ("schedule", ("der", "und")))


def corpus_units(spark, sf_dir):
    return IN.units_of(corpus_documents(spark, sf_dir), "text", CORPUS_CHAPTERS)


@register(
    "unit_bundling",
    f"""WITH RECURSIVE {S.UNITS}
    SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(length(unit_text) AS BIGINT) AS chars, md5(unit_text) AS digest FROM units""",
    covers="S8",
)
def unit_bundling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", IN.paragraphs_of("text").alias("paragraphs"))
    units = T.explode_rows(IN.with_units(docs), ["doc_id"], F.col("units"), "u")
    return units.select(
        "doc_id", F.col("u.page_no").cast("bigint").alias("page_no"),
        F.length("u.text").cast("bigint").alias("chars"), F.md5("u.text").alias("digest"),
    )


@register(
    "heading_carry_forward",
    f"""WITH RECURSIVE {S.UNITS}, {S.headings(CORPUS_CHAPTERS)}
    SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, chapter_title, section_title, heading_path FROM chaptered""",
    covers="P5, P6, P7, P8, W3",
)
def heading_carry_forward(spark, sf_dir):
    return corpus_units(spark, sf_dir).select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), "chapter_title", "section_title", "heading_path"
    )


_BAR = "len(list_filter(string_split(unit_text, chr(10)), lambda l: contains(l, '|')))"
_IS_TABLE = f"""(len(string_split(unit_text, chr(10))) >= 2 AND ({_BAR} >= 2 OR
    {' + '.join(f"CAST(contains(unit_text, {S.quote(t)}) AS INT)" for t in TB.HEADER_TERMS)} >= 2))"""


def _rfind(window: str, mark: str) -> str:
    return (
        f"CASE WHEN contains({window}, {mark}) THEN length({window}) - strpos(reverse({window}), reverse({mark})) + 1 "
        f"- length({mark}) ELSE -1 END"
    )


def _cut(start: str) -> str:
    window = f"substr(t, CAST({start} AS BIGINT) + 1, 1000)"
    soft = f"greatest({_rfind(window, 'chr(10)')}, {_rfind(window, S.quote('. '))}, {_rfind(window, S.quote('다.'))})"
    return f"CASE WHEN {soft} > 550 THEN {start} + {soft} + 1 ELSE least(length(t), {start} + 1000) END"


CHUNKS_SQL = f"""
big AS MATERIALIZED (SELECT doc_id, page_no, unit_text AS t FROM units WHERE NOT {_IS_TABLE} AND length(unit_text) > 1000),
cuts AS (
    SELECT doc_id, page_no, 1 AS part, 0::BIGINT AS st, CAST({_cut('0')} AS BIGINT) AS en FROM big
    UNION ALL
    SELECT cuts.doc_id, cuts.page_no, part + 1, greatest(0, en - 150), CAST({_cut('greatest(0, en - 150)')} AS BIGINT)
    FROM cuts JOIN big ON big.doc_id = cuts.doc_id AND big.page_no = cuts.page_no WHERE en < length(t)),
chunks AS MATERIALIZED (
    SELECT doc_id, page_no, part AS chunk_index, {S.strip('substr(t, st + 1, en - st)')} AS chunk_text, st AS char_start, en AS char_end
    FROM cuts JOIN big USING (doc_id, page_no)
    UNION ALL
    SELECT doc_id, page_no, 1, unit_text, 0, length(unit_text) FROM units WHERE {_IS_TABLE} OR length(unit_text) <= 1000)
"""


@register(
    "chunk_boundary",
    f"""WITH RECURSIVE {S.UNITS}, {CHUNKS_SQL}, {S.DOCS}
    SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(chunk_index AS BIGINT) AS chunk_index,
      CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, md5(chunk_text) AS digest,
      'chk_' || substr(sha1(document_id || ':' || document_title || '.docx:' || page_no || ':' || chunk_index || ':' || substr(chunk_text, 1, 50)), 1, 16) AS chunk_id
    FROM chunks JOIN docs USING (doc_id)""",
    covers="P12, P13, P14 identity",
)
def chunk_boundary(spark, sf_dir):
    chunks = IN.with_chunks(corpus_units(spark, sf_dir))
    return chunks.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("page_no", "chunk_index", "char_start", "char_end")],
        F.md5("chunk_text").alias("digest"),
        IN.chunk_id("document_id", "file_name", "page_no", "chunk_index", "chunk_text").alias("chunk_id"),
    )


_KINDS = " ".join(
    f"WHEN {S.contains_any('hay', terms)} THEN {S.quote(kind)}" for kind, terms in CORPUS_TABLE_TYPES
)


@register(
    "table_type",
    f"""WITH RECURSIVE {S.UNITS}, {S.headings(CORPUS_CHAPTERS)},
    x AS (SELECT doc_id, page_no, unit_text, section_title, heading_path,
            heading_path || ' ' || section_title || ' ' || unit_text AS hay FROM units JOIN chaptered USING (doc_id, page_no) WHERE {_IS_TABLE})
    SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CASE {_KINDS} ELSE 'general' END AS table_type,
      substr(coalesce(list_filter(string_split(unit_text, chr(10))[1:4], lambda l: contains(l, 'Table') OR contains(l, 'tion'))[1],
             trim(coalesce(nullif(section_title, ''), heading_path))), 1, 160) AS table_title,
      substr(string_split(unit_text, chr(10))[1], 1, 400) AS table_headers, md5(substr(unit_text, 1, 1800)) AS row_digest
    FROM x""",
    covers="P16",
)
def table_type(spark, sf_dir):
    units = TB.with_table_columns(
        corpus_units(spark, sf_dir), path="heading_path", kinds=CORPUS_TABLE_TYPES, title_terms=("Table", "tion")
    )
    return units.filter(F.col("table_type") != "").select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), "table_type", "table_title", "table_headers",
        F.md5("table_row_text").alias("row_digest"),
    )


@register(
    "parent_context",
    f"""WITH RECURSIVE {S.UNITS}, {S.headings(CORPUS_CHAPTERS)},
    g AS (SELECT doc_id, heading_path, string_agg(unit_text, chr(10) ORDER BY page_no) AS body
          FROM units JOIN chaptered USING (doc_id, page_no) GROUP BY ALL)
    SELECT doc_id, heading_path, md5(substr(body, 1, 1800)) AS digest, CAST(least(length(body), 1800) AS BIGINT) AS chars FROM g""",
    covers="P15",
)
def parent_context(spark, sf_dir):
    contexts = corpus_units(spark, sf_dir).groupBy("doc_id", "heading_path").agg(F.first("parent_context").alias("c"))
    return contexts.select(
        "doc_id", "heading_path", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("chars")
    )


def tags_sql(hay: str, groups) -> str:
    parts = []
    for tag, words in groups.items():
        found = f"list_filter({S.str_list(words)}, lambda w: contains({hay}, lower(w)))[1:4]"
        parts.append(f"CASE WHEN len({found}) > 0 THEN list_concat([{S.quote(tag)}], {found}) ELSE [] END")
    return f"flatten([{', '.join(parts)}])"


def _tag_query(body_cte: str, groups) -> str:
    return f"""{body_cte},
    m AS (SELECT id, {tags_sql('hay', groups)} AS tags FROM b),
    u AS (SELECT id, {S.ordered_distinct('tags')} AS tags FROM m)
    SELECT id, array_to_string(tags[1:24], ', ') AS domain_keywords FROM u"""


@register(
    "domain_tags",
    _tag_query("WITH b AS (SELECT doc_id AS id, lower(text || ' ' || source) AS hay FROM documents)", TG.KOREAN_TAGS),
    covers="P18, J6",
)
def domain_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws(", ", TG.domain_tags(F.concat_ws(" ", "text", "source"))).alias("domain_keywords"),
    )


@register(
    "domain_tags_corpus_lexicon",
    _tag_query(
        "WITH b AS (SELECT conv_id * 1000 + turn AS id, lower(text || ' ' || role) AS hay FROM conversations)", CORPUS_TAGS
    ),
    covers="P18 with another lexicon",
)
def domain_tags_corpus_lexicon(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat_ws(", ", TG.domain_tags(F.concat_ws(" ", "text", "role"), CORPUS_TAGS)).alias("domain_keywords"),
    )


def _compacts(words) -> str:
    return S.str_list(sorted({TG._compact(w) for w in words}))


def _stop_sql(t: str) -> str:
    compact = f"translate(lower({t}), {S.quote(TG.GENERIC_MARKS)}, '')"
    endings = "(?:" + "|".join(TG.ORGANIZATION_ENDINGS + TG.VENDOR_ENDINGS) + ")$"
    return f"""(list_contains({_compacts(V.DOMAIN_STOPWORDS)}, {compact}) OR regexp_matches({t}, '^\\d+$')
      OR regexp_matches({compact}, '^\\d+$') OR length({compact}) > 14 OR regexp_matches({compact}, {S.quote(endings)})
      OR (regexp_matches({t}, '^[A-Za-z]{{3,}}$') AND NOT list_contains({S.str_list(V.ALLOWED_ACRONYMS)}, lower({t})))
      OR regexp_matches({compact}, '[가-힣]{{3,}}r$') OR regexp_matches({t}, '(?:{'|'.join(TG.PREDICATE_ENDINGS)})$')
      OR {S.contains_any(compact, TG.STOP_PARTS)})"""


def _generic_sql(t: str) -> str:
    return f"list_contains({_compacts(V.GENERIC_ANCHOR_TERMS)}, translate(lower({t}), {S.quote(TG.GENERIC_MARKS)}, ''))"


_VARIANTS = _compacts(v for phrases, _ in TG.PHRASE_VOTES for _, vs in phrases for v in vs)
_FIXED_BALLOTS = ", ".join(
    f"CASE WHEN {S.contains_any('low', [v.lower() for v in vs])} THEN {{'w': {S.quote(word)}, 'v': {vote}}} END"
    for phrases, vote in TG.PHRASE_VOTES for word, vs in phrases
)
_CTX = f"translate({S.synonyms('context')}, '\\/_-.()[]', '         ')"
KEYWORDS_SQL = f"""
kc AS (SELECT id, body, context, {_CTX} AS cw FROM ksrc),
kh AS (SELECT id, body || ' ' || cw AS hay, cw, lower(body || ' ' || cw || ' ' || context) AS low FROM kc),
kt AS (SELECT id, low, {S.tokens('hay')} AS toks,
       list_filter({S.tokens('cw')}, lambda t: NOT list_contains({S.str_list(V.DOMAIN_STOPWORDS)}, t) AND NOT {_generic_sql('t')}
                   AND NOT {_stop_sql('t')}) AS ctx FROM kh),
kf AS (SELECT id, low, list_filter(toks, lambda t: NOT {_generic_sql('t')} AND NOT {_stop_sql('t')}
         AND NOT list_contains({_VARIANTS}, translate(lower(t), {S.quote(TG.GENERIC_MARKS)}, ''))) AS toks,
         ({S.ordered_distinct('ctx')})[1:8] AS ctx FROM kt),
kb AS (SELECT id, list_concat(list_concat(list_filter([{_FIXED_BALLOTS}], lambda b: b IS NOT NULL),
         list_transform(ctx, lambda t: {{'w': t, 'v': 7}})),
         list_transform(toks, lambda t: {{'w': t, 'v': CASE WHEN {S.contains_any('t', TG.TECHNICAL_PARTS)} THEN 5 ELSE 1 END}})) AS bs FROM kf),
kx AS (SELECT id, b.w AS keyword, b.v AS v, pos FROM (SELECT id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos FROM kb)),
kg AS (SELECT id, keyword, CAST(sum(v) AS BIGINT) AS votes, min(pos) AS first_at FROM kx GROUP BY id, keyword),
keywords AS (SELECT id, keyword, votes, CAST(row_number() OVER (PARTITION BY id ORDER BY votes DESC, first_at) AS BIGINT) AS place FROM kg
             QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, first_at) <= 12)
"""
_KSRC = "ksrc AS (SELECT doc_id AS id, text AS body, source || ' ' || lang || '_' || doc_id AS context FROM documents)"


def document_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    context = F.concat_ws(" ", "source", F.concat_ws("_", "lang", F.col("id").cast("string")))
    return TG.design_keywords(docs, "id", "text", context)


@register("design_keywords", f"WITH {_KSRC}, {KEYWORDS_SQL} SELECT * FROM keywords", covers="P19, P20")
def design_keywords(spark, sf_dir):
    return document_keywords(spark, sf_dir)


@register(
    "common_keyword_cutoff",
    f"""WITH {_KSRC}, {KEYWORDS_SQL},
    common AS (SELECT keyword FROM keywords GROUP BY keyword
       HAVING count(DISTINCT id) >= greatest(5, CAST(floor((SELECT count(*) FROM documents) * 0.7::DOUBLE) AS BIGINT)))
    SELECT id, keyword, votes, place FROM keywords WHERE keyword NOT IN (SELECT keyword FROM common)""",
    covers="K12, A13",
)
def common_keyword_cutoff(spark, sf_dir):
    kept = TG.without_common_keywords(document_keywords(spark, sf_dir), "id", table(spark, sf_dir, "documents"))
    return kept.select("id", "keyword", "votes", "place")


_H1 = "(?is)<h1[^>]*>(.*?)</h1>"


@register(
    "page_h1_headings",
    f"""WITH h AS (SELECT page_id, {S.squeeze(f"regexp_replace(regexp_extract(html, {S.quote(_H1)}, 1), '<[^>]+>', ' ', 'g')")} AS t FROM pages),
    n AS (SELECT page_id, t, {S.norm_chapter('t')} AS nt, regexp_replace(lower(t), {S.quote(HD.NOT_TITLE_CHARS)}, '', 'g') AS ct FROM h)
    SELECT page_id, t AS section_title, nt AS normalized_title, coalesce(nullif({S.canonical_case('nt', 'ct', CORPUS_CHAPTERS)}, ''), '기타') AS chapter_title FROM n""",
    covers="P6, P7, P8",
)
def page_h1_headings(spark, sf_dir):
    raw = F.regexp_replace(F.regexp_extract("html", _H1, 1), "<[^>]+>", " ")
    titles = table(spark, sf_dir, "pages").select("page_id", T.squeeze(raw).alias("section_title"))
    return titles.select(
        "page_id", "section_title", HD.normalize_chapter("section_title").alias("normalized_title"),
        T.first_filled(HD.canonical_chapter("section_title", CORPUS_CHAPTERS), F.lit(HD.DEFAULT_CHAPTER)).alias("chapter_title"),
    )


@register(
    "embedding_text",
    f"""WITH {S.DOCS}
    SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN trim(document_title) <> '' THEN '문서명: ' || document_title END,
      CASE WHEN trim(project_name) <> '' THEN '프로젝트명: ' || project_name END,
      CASE WHEN trim(file_path) <> '' THEN '원본경로: ' || file_path END,
      CASE WHEN trim(text) <> '' THEN '상위문맥: ' || substr(text, 1, 700) END,
      CASE WHEN trim(text) <> '' THEN '본문: ' || text END)) AS digest FROM docs""",
    covers="P17",
)
def embedding_text(spark, sf_dir):
    docs = corpus_documents(spark, sf_dir).withColumns({
        "client_name": F.lit(""), "canonical_heading_path": F.lit(None).cast("string"),
        "raw_heading_path": F.col("file_path"), "display_page": F.lit(" "), "domain_keywords": F.lit(""),
        "parent_context": F.col("text"), "chunk_text": F.col("text"),
    })
    return docs.select("doc_id", F.md5(IN.embedding_text()).alias("digest"))


@register("chunk_table", covers="P9, P10, P11, P14-P18: the fuzzy heading match has no SQL form")
def chunk_table(spark, sf_dir):
    taxonomy = (CORPUS_CHAPTERS, CORPUS_CHAPTERS, CORPUS_CHAPTERS)
    chunks = IN.chunk_table(corpus_documents(spark, sf_dir), CORPUS_CHAPTERS, CORPUS_TAGS, taxonomy)
    return chunks.select(
        "chunk_id", "document_id", "page_no", "chunk_index", "canonical_chapter_title", "canonical_section_title",
        "canonical_heading_path", "heading_classification_confidence", "heading_classification_reason", "heading_norm",
        "table_type", "domain_keywords", "token_count", "embedding_text",
    )
