"""Pieces of DuckDB SQL that state the same definitions as `functions`, for the checking queries."""

from __future__ import annotations

from dossierlake.functions.text import BLANKS, EDGE_BLANKS, SENTENCE_END
from dossierlake.functions.tokens import EXPANSIONS, TOKEN_PATTERN, SUFFIX_PATTERN
from dossierlake.lexicons.fixed_values import TOKEN_STOPWORDS

NOT_WORD = "[^\\p{L}\\p{N}_]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {quote(EDGE_BLANKS)}, '', 'g')"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {quote(f'[{BLANKS}]+')}, ' ', 'g'), ' ')"


def clean(expr: str) -> str:
    unix = f"regexp_replace({expr}, '\\r\\n?', chr(10), 'g')"
    single = f"regexp_replace({unix}, '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({single}, {quote(f'[{BLANKS}]*\n[{BLANKS}]*')}, chr(10), 'g')")


def snippet(expr: str, limit: int = 500) -> str:
    flat = f"replace({clean(expr)}, chr(10), ' ')"
    return (
        f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE "
        f"regexp_replace(substr({flat}, 1, {limit - 1}), {quote(f'[{BLANKS}]+$')}, '') || '...' END"
    )


def sentence(expr: str) -> str:
    return strip(f"string_split_regex({squeeze(expr)}, {quote(SENTENCE_END)})[1]")


def synonyms(expr: str) -> str:
    rnd = quote(f"(?i)(^|{NOT_WORD})(?:r\\s*&\\s*d|r\\s*[-_/]\\s*d|rnd)({NOT_WORD}|$)")
    ai = quote(f"(?i)(^|{NOT_WORD})ai({NOT_WORD}|$)")
    spelled = f"regexp_replace({expr}, {rnd}, '\\1 RND 연구개발 \\2', 'g')"
    korean = f"({spelled} || CASE WHEN regexp_matches({spelled}, {ai}) THEN ' 인공지능' ELSE '' END)"
    return f"({korean} || CASE WHEN contains({korean}, '인공지능') THEN ' ai' ELSE '' END)"


def tokens(expr: str) -> str:
    norm = (
        f"rtrim(regexp_replace(rtrim(lower(t), '.'), {quote(SUFFIX_PATTERN)}, '\\1'), '.')"
    )
    cases = " ".join(f"WHEN {quote(k)} THEN {str_list(v)}" for k, v in EXPANSIONS.items())
    raw = f"regexp_extract_all({synonyms(expr)}, {quote(TOKEN_PATTERN)})"
    plain = f"list_transform({raw}, lambda t: {norm})"
    wide = f"flatten(list_transform({plain}, lambda t: CASE t {cases} ELSE [t] END))"
    return f"list_filter({wide}, lambda t: length(t) > 1 AND NOT list_contains({str_list(TOKEN_STOPWORDS)}, t))"


def ordered_distinct(expr: str) -> str:
    """First occurrence of each element, order kept."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


DOCS = """
docs AS (
  SELECT doc_id, text, lang AS document_type, source AS project_name,
         'prj_' || substr(sha1(source), 1, 16) AS project_id,
         source || '/' || lang || '_' || doc_id || '.docx' AS file_path,
         'doc_' || substr(sha1(source || '/' || lang || '_' || doc_id || '.docx'), 1, 16) AS document_id,
         lang || '_' || doc_id AS document_title,
         CAST(doc_id AS DOUBLE) AS file_mtime
  FROM documents)
"""


def norm_chapter(expr: str) -> str:
    from dossierlake.functions import headings as HD

    text = f"trim({expr}, ' ')"
    for prefix in (HD.CHAPTER_PREFIX, HD.NUMERAL_PREFIX, HD.NUMBER_PREFIX):
        text = f"regexp_replace({text}, {quote(prefix)}, '')"
    return f"regexp_replace(regexp_replace(lower({text}), {quote(HD.DROPPED_WORDS)}, '', 'g'), {quote(HD.NOT_TITLE_CHARS)}, '', 'g')"


def canonical_case(norm: str, compact: str, groups) -> str:
    """CASE over ready norm and compact columns."""
    from dossierlake.functions import headings as HD

    def hits(column: str, values) -> list[str]:
        return [f"contains({column}, {quote(v)})" for v in dict.fromkeys(values) if v]

    whens = " ".join(
        "WHEN " + " OR ".join(hits(norm, map(HD.plain_norm, a)) + hits(compact, map(HD.plain_compact, a)))
        + f" THEN {quote(name)}" for name, a in groups.items()
    )
    return f"CASE {whens} ELSE '' END"


def contains_any(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(t)})" for t in terms) + ")"


UNITS = f"""
lines AS MATERIALIZED (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split({clean('text')}, chr(10)), lambda x: x <> '') AS ls FROM documents)),
paged AS (
    SELECT doc_id, i, 1 AS page_no, length(line) AS acc FROM lines WHERE i = 1
    UNION ALL
    SELECT l.doc_id, l.i, CASE WHEN acc >= 1200 THEN page_no + 1 ELSE page_no END,
           CASE WHEN acc >= 1200 THEN 0 ELSE acc END + length(line)
    FROM paged JOIN lines l ON l.doc_id = paged.doc_id AND l.i = paged.i + 1),
plines AS MATERIALIZED (SELECT doc_id, i, page_no, line,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS rn FROM paged JOIN lines USING (doc_id, i)),
units AS MATERIALIZED (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY i) AS unit_text FROM plines GROUP BY doc_id, page_no)
"""


def headings(groups) -> str:
    """CTEs after UNITS: chaptered(doc_id, page_no, chapter_title, section_title, heading_path)."""
    from dossierlake.functions import headings as HD
    from dossierlake.lexicons.fixed_values import SENTENCE_MARKERS

    title = f"regexp_replace({squeeze('line')}, '^[ .\\t]+|[ .\\t]+$', '', 'g')"
    return f"""
titled AS (SELECT doc_id, page_no, i, {title} AS t FROM plines WHERE rn <= 16),
normed AS (SELECT *, {norm_chapter('t')} AS nt, regexp_replace(lower(t), {quote(HD.NOT_TITLE_CHARS)}, '', 'g') AS ct FROM titled),
named AS (SELECT *, {canonical_case('nt', 'ct', groups)} AS c FROM normed),
events AS (SELECT *, length(replace(t, ' ', '')) >= 3 AND (c <> '' OR (regexp_matches(t, {quote(HD.HEADING_PREFIX)})
      AND (length(t) <= 45 OR (length(t) <= 90 AND NOT {contains_any('t', SENTENCE_MARKERS)})))) AS is_h FROM named),
sets AS (SELECT doc_id, page_no, i,
    CASE WHEN NOT is_h THEN NULL WHEN c <> '' THEN c
         WHEN regexp_matches(t, {quote(HD.CHAPTER_PREFIX)}) OR regexp_matches(t, {quote(HD.NUMERAL_PREFIX)}) THEN '기타' END AS ch,
    CASE WHEN NOT is_h THEN NULL WHEN c <> '' AND (nt = {norm_chapter('c')} OR nt IN ({norm_chapter('c')} || '수립', {norm_chapter('c')} || '설계'))
         THEN '' ELSE t END AS se FROM events),
carried AS (SELECT doc_id, page_no, i, last_value(ch IGNORE NULLS) OVER w AS ch, last_value(se IGNORE NULLS) OVER w AS se
    FROM sets WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
chaptered AS MATERIALIZED (SELECT doc_id, page_no, coalesce(ch, '기타') AS chapter_title, coalesce(se, '') AS section_title,
    coalesce(ch, '기타') || CASE WHEN trim(coalesce(se, '')) IN ('', coalesce(ch, '기타')) THEN '' ELSE ' > ' || trim(se) END AS heading_path
    FROM carried QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i DESC) = 1)
"""
