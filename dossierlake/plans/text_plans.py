"""Tokenizer, cleaning and small text functions over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import labels, text as T, tokens as K
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.sources.tables import corpus_documents, table


@register(
    "tokenize_counts",
    f"""WITH t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents)
    SELECT doc_id, CAST(len(toks) AS BIGINT) AS token_count,
           CAST(len(list_distinct(toks)) AS BIGINT) AS distinct_tokens,
           coalesce(toks[1], '') AS first_token, coalesce(toks[-1], '') AS last_token,
           md5(array_to_string(toks, ' ')) AS token_digest
    FROM t""",
    covers="X1-X5, P14 token_count",
)
def tokenize_counts(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", K.tokenize("text").alias("toks"))
    return tokens.select(
        "doc_id",
        F.size("toks").cast("bigint").alias("token_count"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("distinct_tokens"),
        F.coalesce(F.get("toks", F.lit(0)), F.lit("")).alias("first_token"),
        F.coalesce(F.try_element_at("toks", F.lit(-1)), F.lit("")).alias("last_token"),
        F.md5(F.concat_ws(" ", "toks")).alias("token_digest"),
    )


@register(
    "token_doc_freq",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents)
    SELECT token, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents
    FROM t GROUP BY token""",
    covers="A12, A13, S chunk_fts",
)
def token_doc_freq(spark, sf_dir):
    # Per document first, inside the row's own partition, so that a word in every document
    # reaches the shuffle once per partition and not once per occurrence.
    words = T.explode_rows(table(spark, sf_dir, "documents"), ["doc_id"], K.tokenize("text"), "token")
    per_document = words.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return per_document.groupBy("token").agg(
        F.sum("tf").cast("bigint").alias("occurrences"), F.count("*").cast("bigint").alias("documents")
    )


@register(
    "clean_text_stats",
    f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS body FROM documents)
    SELECT doc_id, CAST(length(body) AS BIGINT) AS clean_chars,
           CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS BIGINT) AS clean_lines,
           md5(body) AS clean_digest
    FROM c""",
    covers="P22",
)
def clean_text_stats(spark, sf_dir):
    cleaned = table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("body"))
    return cleaned.select(
        "doc_id",
        F.length("body").cast("bigint").alias("clean_chars"),
        F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("bigint").alias("clean_lines"),
        F.md5("body").alias("clean_digest"),
    )


@register(
    "snippet_trim",
    f"SELECT doc_id, {S.snippet('text')} AS snippet FROM documents",
    covers="P22",
)
def snippet_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_snippet("text").alias("snippet"))


@register(
    "evidence_sentence",
    f"SELECT doc_id, {S.sentence('text')} AS sentence FROM documents",
    covers="X20",
)
def evidence_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_sentence("text").alias("sentence"))


@register(
    "regex_amounts",
    f"""WITH s AS (SELECT doc_id, {S.squeeze('text')} AS body FROM documents)
    SELECT doc_id,
           regexp_extract(body, {S.quote(labels.AMOUNT)}) AS amount,
           regexp_extract(body, {S.quote(labels.QUANTITY)}) AS quantity,
           regexp_extract(body, {S.quote(labels.UNIT_PRICE)}) AS unit_price,
           regexp_extract(body, {S.quote(labels.EXPERIENCE_YEARS)}) AS years,
           regexp_extract(body, {S.quote(labels.NUMBER)}) AS first_number
    FROM s""",
    covers="X21",
)
def regex_amounts(spark, sf_dir):
    body = table(spark, sf_dir, "documents").select("doc_id", T.squeeze("text").alias("body"))
    return body.select(
        "doc_id",
        F.regexp_extract("body", labels.AMOUNT, 0).alias("amount"),
        F.regexp_extract("body", labels.QUANTITY, 0).alias("quantity"),
        F.regexp_extract("body", labels.UNIT_PRICE, 0).alias("unit_price"),
        F.regexp_extract("body", labels.EXPERIENCE_YEARS, 0).alias("years"),
        F.regexp_extract("body", labels.NUMBER, 0).alias("first_number"),
    )


_FOOTED = """CASE CAST(doc_id % 6 AS INT)
  WHEN 0 THEN concat(text, chr(10), '- ', CAST(doc_id % 977 + 1 AS {text}), ' -')
  WHEN 1 THEN concat(text, chr(10), 'Page ', CAST(doc_id % 977 + 1 AS {text}), chr(10), 'a footer line')
  WHEN 2 THEN concat(text, chr(10), 'III-', CAST(doc_id % 977 + 1 AS {text}))
  WHEN 3 THEN concat(CAST(doc_id % 977 + 1 AS {text}), ' / 999', chr(10), text)
  ELSE text END"""
_LABEL_CASES = " ".join(
    f"WHEN regexp_matches(x, {S.quote(p)}) THEN regexp_extract(x, {S.quote(p)}, 1)"
    for p in labels.PAGE_LABELS_ONE_GROUP[:4]
)
_ROMAN = S.quote(labels.PAGE_LABEL_ROMAN)
_PLAIN = S.quote(labels.PAGE_LABELS_ONE_GROUP[4])
_ONE_LABEL = f"""CASE WHEN length(x) > 30 THEN '' {_LABEL_CASES}
   WHEN regexp_matches(x, {_ROMAN}) THEN regexp_extract(x, {_ROMAN}, 1) || '-' || regexp_extract(x, {_ROMAN}, 2)
   WHEN regexp_matches(x, {_PLAIN}) THEN regexp_extract(x, {_PLAIN}, 1) ELSE '' END"""
_LABEL_SQL = f"""
    WITH l AS (SELECT id, list_filter(list_transform(string_split(replace(body, chr(1), ' '), chr(10)),
                 lambda x: {S.squeeze('x')}), lambda x: x <> '') AS ls FROM src),
    c AS (SELECT id, list_concat(list_reverse(ls[greatest(len(ls) - 11, 1):]), list_reverse(ls[1:4])) AS cand FROM l),
    m AS (SELECT id, list_filter(list_transform(cand, lambda x: {_ONE_LABEL}),
                 lambda y: y <> '' AND NOT regexp_matches(y, '^0+$')) AS found FROM c)
    SELECT id, coalesce(found[1], CAST(id AS VARCHAR)) AS display_page FROM m"""


@register(
    "display_page_label",
    _LABEL_SQL.replace("WITH l AS", f"WITH src AS (SELECT doc_id AS id, {_FOOTED.format(text='VARCHAR')} AS body FROM documents), l AS"),
    covers="P21",
)
def display_page_label(spark, sf_dir):
    """Four of six documents get a footer with a page number of their own."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        labels.display_page(F.expr(_FOOTED.format(text="STRING")), F.col("doc_id").cast("string")).alias("display_page"),
    )


@register(
    "project_document_ids",
    f"""WITH {S.DOCS}
    SELECT doc_id, project_id, document_id, document_title, file_path, document_type,
           CASE WHEN regexp_matches(lower(document_title), 'final|최종|완료') THEN 1 ELSE 0 END AS is_final
    FROM docs""",
    covers="P2, X14 ids, §1.3",
)
def project_document_ids(spark, sf_dir):
    docs = corpus_documents(spark, sf_dir)
    return docs.select(
        "doc_id", "project_id", "document_id", "document_title", "file_path", "document_type",
        labels.is_final("document_title").alias("is_final"),
    )


@register(
    "project_folder_parse",
    """WITH d AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1),
    f AS (SELECT c_custkey, concat_ws('_', strftime(latest + INTERVAL 20 YEAR, '%Y%m%d'), c_name, c_mktsegment, 'ISP') AS folder
          FROM customer JOIN d ON o_custkey = c_custkey),
    p AS (SELECT *, list_filter(string_split_regex(folder, '[_\\-\\s]+'), lambda x: x <> '') AS parts FROM f),
    y AS (SELECT *, list_transform(parts, lambda x:
            CASE WHEN regexp_full_match(x, '20\\d{2}') THEN x
                 WHEN regexp_full_match(x, '20\\d{6}') THEN substr(x, 1, 4)
                 WHEN regexp_full_match(x, '\\d{6}') THEN
                   CASE WHEN CAST(substr(x, 1, 2) AS INT) < 70 THEN '20' ELSE '19' END || substr(x, 1, 2)
                 ELSE '' END) AS years FROM p),
    z AS (SELECT *, coalesce(list_position(list_transform(years, lambda x: x <> ''), true), 0) AS ypos FROM y),
    r AS (SELECT *, list_filter(parts, lambda x, i: i <> ypos) AS rest FROM z)
    SELECT c_custkey, coalesce(years[ypos], '') AS year, coalesce(rest[1], '') AS client_name,
           CASE WHEN len(rest) > 1 THEN array_to_string(rest[2:], ' ') ELSE folder END AS project_name,
           coalesce(list_filter(rest[2:], lambda x: list_contains(['isp','ismp','bpr','pi','컨설팅','구축','운영'], lower(x)))[-1], '') AS business_type
    FROM r""",
    covers="P1, P3",
)
def project_folder_parse(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    stamp = F.date_format(F.add_months("latest", 240), "yyyyMMdd")
    folder = F.concat_ws("_", stamp, F.col("c_name"), F.col("c_mktsegment"), F.lit("ISP"))
    joined = customer.join(latest, F.col("o_custkey") == F.col("c_custkey"))
    parsed = joined.select("c_custkey", labels.parse_project_folder(folder).alias("p"))
    return parsed.select("c_custkey", "p.year", "p.client_name", "p.project_name", "p.business_type")


_DOCUMENT_RULES = " ".join(
    f"WHEN contains(lower(n), {S.quote(term)}) THEN {S.quote(kind)}" for term, kind in labels.DOCUMENT_TYPE_RULES
)


@register(
    "document_type_rules",
    f"""WITH n AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '_RFP.docx' WHEN 1 THEN '_제안서_최종.pdf'
                  WHEN 2 THEN '_요구사항정의서.pptx' ELSE '_memo.pdf' END AS n FROM pages)
    SELECT page_id, CASE {_DOCUMENT_RULES} ELSE '기타 산출물' END AS document_type,
           CASE WHEN regexp_matches(lower(n), 'final|최종|완료') THEN 1 ELSE 0 END AS is_final FROM n""",
    covers="P2",
)
def document_type_rules(spark, sf_dir):
    kind = F.col("page_id") % 4
    name = F.concat(
        "url",
        F.when(kind == 0, "_RFP.docx").when(kind == 1, "_제안서_최종.pdf").when(kind == 2, "_요구사항정의서.pptx").otherwise("_memo.pdf"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", labels.document_type(name).alias("document_type"), labels.is_final(name).alias("is_final")
    )


_VERSION = S.quote("(?i)(?:rev\\.?\\s*\\d+(?:[._-]\\d+)*|v(?:er(?:sion)?)?\\.?\\s*\\d+(?:[._-]\\d+)*|최종|완료|수정|사본|copy|final)")


@register(
    "latest_version",
    f"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            trim(regexp_replace(lower(url), '[\\s._\\-()\\[\\]{{}}]+', ' ', 'g'), ' '),
            {_VERSION}, ' ', 'g'), '(?:20\\d{{2}}[._ -]?\\d{{2}}[._ -]?\\d{{2}}|20\\d{{6}}|\\d{{6,8}})', ' ', 'g'),
            '\\b\\d+(?:[._-]\\d+)*\\b', ' ', 'g'), '[\\s._\\-()\\[\\]{{}}]+', ' ', 'g') AS stem FROM pages),
    k AS (SELECT page_id, url, coalesce(nullif(array_to_string(list_filter({S.tokens('stem')}, lambda t:
            NOT list_contains(['보고서','제안서','최종','수정','사본'], t)), ' '), ''), trim(lower(url))) AS canonical_key FROM p)
    SELECT canonical_key, max(page_id) AS page_id, CAST(count(*) AS BIGINT) AS versions FROM k GROUP BY canonical_key""",
    covers="P4, A14, W6",
)
def latest_version(spark, sf_dir):
    keyed = table(spark, sf_dir, "pages").select(
        "page_id", "url", labels.canonical_key(F.col("url")).alias("canonical_key")
    )
    return keyed.groupBy("canonical_key").agg(
        F.max_by("page_id", "page_id").alias("page_id"), F.count("*").cast("bigint").alias("versions")
    )
