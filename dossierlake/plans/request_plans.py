"""Request documents: the corpus documents and benchmark passages read as requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions.text import explode_rows, trim_snippet
from dossierlake.functions.tokens import matched_tokens, unique_tokens
from dossierlake.operators import batch as B, keyword as KW, requests as RQ
from dossierlake.plans import sqltext as S
from dossierlake.plans.ingest_plans import KEYWORDS_SQL
from dossierlake.plans.keyword_plans import HAY_SQL, doc_haystack, searchable
from dossierlake.plans.registry import register
from dossierlake.sources.tables import table

# Groups of corpus words so that every branch of requirement extraction fires on the corpus.
CORPUS_REQUESTS = RQ.RequestLexicon(
    headings=("anea", "nicht", "eaux le"), content=("thing", "erung", "oument", "cion"), actions=("tion", "ung", "ent"),
    administrative=("thble", "stteen", "ouier"), noise=("zz", "qq"), priority=(("EN", ("the", "and")), ("FR", ("que",)), ("DE", ("der",))),
)


def corpus_requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("sections", RQ.requirement_sections(F.col("text"), CORPUS_REQUESTS))


_COMPACT = f"translate(lower({{}}), {S.quote(RQ.COMPACT_MARKS)}, '')"
_LX = CORPUS_REQUESTS
_TITLE = f"""(length({{b}}) <= 32 AND NOT {S.contains_any('{b}', _LX.actions)} AND NOT {S.contains_any('{b}', RQ.TITLE_MARKERS)})""".replace(
    "{b}", f"trim(regexp_replace(line, {S.quote(RQ.SECTION_NUMBER)}, ''), ' ')"
)
SECTIONS_SQL = f"""
rl AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split({S.clean('text')}, chr(10)), lambda x: x <> '') AS ls FROM documents)),
rj AS (SELECT *, {_COMPACT.format('line')} AS c, regexp_matches(line, {S.quote(RQ.MONEY_OR_PERIOD)}) AS money FROM rl),
rk AS (SELECT *, {S.contains_any('c', RQ._compacts(_LX.headings))} AS heading, {S.contains_any('c', RQ._compacts(_LX.content))} AS content,
    {_TITLE} AS title FROM rj),
rm AS MATERIALIZED (SELECT doc_id, i, line, c, heading, title, (money AND NOT content) OR {S.contains_any('c', RQ._compacts(_LX.administrative))} AS noise,
    CASE WHEN heading THEN 4 ELSE 0 END + CASE WHEN content THEN 3 ELSE 0 END + CASE WHEN {S.contains_any('line', _LX.actions)} THEN 1 ELSE 0 END
    - CASE WHEN money THEN 3 ELSE 0 END - CASE WHEN title THEN 1 ELSE 0 END AS score,
    coalesce(lead(heading) OVER (PARTITION BY doc_id ORDER BY i), false) AS next_heading FROM rk),
rw AS (
    SELECT doc_id, 0::BIGINT AS i, 0 AS ctx, 0 AS n, false AS took FROM (SELECT DISTINCT doc_id FROM rm)
    UNION ALL
    SELECT doc_id, i, CASE WHEN NOT noise AND (n + CAST(take AS INT)) > 0 AND next_heading THEN greatest(base, 4) ELSE base END,
        n + CAST(take AS INT), take FROM (
      SELECT rm.doc_id, rm.i, rw.n, rm.noise, rm.next_heading,
        NOT rm.noise AND ((heading AND NOT title AND score >= 2) OR (NOT heading AND ctx > 0 AND score >= 1) OR (NOT heading AND score >= 3)) AS take,
        CASE WHEN rm.noise THEN greatest(0, ctx - 1) WHEN heading THEN 6 WHEN ctx > 0 AND score >= 1 THEN ctx - 1 ELSE ctx END AS base
      FROM rw JOIN rm ON rm.doc_id = rw.doc_id AND rm.i = rw.i + 1 WHERE rw.n < 12)),
rt AS (SELECT rw.doc_id, rw.i, line, substr(c, 1, 120) AS ck FROM rw JOIN rm USING (doc_id, i) WHERE took),
ru AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ck ORDER BY i) AS f FROM rt WHERE ck <> ''),
sections AS MATERIALIZED (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number FROM ru WHERE f = 1)
"""


@register(
    "requirement_sections",
    f"WITH RECURSIVE {SECTIONS_SQL} SELECT doc_id, CAST(number AS BIGINT) AS number, line AS section FROM sections",
    covers="G1, G2, W7",
)
def requirement_sections(spark, sf_dir):
    rows = corpus_requests(spark, sf_dir)
    numbered = rows.select("doc_id", F.posexplode_outer("sections").alias("at", "section")).filter(F.col("section").isNotNull())
    return numbered.select("doc_id", (F.col("at") + 1).cast("bigint").alias("number"), "section")

ITEM_SECTIONS_SQL = SECTIONS_SQL.replace("FROM documents)", "FROM (SELECT item_id AS doc_id, text FROM benchmark))")

_LABELS = (("and", "than"), ("der", "que"), ("with", "nicht", "eaux"))


def _label_sql(labels) -> str:
    parts = ", ".join(
        f"nullif(substr(trim(regexp_extract(text, {S.quote(label + chr(92) + 's*[,:]' + chr(92) + 's*(.+)')}, 1), ' '), 1, 120), '')" for label in labels
    )
    return f"coalesce({parts}, '')"


@register(
    "request_summary",
    f"""WITH RECURSIVE {SECTIONS_SQL},
    lx AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS ls FROM documents),
    lp AS (SELECT *, list_position(list_transform(ls, lambda l: {S.contains_any('l', _LABELS[2])}), true) AS hit FROM lx),
    sn AS (SELECT doc_id, count(*) AS n, string_agg(line, '|' ORDER BY number) FILTER (WHERE number <= 5) AS tasks FROM sections GROUP BY doc_id),
    pu AS (SELECT *, CASE WHEN coalesce(hit, 0) = 0 THEN '' ELSE array_to_string(ls[hit:hit + 3], ' ') END AS pr FROM lp)
    SELECT doc_id, CASE WHEN contains(lower(text), 'isp') THEN 'ISP' WHEN contains(lower(text), 'pi') THEN 'PI' WHEN contains(lower(text), 'un') THEN 'UN' ELSE '' END AS business_type,
      {S.snippet('pr', 400)} AS purpose, CAST(coalesce(n, 0) AS BIGINT) AS section_count, coalesce(tasks, '') AS main_tasks,
      {S.snippet('text', 900)} AS summary_text FROM pu LEFT JOIN sn USING (doc_id)""",
    covers="G5, S13",
)
def request_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = RQ.summarize(docs, "text", CORPUS_REQUESTS, _LABELS[0], _LABELS[1], _LABELS[2], ("ISP", "PI", "UN"))
    return rows.select(
        "doc_id", "business_type", "purpose", F.size("sections").cast("bigint").alias("section_count"),
        F.array_join("main_tasks", "|").alias("main_tasks"), "summary_text",
    )


_VALID = f"""(length({_COMPACT.format('w')}) BETWEEN 2 AND 20 AND NOT regexp_matches(w, {S.quote(RQ.MONEY_OR_PERIOD)})
    AND NOT regexp_matches({_COMPACT.format('w')}, '^\\d+$') AND NOT {S.contains_any(_COMPACT.format('w'), RQ._compacts(_LX.noise))})"""
_PRIORITY = ", ".join(
    f"CASE WHEN {S.contains_any('low', [v.lower() for v in vs])} THEN {{'w': {S.quote(word)}, 'o': {i}}} END" for i, (word, vs) in enumerate(_LX.priority)
)
REQUEST_KEYWORDS_SQL = f"""{SECTIONS_SQL},
rs AS MATERIALIZED (SELECT doc_id, string_agg(line, chr(10) ORDER BY number) AS joined FROM sections GROUP BY doc_id),
so AS MATERIALIZED (SELECT doc_id AS id, joined, coalesce(joined, {S.clean('text')}) AS source FROM documents LEFT JOIN rs USING (doc_id)),
ksrc AS (SELECT id, source AS body, '' AS context FROM so),
{KEYWORDS_SQL.replace('<= 12)', '<= 30)')},
b1 AS (SELECT id, p.w AS w, 24 AS v, p.o AS o FROM (SELECT id, unnest(list_filter([{_PRIORITY}], lambda b: b IS NOT NULL)) AS p FROM (SELECT id, lower(source) AS low FROM so))),
b2 AS (SELECT id, keyword AS w, 12 AS v, place + 1000 AS o FROM keywords),
b3 AS (SELECT id, w, CASE WHEN {S.contains_any(_COMPACT.format('w'), RQ._compacts(tuple(_LX.content) + tuple(_LX.actions)))} THEN 4 ELSE 1 END AS v, pos + 999999 AS o
    FROM (SELECT id, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM (
       SELECT doc_id AS id, flatten(list({S.tokens('line')} ORDER BY number)) AS ts FROM sections GROUP BY doc_id))),
bg AS (SELECT id, w, sum(v) AS votes, min(o) AS o FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) WHERE {_VALID} GROUP BY id, w),
br AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, o) AS p FROM bg),
bd AS (SELECT *, row_number() OVER (PARTITION BY id, {_COMPACT.format('w')} ORDER BY p) AS f FROM br WHERE p <= 30),
request_keywords AS MATERIALIZED (SELECT id AS doc_id, w AS keyword, CAST(votes AS BIGINT) AS votes, CAST(row_number() OVER (PARTITION BY id ORDER BY p) AS BIGINT) AS place FROM bd WHERE f = 1
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) <= 15)"""


@register(
    "request_keywords",
    f"WITH RECURSIVE {REQUEST_KEYWORDS_SQL} SELECT * FROM request_keywords",
    covers="G3, G4",
)
def request_keywords(spark, sf_dir):
    return RQ.request_keywords(corpus_requests(spark, sf_dir), "doc_id", "sections", "text", lexicon=CORPUS_REQUESTS)


_OF_REQUESTS = REQUEST_KEYWORDS_SQL[len(SECTIONS_SQL):].lstrip(",\n")
_OF_PARTS = _OF_REQUESTS.replace("FROM documents LEFT JOIN", "FROM parts LEFT JOIN").replace(
    "<= 30)", f"<= {2 * RQ.REQUIREMENT_KEYWORDS})").replace("<= 15", f"<= {RQ.REQUIREMENT_KEYWORDS}")
WEIGHTED_SQL = f"""{REQUEST_KEYWORDS_SQL},
parts AS (SELECT doc_id || '/' || (number - 1) AS doc_id, doc_id AS own, number - 1 AS number, line AS text, line FROM sections
    WHERE number <= {RQ.REQUIREMENT_QUERIES}),
of_parts AS (WITH sections AS (SELECT doc_id, line, 1 AS number FROM parts), {_OF_PARTS}
    SELECT doc_id AS part, string_agg(keyword, ' ' ORDER BY place) AS query_text FROM request_keywords WHERE place <= 6 GROUP BY doc_id),
wq AS (
    SELECT doc_id, (place - 1) // {RQ.KEYWORDS_PER_QUERY} AS position, string_agg(keyword, ' ' ORDER BY place) AS query_text,
      {RQ.KEYWORD_QUERY_WEIGHT}::DOUBLE AS weight FROM request_keywords GROUP BY 1, 2
    UNION ALL SELECT own, number + 100, query_text, {RQ.REQUIREMENT_QUERY_WEIGHT}::DOUBLE FROM of_parts JOIN parts ON part = parts.doc_id)"""


@register(
    "rfp_weighted_queries",
    f"""WITH RECURSIVE {WEIGHTED_SQL}
    SELECT doc_id, CAST(position AS BIGINT) AS position, query_text, weight FROM wq WHERE trim(query_text) <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id, query_text ORDER BY position) = 1""",
    covers="G6",
)
def rfp_weighted_queries(spark, sf_dir):
    return RQ.weighted_queries(corpus_requests(spark, sf_dir), "doc_id", "sections", "text", CORPUS_REQUESTS)


def passage_queries(spark, sf_dir):
    """Every benchmark passage as a request: its tokens in fours, earlier fours weigh more."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", unique_tokens("text").alias("tokens"))
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("tokens") / 4).cast("int") - 1, F.lit(0))),
        lambda g: F.struct(g.alias("part"), F.concat_ws(" ", F.slice("tokens", g * 4 + 1, 4)).alias("text")),
    )
    parts = explode_rows(rows, ["item_id"], groups, "g")
    return parts.select(
        "item_id", (F.col("item_id") * 1000 + F.col("g.part")).alias("query_id"), F.col("g.text").alias("query_text"),
        F.when(F.col("g.part") == 0, RQ.KEYWORD_QUERY_WEIGHT).when(F.col("g.part") == 1, RQ.REQUIREMENT_QUERY_WEIGHT)
        .otherwise(0.8).alias("weight"),
    )


FUSION_SQL = f"""{S.DOCS},
pt AS (SELECT item_id, {S.ordered_distinct(S.tokens('text'))} AS ts FROM benchmark),
pq AS (SELECT item_id, g AS part, ts[g * 4 + 1:g * 4 + 4] AS four FROM (SELECT item_id, ts, unnest(range(0, greatest(CAST(ceil(len(ts) / 4.0) AS BIGINT), 1))) AS g FROM pt)),
pw AS (SELECT item_id, part, {S.ordered_distinct(S.tokens("array_to_string(four, ' ')"))} AS terms, CASE part WHEN 0 THEN 1.45::DOUBLE WHEN 1 THEN 1.35::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM pq),
hd AS MATERIALIZED (SELECT doc_id, {HAY_SQL} AS hay FROM docs),
ph AS (SELECT item_id, part, weight, doc_id, round(CAST(len(list_filter(terms, lambda t: contains(hay, t))) AS DOUBLE) / len(terms), 6) AS s FROM hd, pw WHERE len(terms) > 0),
pk AS (SELECT * FROM ph WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY item_id, part ORDER BY s DESC, doc_id) <= 20),
best AS MATERIALIZED (SELECT item_id, doc_id, max(round(s * weight, 6)) AS score FROM pk GROUP BY item_id, doc_id)"""


def fused_results(spark, sf_dir):
    queries = passage_queries(spark, sf_dir)
    top = B.coverage_top(searchable(spark, sf_dir), "doc_id", doc_haystack(), queries.select("query_id", "query_text"), 20)
    with_request = top.join(queries.select("query_id", "item_id", "weight"), "query_id")
    return RQ.fuse_queries(with_request, "item_id", "doc_id", "keyword_score", "weight")


@register(
    "multi_query_fusion",
    f"WITH {FUSION_SQL} SELECT item_id, doc_id, score FROM best",
    covers="G7, A9, U4",
)
def multi_query_fusion(spark, sf_dir):
    return fused_results(spark, sf_dir)


@register(
    "project_aggregate",
    f"""WITH {FUSION_SQL},
    tj AS (SELECT b.item_id, b.doc_id, b.score, project_id, project_name, document_id, document_title, list_filter(ts, lambda t: contains(lower(text), t)) AS mk
        FROM best b JOIN docs USING (doc_id) JOIN pt USING (item_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, project_id ORDER BY score DESC, doc_id) AS n FROM tj),
    pj AS (SELECT item_id, project_id, any_value(project_name) AS project_name, CAST(round(CAST(avg(score) FILTER (WHERE n <= 5) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS similarity_score,
        string_agg(document_title, ', ' ORDER BY n) FILTER (WHERE n <= 5) AS related_documents,
        string_agg(CAST(pg AS VARCHAR), ',' ORDER BY pg) AS pages,
        string_agg(document_title || ' p.' || (doc_id % 7) || '에서 ' || coalesce(nullif(array_to_string(mk[1:5], ', '), ''), '핵심 키워드') || ' 관련 내용이 매칭됨', '|' ORDER BY n) FILTER (WHERE n <= 3) AS reasons
      FROM rk LEFT JOIN (SELECT DISTINCT item_id, project_id, min(doc_id) OVER (PARTITION BY item_id, project_id, doc_id % 7) AS doc_id, doc_id % 7 AS pg FROM tj WHERE doc_id % 7 > 0) d
        USING (item_id, project_id, doc_id) GROUP BY item_id, project_id)
    SELECT item_id, project_id, project_name, similarity_score, related_documents, coalesce(pages, '') AS pages, reasons,
      CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity_score DESC, project_id) AS BIGINT) AS rank
    FROM pj QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity_score DESC, project_id) <= 10""",
    covers="A7, G7, W1",
)
def project_aggregate(spark, sf_dir):
    docs = searchable(spark, sf_dir).withColumn("page_no", (F.col("doc_id") % 7).cast("int"))
    words = table(spark, sf_dir, "benchmark").select("item_id", unique_tokens("text").alias("tokens"))
    rows = fused_results(spark, sf_dir).join(docs, "doc_id").join(words, "item_id").withColumn("low", F.lower("chunk_text"))
    rows = rows.withColumn("matched_keywords", matched_tokens(F.col("tokens"), F.col("low"))).drop("low", "chunk_text")
    projects = RQ.aggregate_projects(rows, "item_id", "doc_id")
    return projects.select(
        "item_id", "project_id", "project_name", "similarity_score", "related_documents",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.array_join("matching_reasons", "|").alias("reasons"), F.col("rank").cast("bigint").alias("rank"),
    )


@register(
    "requirement_mapping",
    f"""WITH RECURSIVE {FUSION_SQL}, {ITEM_SECTIONS_SQL},
    rq0 AS (SELECT doc_id AS item_id, number, line AS requirement FROM sections WHERE number <= {RQ.REQUIREMENTS_SHOWN}),
    rq AS (SELECT * FROM rq0 UNION ALL SELECT item_id, 1 AS number, '확인 필요' AS requirement FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM rq0)),
    rs AS (SELECT b.item_id, b.doc_id, b.score, document_title, project_name, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id % 7 AS VARCHAR) END AS page,
        trim(regexp_replace({S.snippet('text')}, '\\s+', ' ', 'g')) AS flat, document_title || ' ' || project_name || ' ' || {S.snippet('text')} AS seen FROM
        (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20) b JOIN docs USING (doc_id)),
    tk AS (SELECT *, CASE WHEN requirement = '확인 필요' THEN [] ELSE list_filter(list_distinct(string_split_regex(requirement, '\\s+')), lambda t: length(t) >= 2) END AS toks FROM rq),
    pr AS (SELECT rs.*, number, len(toks) AS n_toks, len(list_filter(toks, lambda t: contains(seen, t))) AS overlap,
        CASE WHEN length(flat) <= 180 THEN flat ELSE rtrim(substr(flat, 1, 179)) || '…' END AS evidence FROM tk JOIN rs USING (item_id)),
    bs AS (SELECT *, row_number() OVER (PARTITION BY item_id, number ORDER BY overlap DESC, score DESC, doc_id) AS place FROM pr WHERE overlap > 0 OR n_toks = 0)
    SELECT item_id, CAST(number AS BIGINT) AS number, requirement, doc_id, coalesce(document_title, '확인 필요') AS document_title, coalesce(project_name, '확인 필요') AS project_name,
      coalesce(page, '확인 필요') AS page, coalesce(nullif(evidence, ''), '확인 필요') AS evidence, coalesce(nullif(evidence, ''), '확인 필요') AS usage_point,
      CAST(overlap AS BIGINT) AS overlap, CAST(place AS BIGINT) AS place
    FROM rq LEFT JOIN (SELECT * FROM bs WHERE place <= 3) b USING (item_id, number)""",
    covers="G8, J10",
)
def requirement_mapping(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    shown = F.slice(RQ.requirement_sections(F.col("text"), CORPUS_REQUESTS), 1, RQ.REQUIREMENTS_SHOWN)
    lines = items.select("item_id", shown.alias("lines"))
    requirements = lines.select("item_id", F.posexplode_outer("lines").alias("at", "requirement")).select(
        "item_id", (F.coalesce("at", F.lit(0)) + 1).cast("bigint").alias("number"), "requirement")
    page = F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7).cast("string").alias("display_page")
    docs = searchable(spark, sf_dir).select(
        "doc_id", "document_title", "project_name", page, trim_snippet("chunk_text").alias("matched_text")
    )
    top = KW.top_rows_per(fused_results(spark, sf_dir), "item_id", "score", "doc_id", 20).drop("rank")
    mapped = RQ.map_requirements(requirements, top.join(docs, "doc_id"), "item_id", "doc_id")
    return mapped.select(
        "item_id", "number", "requirement", "doc_id", "document_title", "project_name", "page", "evidence", "usage_point",
        F.col("overlap").cast("bigint").alias("overlap"),
        F.col("place").cast("bigint").alias("place"),
    )
