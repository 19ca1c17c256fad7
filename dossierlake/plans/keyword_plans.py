"""Keyword retrieval and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import tokens as K
from dossierlake.operators import batch as B, keyword as KW, postings as P, substrings as SB
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.session import checkpoint, shared_folder
from dossierlake.sources.tables import corpus_documents, table

TOPIC = "entre nicht than ai"
HAY_SQL = f"lower({S.synonyms('text || chr(32) || document_title || chr(32) || project_name')})"


def benchmark_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def searchable(spark, sf_dir):
    return corpus_documents(spark, sf_dir).withColumnRenamed("text", "chunk_text")


def doc_haystack():
    return KW.haystack("chunk_text", "document_title", "project_name")


TOPIC_TERMS = f"{S.ordered_distinct(S.tokens(S.quote(TOPIC)))}"
SCORED_SQL = f"""scored AS (SELECT *, {HAY_SQL} AS hay FROM docs),
  cov AS (SELECT *, round(CAST(len(list_filter(q.terms, lambda t: contains(hay, t))) AS DOUBLE) / len(q.terms), 6)
            AS keyword_score FROM scored, (SELECT {TOPIC_TERMS} AS terms) q)"""


@register(
    "keyword_coverage_topk",
    f"""WITH {S.DOCS}, {SCORED_SQL}
    SELECT doc_id, keyword_score, CAST(row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS BIGINT) AS rank
    FROM cov WHERE keyword_score > 0 ORDER BY keyword_score DESC, doc_id LIMIT 40""",
    covers="R1, F1, W4, W5, X7, X18, X19",
)
def keyword_coverage_topk(spark, sf_dir):
    scored = KW.coverage_scores(searchable(spark, sf_dir), TOPIC, doc_haystack())
    top = KW.top_rows(scored.select("doc_id", "keyword_score"), "keyword_score", "doc_id", KW.candidate_limit(20))
    return KW.top_rows_per(top.withColumn("q", F.lit(0)), "q", "keyword_score", "doc_id", 40).select(
        "doc_id", "keyword_score", F.col("rank").cast("bigint").alias("rank")
    )


RARE = "onesen hahahe lyndre ndanding"
RARE_TERMS = S.ordered_distinct(S.tokens(S.quote(RARE)))


@register(
    "substring_index_search",
    f"""WITH {S.DOCS}, scored AS (SELECT doc_id, {HAY_SQL} AS hay FROM docs)
    SELECT doc_id, round(CAST(len(list_filter({RARE_TERMS}, lambda t: contains(hay, t))) AS DOUBLE) / len({RARE_TERMS}), 6) AS keyword_score
    FROM scored WHERE len(list_filter({RARE_TERMS}, lambda t: contains(hay, t))) > 0""",
    covers="F1, R1 over a substring index",
)
def substring_index_search(spark, sf_dir):
    """The corpus as a table of files with their filters; all matches of a query of rare words, found in the files that can have them."""
    folder = shared_folder(spark, "substrings")
    SB.add(searchable(spark, sf_dir), doc_haystack(), f"{folder}/rows", f"{folder}/filters", 32)
    rows = SB.candidates(spark, f"{folder}/rows", f"{folder}/filters", RARE)
    return KW.coverage_scores(rows, RARE, doc_haystack()).select("doc_id", "keyword_score")


@register(
    "matched_missing_keywords",
    f"""WITH {S.DOCS}, {SCORED_SQL}, u AS (SELECT *, {S.ordered_distinct(S.tokens(S.quote(TOPIC)))} AS ts FROM cov)
    SELECT doc_id, array_to_string(list_filter(ts, lambda t: contains(hay, t)), ',') AS matched,
           array_to_string(list_filter(ts, lambda t: NOT contains(hay, t)), ',') AS missing FROM u""",
    covers="X6, R9",
)
def matched_missing_keywords(spark, sf_dir):
    rows = searchable(spark, sf_dir).select("doc_id", doc_haystack().alias("hay"))
    rows = rows.withColumn("terms", KW.one_value(rows, K.unique_tokens(F.lit(TOPIC))))
    terms = F.col("terms")
    return rows.select(
        "doc_id",
        F.concat_ws(",", K.matched_tokens(terms, F.col("hay"))).alias("matched"),
        F.concat_ws(",", K.missing_tokens(terms, F.col("hay"))).alias("missing"),
    )


BATCH_COVERAGE_SQL = f"""
  q AS (SELECT item_id AS query_id, {S.ordered_distinct(S.tokens('text'))} AS terms FROM benchmark),
  hayd AS MATERIALIZED (SELECT doc_id, {HAY_SQL} AS hay FROM docs),
  allhits AS (SELECT query_id, doc_id, len(list_filter(terms, lambda t: contains(hay, t))) AS hits, len(terms) AS n
           FROM hayd, q)"""


@register(
    "batch_keyword_coverage",
    f"""WITH {S.DOCS}, {BATCH_COVERAGE_SQL}
    SELECT query_id, doc_id, CAST(hits AS BIGINT) AS hits, round(CAST(hits AS DOUBLE) / n, 6) AS keyword_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(hits AS DOUBLE) / n, 6) DESC, doc_id) AS BIGINT) AS rank
    FROM allhits WHERE hits > 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(hits AS DOUBLE) / n, 6) DESC, doc_id) <= 40""",
    covers="R1 over a table of queries, J6, X6",
)
def batch_keyword_coverage(spark, sf_dir):
    top = B.coverage_top(searchable(spark, sf_dir), "doc_id", doc_haystack(), benchmark_queries(spark, sf_dir), 40)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "bm25_topk",
    f"""WITH t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
    w AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM t),
    idx AS (SELECT token, doc_id, dl, count(*) AS tf FROM w GROUP BY ALL),
    lens AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT DISTINCT doc_id, dl FROM idx)),
    df AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
    q AS (SELECT item_id AS query_id, unnest(list_distinct({S.tokens('text')})) AS token FROM benchmark),
    s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE)
            * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS bm25, count(*) AS hits
          FROM q JOIN idx USING (token) JOIN df USING (token), lens GROUP BY query_id, doc_id),
    qn AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, bm25, CAST(rank AS BIGINT) AS rank,
           round(CAST(hits AS DOUBLE) / n_terms / rank, 6) AS score
    FROM r JOIN qn USING (query_id) WHERE rank <= 20""",
    covers="R2, F2, J2, W2",
)
def bm25_topk(spark, sf_dir):
    queries = benchmark_queries(spark, sf_dir)
    asked = checkpoint(queries.select("query_id", F.explode(K.unique_tokens("query_text")).alias("token")))
    found = P.postings(table(spark, sf_dir, "documents"), "doc_id", K.tokenize("text"), asked, places=False)
    top = P.bm25_top(found, "doc_id", asked, 20)
    sizes = queries.select("query_id", F.size(K.unique_tokens("query_text")).alias("term_count"))
    scored = KW.rank_discount(top.join(sizes, "query_id"), "rank", K.coverage(F.col("hits"), F.col("term_count")))
    return scored.select("query_id", "doc_id", "bm25", F.col("rank").cast("bigint").alias("rank"), "score")


HYPHENATED_SQL = r"""(SELECT item_id AS query_id, regexp_replace(text, '([A-Za-z]+) ([A-Za-z]+)', '\1-\2', 'g') AS text FROM benchmark)"""
FULLTEXT_SQL = f"""
    t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS toks FROM documents),
    w AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM t),
    lens AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t WHERE len(toks) > 0),
    q AS (SELECT query_id, unnest(list_distinct({S.tokens('text')})) AS token FROM {HYPHENATED_SQL}),
    ph AS (SELECT DISTINCT query_id, list_transform(regexp_extract_all(token, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS words FROM q),
    hits AS (
      SELECT words, w.doc_id, w.dl, w.pos FROM (SELECT DISTINCT words FROM ph WHERE len(words) = 1) JOIN w ON w.word = words[1]
      UNION ALL SELECT words, a.doc_id, a.dl, a.pos FROM (SELECT DISTINCT words FROM ph WHERE len(words) = 2)
        JOIN w a ON a.word = words[1] JOIN w b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.word = words[2]),
    idx AS (SELECT words, doc_id, dl, count(*) AS tf FROM hits GROUP BY ALL),
    df AS (SELECT words, count(*) AS df FROM idx GROUP BY words),
    s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE)
            * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS bm25, count(*) AS hits
          FROM ph JOIN idx USING (words) JOIN df USING (words), lens GROUP BY query_id, doc_id)"""


@register(
    "fulltext_phrase_topk",
    f"""WITH {FULLTEXT_SQL}
    SELECT query_id, doc_id, bm25, CAST(hits AS BIGINT) AS hits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS BIGINT) AS rank
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 20""",
    covers="F2, J2",
)
def fulltext_phrase_topk(spark, sf_dir):
    """Benchmark items with every other blank as a hyphen, so that most tokens are phrases of two words."""
    written = F.regexp_replace("query_text", "([A-Za-z]+) ([A-Za-z]+)", "$1-$2")
    queries = benchmark_queries(spark, sf_dir).select("query_id", F.explode(P.phrases(written)).alias("words"))
    phrases = checkpoint(queries.groupBy("words").agg(F.collect_set("query_id").alias("owners")).withColumn("phrase", F.monotonically_increasing_id()))
    wanted = phrases.select(F.explode("words").alias("token"))
    found = checkpoint(P.postings(table(spark, sf_dir, "documents"), "doc_id", P.words(F.coalesce("text", F.lit(""))), wanted))
    hits = P.phrase_postings(found, "doc_id", phrases)
    asked = phrases.select(F.explode("owners").alias("query_id"), F.col("phrase").cast("string").alias("token"))
    return P.bm25_top(hits, "doc_id", asked, 20).select("query_id", "doc_id", "bm25", "hits", F.col("rank").cast("bigint").alias("rank"))


@register(
    "doc_type_filter",
    f"""WITH {S.DOCS}, {SCORED_SQL}
    SELECT doc_id, keyword_score FROM cov WHERE keyword_score > 0 AND document_type = 'fr'
    ORDER BY keyword_score DESC, doc_id LIMIT 20""",
    covers="F3, F10",
)
def doc_type_filter(spark, sf_dir):
    rows = searchable(spark, sf_dir).filter(F.col("document_type") == "fr")
    scored = KW.coverage_scores(rows, TOPIC, doc_haystack()).select("doc_id", "keyword_score")
    return KW.top_rows(scored, "keyword_score", "doc_id", 20)


@register(
    "source_prefix_filter",
    f"""WITH {S.DOCS}
    SELECT project_name, document_type, CAST(count(*) AS BIGINT) AS documents FROM docs
    WHERE starts_with(file_path, 'src1') OR starts_with(file_path, 'source_1') OR starts_with(file_path, 'src7/fr')
    GROUP BY ALL""",
    covers="F4, F6, X23",
)
def source_prefix_filter(spark, sf_dir):
    scope = KW.scope_prefixes("all", ("src1\\", "source_1/"))
    rows = corpus_documents(spark, sf_dir).filter(KW.under_prefixes(F.col("file_path"), scope["active"] + ["src7\\fr"]))
    return rows.groupBy("project_name", "document_type").agg(F.count("*").cast("bigint").alias("documents"))


@register(
    "scoped_documents",
    f"""WITH {S.DOCS}
    SELECT 'proposal' AS scope, project_name, CAST(count(*) AS BIGINT) AS documents FROM docs WHERE starts_with(file_path, 'src1') GROUP BY ALL
    UNION ALL SELECT 'report', project_name, CAST(count(*) AS BIGINT) FROM docs WHERE starts_with(file_path, 'src4') GROUP BY ALL
    UNION ALL SELECT 'all', project_name, CAST(count(*) AS BIGINT) FROM docs WHERE starts_with(file_path, 'src1') OR starts_with(file_path, 'src4') GROUP BY ALL""",
    covers="F6: proposals, reports, both",
)
def scoped_documents(spark, sf_dir):
    rows, parts = corpus_documents(spark, sf_dir), []
    for asked in ("제안서", " Report ", "anything"):
        scope = KW.scope_prefixes(asked, ("src1/", "src4"))
        found = rows.filter(KW.under_prefixes(F.col("file_path"), scope["active"]))
        parts.append(found.groupBy("project_name").agg(F.count("*").cast("bigint").alias("documents")).select(F.lit(scope["scope"]).alias("scope"), "project_name", "documents"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register(
    "existence_probe",
    f"""WITH {S.DOCS}
    SELECT project_name, bool_or(contains(text, project_name || ' ') OR contains(text, 'Licensed under CC')) AS has_match FROM docs GROUP BY project_name""",
    covers="F7",
)
def existence_probe(spark, sf_dir):
    rows = corpus_documents(spark, sf_dir)
    matched = rows.filter(
        F.contains("text", F.concat("project_name", F.lit(" "))) | F.contains("text", F.lit("Licensed under CC"))).select("project_name").distinct()
    projects = rows.select("project_name").distinct()
    return projects.join(matched.withColumn("has_match", F.lit(True)), "project_name", "left").fillna(
        False, ["has_match"]
    )
