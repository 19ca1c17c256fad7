"""Hybrid search over whole documents: one query, scoped, and a table of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import keyword as KW, ranking as R, search as H
from dossierlake.plans import sqltext as S
from dossierlake.plans.keyword_plans import BATCH_COVERAGE_SQL, SCORED_SQL, TOPIC, benchmark_queries, searchable
from dossierlake.plans.registry import register
from dossierlake.plans.vector_plans import sparse_sql
from dossierlake.sources.tables import table

# A lexicon of corpus words in place of the Korean boost terms, so that the boosts fire here.
CORPUS_REPORT_RULES = ((("therin", "nicht"), 1.45), (("eaux",), 1.35), (("pour",), 1.25))
CORPUS_PROPOSAL_RULES = ((("than",), 1.5), (("und",), 1.35))


def hybrid_sql(candidates: str, queries: str, k: int, boost: str = "1.0::DOUBLE") -> str:
    """From cand(query_id, doc_id, keyword_score) and queries(key, body) to the fused top k."""
    return f"""
    cand AS MATERIALIZED ({candidates}),
    qv AS ({sparse_sql('key', 'body', queries)}),
    dv AS ({sparse_sql('doc_id', 'text', '(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM cand))')}),
    qn AS (SELECT key, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS n FROM qv GROUP BY key),
    dn AS (SELECT key, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS n FROM dv GROUP BY key),
    cs AS (SELECT query_id, doc_id, CAST(sum(qv.weight * dv.weight) AS DOUBLE) / (any_value(qn.n) * any_value(dn.n)) AS cosine
           FROM cand JOIN qv ON qv.key = query_id JOIN dv ON dv.key = doc_id AND dv.slot = qv.slot
           JOIN qn ON qn.key = query_id JOIN dn ON dn.key = doc_id GROUP BY query_id, doc_id),
    vs AS (SELECT query_id, doc_id, cosine / max(cosine) OVER (PARTITION BY query_id) AS vector_score FROM cs WHERE cosine > 0),
    fused AS (SELECT cand.query_id, doc_id, keyword_score, coalesce(vector_score, 0) AS vector_score,
                round(keyword_score * 0.4::DOUBLE + coalesce(vector_score, 0) * 0.6::DOUBLE, 6) AS base,
                file_mtime, {boost} AS boost
              FROM cand LEFT JOIN vs USING (query_id, doc_id) JOIN docs USING (doc_id)),
    rec AS (SELECT *, min(CASE WHEN file_mtime > 0 THEN file_mtime END) OVER (PARTITION BY query_id) AS oldest,
                   max(CASE WHEN file_mtime > 0 THEN file_mtime END) OVER (PARTITION BY query_id) AS newest FROM fused),
    fin AS (SELECT *, round(base * boost * CASE WHEN file_mtime > 0 AND newest > oldest THEN
              1.0::DOUBLE + (1.15::DOUBLE - 1.0::DOUBLE) * greatest(0, least(1, (file_mtime - oldest) / (newest - oldest)))
              ELSE 1.0::DOUBLE END, 6) AS score FROM rec),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fin)
    SELECT query_id, doc_id, keyword_score, round(vector_score, 6) AS vector_score, score, CAST(rank AS BIGINT) AS rank
    FROM top WHERE rank <= {k}"""


def final_columns(ranked):
    return ranked.select(
        F.col("query_id").cast("bigint").alias("query_id"), "doc_id", "keyword_score",
        F.round("vector_score", 6).alias("vector_score"), "score", F.col("rank").cast("bigint").alias("rank"),
    )


_ONE = f"(SELECT 0::BIGINT AS key, {S.quote(TOPIC)} AS body)"
_CAND = "SELECT 0::BIGINT AS query_id, doc_id, keyword_score FROM cov WHERE keyword_score > 0 {} ORDER BY keyword_score DESC, doc_id LIMIT 40"


@register(
    "hybrid_topic_search",
    f"WITH {S.DOCS}, {SCORED_SQL}, {hybrid_sql(_CAND.format(''), _ONE, 20)}",
    covers="R3, R5, R7, R8, J5, W1, W5",
)
def hybrid_topic_search(spark, sf_dir):
    ranked = H.search(searchable(spark, sf_dir), TOPIC, 20, key="doc_id", body="chunk_text")
    return final_columns(ranked)


def _boost_sql(rules):
    cases = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(h, {S.quote(t)})' for t in terms)} THEN {w}::DOUBLE ELSE 1.0::DOUBLE END"
        for terms, w in rules
    )
    return f"greatest({cases}, 1.0::DOUBLE)"


_BOOST_HAY = "lower(file_path || ' ' || document_title || ' ' || document_type || ' ' || text)"
@register(
    "scope_boost",
    f"""WITH {S.DOCS}
    SELECT doc_id, round({_boost_sql(CORPUS_REPORT_RULES)}, 6) AS report_boost,
           round({_boost_sql(CORPUS_PROPOSAL_RULES)}, 6) AS proposal_boost,
           round(CASE WHEN document_type = 'fr' AND starts_with(document_title, 'fr') THEN 1.2::DOUBLE * {_boost_sql(CORPUS_REPORT_RULES)}
                WHEN starts_with(document_title, 'en') THEN {_boost_sql(CORPUS_PROPOSAL_RULES)} ELSE 1.0::DOUBLE END, 6) AS all_boost
    FROM (SELECT *, {_BOOST_HAY} AS h FROM docs)""",
    covers="R6",
)
def scope_boost(spark, sf_dir):
    rows = searchable(spark, sf_dir)
    hay, title = R.boost_haystack(rows.columns), F.col("document_title")
    rules = {"report_rules": CORPUS_REPORT_RULES, "proposal_rules": CORPUS_PROPOSAL_RULES}
    return rows.select(
        "doc_id",
        F.round(R.scope_factor("report", hay, title, [], [], **rules), 6).alias("report_boost"),
        F.round(R.scope_factor("proposal", hay, title, [], [], **rules), 6).alias("proposal_boost"),
        F.round(R.scope_factor("all", hay, title, ["fr"], ["en"], **rules), 6).alias("all_boost"),
    )


@register(
    "recency_boost",
    """WITH t AS (SELECT o_orderkey, o_orderpriority, CAST(epoch(o_orderdate) AS DOUBLE) AS m FROM orders),
    b AS (SELECT o_orderpriority, min(m) AS oldest, max(m) AS newest FROM t WHERE m > 0 GROUP BY 1)
    SELECT o_orderkey, round(CASE WHEN m > 0 AND newest > oldest
             THEN 1.0::DOUBLE + 0.15::DOUBLE * (m - oldest) / (newest - oldest) ELSE 1.0::DOUBLE END, 6) AS boost
    FROM t JOIN b USING (o_orderpriority)""",
    covers="X13, A15",
)
def recency_boost(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.unix_timestamp("o_orderdate").cast("double").alias("m")
    )
    span = orders.filter(F.col("m") > 0).groupBy("o_orderpriority").agg(
        F.min("m").alias("oldest"), F.max("m").alias("newest")
    )
    share = (F.col("m") - F.col("oldest")) / (F.col("newest") - F.col("oldest"))
    boost = F.when(
        (F.col("m") > 0) & (F.col("newest") > F.col("oldest")), 1.0 + (R.MAX_RECENCY_BOOST - 1.0) * share
    ).otherwise(F.lit(1.0))
    return orders.join(span, "o_orderpriority").select("o_orderkey", F.round(boost, 6).alias("boost"))


@register(
    "scoped_hybrid_search",
    f"""WITH {S.DOCS}, {SCORED_SQL},
    {hybrid_sql(_CAND.format("AND document_type = 'en'"), _ONE, 20, _boost_sql(CORPUS_REPORT_RULES).replace('contains(h,', f'contains({_BOOST_HAY},'))}""",
    covers="R8 with F3 and R6",
)
def scoped_hybrid_search(spark, sf_dir):
    scope = {"scope": "report", "report_rules": CORPUS_REPORT_RULES}
    ranked = H.search(
        searchable(spark, sf_dir), TOPIC, 20, key="doc_id", body="chunk_text",
        filters={"document_type": "en"}, scope=scope,
    )
    return final_columns(ranked)


_BATCH_CAND = """SELECT query_id, doc_id, round(CAST(hits AS DOUBLE) / n, 6) AS keyword_score FROM allhits WHERE hits > 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(hits AS DOUBLE) / n, 6) DESC, doc_id) <= 40"""


@register(
    "batch_hybrid_search",
    f"""WITH {S.DOCS}, {BATCH_COVERAGE_SQL},
    {hybrid_sql(_BATCH_CAND, '(SELECT item_id AS key, text AS body FROM benchmark)', 20)}""",
    covers="R8 for many queries, G7 first half",
)
def batch_hybrid_search(spark, sf_dir):
    ranked = H.search_batch(
        searchable(spark, sf_dir), benchmark_queries(spark, sf_dir), 20, key="doc_id", body="chunk_text"
    )
    return final_columns(ranked)


_TERMS = S.ordered_distinct(S.tokens(S.quote(TOPIC)))


@register(
    "search_result_rows",
    f"""WITH {S.DOCS}, {SCORED_SQL}, hits AS (SELECT doc_id FROM cov WHERE keyword_score > 0 ORDER BY keyword_score DESC, doc_id LIMIT 20)
    SELECT doc_id, array_to_string(list_filter({_TERMS}, lambda t: contains(hay, t)), ',') AS matched_keywords,
           array_to_string(list_filter({_TERMS}, lambda t: NOT contains(hay, t)), ',') AS missing_keywords,
           round(CAST(len(list_filter({_TERMS}, lambda t: contains(hay, t))) AS DOUBLE) / len({_TERMS}), 6) AS keyword_coverage,
           {S.snippet('text')} AS matched_text
    FROM hits JOIN cov USING (doc_id)""",
    covers="R9, E6",
)
def search_result_rows(spark, sf_dir):
    scored = KW.coverage_scores(searchable(spark, sf_dir), TOPIC, H.row_haystack(searchable(spark, sf_dir).columns), positive=False)
    top = KW.best_rows(scored, "keyword_score", "doc_id", 20).withColumn("page_no", F.lit(1))
    rows = H.result_rows(top, F.lit(TOPIC))
    return rows.select(
        "doc_id", F.concat_ws(",", "matched_keywords").alias("matched_keywords"),
        F.concat_ws(",", "missing_keywords").alias("missing_keywords"),
        F.round("keyword_coverage", 6).alias("keyword_coverage"), "matched_text",
    )
