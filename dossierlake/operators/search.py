"""Hybrid search: keyword candidates, hashed-vector rescoring, fusion, boosts, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import labels
from dossierlake.functions.text import first_filled, text_or_empty, trim_snippet
from dossierlake.functions.tokens import coverage, matched_tokens, missing_tokens, unique_tokens
from dossierlake.session import checkpoint
from dossierlake.operators import batch as B, keyword as KW, ranking as R, vectors as V

# Everything a token of the query may cover.
HAYSTACK_COLUMNS = (
    "chunk_text", "keywords", "domain_keywords", "chapter_title", "canonical_chapter_title",
    "canonical_section_title", "canonical_subsection_title", "canonical_heading_path", "raw_heading_path",
    "normalized_chapter_title", "section_title", "normalized_section_title", "heading_path",
    "normalized_heading_path", "table_headers", "table_row_text", "parent_context", "document_title",
    "project_name",
)


# The columns in which a token makes a row a candidate.
CANDIDATE_COLUMNS = (
    "chunk_text", "keywords", "chapter_title", "section_title", "heading_path", "document_title", "project_name",
)


def candidate_text(columns: list[str]) -> Column:
    """the candidate columns as they are, lower-cased; no token spans two of them."""
    return F.lower(F.concat_ws("\n", *[text_or_empty(c) for c in CANDIDATE_COLUMNS if c in columns]))


def row_haystack(columns: list[str]) -> Column:
    return KW.haystack(*[c for c in HAYSTACK_COLUMNS if c in columns])


def apply_filters(rows: DataFrame, filters: dict | None) -> DataFrame:
    """Every filter holds for the whole row, whichever token matched."""
    filters = filters or {}
    if filters.get("document_type"):
        rows = rows.filter(F.col("document_type") == filters["document_type"])
    if filters.get("path_prefixes"):
        rows = rows.filter(KW.under_prefixes(F.col("file_path"), filters["path_prefixes"]))
    if filters.get("chapter_norms"):
        rows = rows.filter(KW.in_chapter(filters["chapter_norms"]))
    return rows


def with_item_columns(items: DataFrame, body: str, scope: dict | None, dimensions: int = V.DIMENSIONS) -> DataFrame:
    """What a result needs whichever query found it, computed once per item."""
    scope = scope or {}
    boost = R.scope_factor(
        scope.get("scope"), R.boost_haystack(items.columns), F.col("file_path"), scope.get("report", []),
        scope.get("proposal", []), scope.get("report_rules", R.REPORT_BOOSTS), scope.get("proposal_rules", R.PROPOSAL_BOOSTS),
    )
    return items.withColumns({"item_cells": V.sparse_cells(body, dimensions), "scope_boost": boost})


def rank_candidates(
    rows: DataFrame, key: str, k: int, weights: tuple[float, float] = (R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT)
) -> DataFrame:
    """R3, R5-R8 over bounded candidate sets (query_id, key, keyword_score, item and query columns).

    One exchange brings the at most max(2k, 40) rows of a query together for the two
    scalings and the cut.
    """
    cosine = V.cells_cosine(F.col("item_cells"), F.col("query_cells"))
    rows = rows.withColumn("cosine", F.greatest(cosine, F.lit(0.0))).drop("item_cells", "query_cells")
    rows = R.normalise_by_max(rows, "cosine", "query_id", "vector_score").withColumn(
        "recency_boost", R.recency_factor(F.col("file_mtime"), "query_id")
    )
    base = F.round(R.mean_score(F.col("keyword_score"), F.col("vector_score"), *weights), KW.SCORE_DIGITS)
    boosted = rows.withColumn(
        "score", F.round(base * F.col("scope_boost") * F.col("recency_boost"), KW.SCORE_DIGITS)
    ).drop("cosine", "scope_boost", "recency_boost")
    return KW.top_rows_per(boosted, "query_id", "score", key, k)


def search(
    rows: DataFrame, query: str, k: int = 20, key: str = "chunk_id", body: str = "embedding_text",
    filters: dict | None = None, scope: dict | None = None,
    weights: tuple[float, float] = (R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT), dimensions: int = V.DIMENSIONS,
) -> DataFrame:
    """R8 for one query: one scan with top-k, then everything runs on at most max(2k, 40) rows."""
    filtered = apply_filters(rows, filters)
    scored = KW.coverage_scores(filtered, query, row_haystack(rows.columns), candidate_text(rows.columns), positive=False)
    top = with_item_columns(KW.best_rows(scored, "keyword_score", key, KW.candidate_limit(k)), body, scope, dimensions)
    asked = top.withColumns({
        "query_id": F.lit(0), "query_text": F.lit(query), "query_cells": KW.one_value(rows, V.sparse_cells(F.lit(query), dimensions)),
    })
    return rank_candidates(asked, key, k, weights)


def search_batch(
    rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "chunk_id", body: str = "embedding_text",
    filters: dict | None = None, scope: dict | None = None,
    weights: tuple[float, float] = (R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT), dimensions: int = V.DIMENSIONS,
) -> DataFrame:
    """R8 for a table of queries (query_id, query_text) in one plan.

    Favourite texts are candidates of many queries: each is embedded once, then joined.
    """
    filtered = apply_filters(rows, filters)
    top = B.coverage_top(
        filtered, key, row_haystack(rows.columns), queries, KW.candidate_limit(k), candidate_text(rows.columns))
    wanted = checkpoint(top.select("query_id", key, "keyword_score"))
    items = with_item_columns(filtered.join(wanted.select(key).distinct(), key, "left_semi"), body, scope, dimensions)
    asked = queries.withColumn("query_cells", V.sparse_cells("query_text", dimensions))
    return rank_candidates(wanted.join(items, key).join(asked, "query_id"), key, k, weights)


def result_rows(ranked: DataFrame, query: Column) -> DataFrame:
    """Matched and missing tokens, coverage, snippet and page label of each result."""
    columns = [c for c in ranked.columns]
    ranked = ranked.withColumns({"query_terms": unique_tokens(query), "hay": row_haystack(columns)})
    rows = ranked.withColumns({
        "matched_keywords": matched_tokens(F.col("query_terms"), F.col("hay")),
        "missing_keywords": missing_tokens(F.col("query_terms"), F.col("hay")),
        "matched_text": trim_snippet("chunk_text"),
        "display_page": first_filled(
            "display_page" if "display_page" in ranked.columns else F.lit(""),
            labels.display_page(F.col("chunk_text"), text_or_empty("page_no")),
        ),
    }).withColumn(
        "keyword_coverage",
        coverage(F.size("matched_keywords"), F.size("matched_keywords") + F.size("missing_keywords")),
    )
    return rows.drop("query_terms", "hay")
