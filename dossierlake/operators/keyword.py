"""Keyword retrieval by substring coverage, filters and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions.text import bind, text_or_empty
from dossierlake.functions.tokens import coverage, expand_synonyms, matched_tokens, query_terms
from dossierlake.session import checkpoint

# BM25 constants of the full-text index.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

SCORE_DIGITS = 6


def candidate_limit(top_k: int) -> int:
    """The first stage keeps twice the results, at least forty."""
    return max(top_k * 2, 40)


def haystack(*columns: Column | str) -> Column:
    """Everything a query token may hit, synonyms expanded, lower-cased."""
    return F.lower(expand_synonyms(F.concat_ws(" ", *[text_or_empty(c) for c in columns])))


def one_value(rows: DataFrame, value: Column) -> Column:
    """A constant expression evaluated once for the whole query, not once per row."""
    return rows.sparkSession.range(1).select(value.alias("value")).scalar()


def coverage_scores(rows: DataFrame, query: str, hay: Column, within: Column | None = None, positive: bool = True) -> DataFrame:
    """R1 for one query: a narrow scan that keeps rows with at least one token.

    Where the best rows are taken next, `positive` is better left to the rows taken: a filter here computes the score twice.
    F1: with `within` a row is a candidate only if a token occurs there; `hay` decides its score.
    """
    hits = bind(hay, lambda h: F.size(matched_tokens(F.col("query_terms"), h)))
    asked = rows.withColumn("query_terms", one_value(rows, query_terms(F.lit(query))))
    if within is not None:
        asked = asked.filter(bind(within, lambda h: F.exists("query_terms", lambda t: F.contains(h, t))))
    scored = asked.withColumn("keyword_score", F.round(coverage(hits, F.size("query_terms")), SCORE_DIGITS))
    return (scored.filter(F.col("keyword_score") > 0) if positive else scored).drop("query_terms")


def top_rows(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Best k rows; the unique key breaks ties."""
    return rows.orderBy(F.desc(score), F.asc(key)).limit(k)


def best_rows(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """W4 with positive scores, written down: what comes next sees k rows.

    A Python function above a limit makes Spark sort all rows and call the function on each; a checkpoint of k rows stops that.
    """
    return checkpoint(top_rows(rows, score, key, k)).filter(F.col(score) > 0)


def top_rows_per(rows: DataFrame, group: str, score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """W1, W4 for a batch: row_number <= k is pushed below the shuffle, so no group arrives whole."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def rank_discount(ranked: DataFrame, rank: str, cover: Column) -> DataFrame:
    """Reciprocal rank times coverage."""
    return ranked.withColumn("score", F.round(cover / F.col(rank), SCORE_DIGITS)).filter(F.col("score") > 0)


def slash_form(path: Column) -> Column:
    return F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def under_prefixes(path: Column, prefixes: list[str]) -> Column:
    """path starts with one of the prefixes, whichever slash either side uses."""
    cleaned = [p.replace("\\", "/").rstrip("/") for p in prefixes if p.strip()]
    if not cleaned:
        return F.lit(True)
    tests = [F.startswith(slash_form(path), F.lit(p)) for p in cleaned]
    return reduce(lambda a, b: a | b, tests)


# The heading columns of the chapter filter.
CHAPTER_COLUMNS = (
    "normalized_chapter_title",
    "canonical_chapter_title",
    "canonical_section_title",
    "canonical_subsection_title",
    "canonical_heading_path",
    "raw_heading_path",
    "normalized_heading_path",
)


def in_chapter(norms: list[str]) -> Column:
    """one of the chapter norms occurs in a heading column, spaces ignored."""
    tests = [
        F.contains(F.replace(text_or_empty(c), F.lit(" "), F.lit("")), F.lit(norm))
        for norm in norms if norm for c in CHAPTER_COLUMNS
    ]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def scope_prefixes(scope: str, roots: tuple[str, ...]) -> dict[str, list[str]]:
    """which roots a scope admits; the first root holds proposals, the second reports."""
    proposal, report = list(roots[:1]), list(roots[1:2])
    wanted = (scope or "").strip().lower()
    if wanted in ("proposal", "제안서") and proposal:
        return {"scope": "proposal", "active": proposal, "proposal": proposal, "report": []}
    if wanted in ("report", "보고서") and report:
        return {"scope": "report", "active": report, "proposal": [], "report": report}
    return {"scope": "all", "active": proposal + report, "proposal": proposal, "report": report}
