"""Score fusion and boosts applied to first-stage candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions.text import contains_any, text_or_empty
from dossierlake.operators.keyword import SCORE_DIGITS, slash_form

# Fusion weights, boosts and their trigger terms.
KEYWORD_WEIGHT = 0.4
VECTOR_WEIGHT = 0.6
MAX_RECENCY_BOOST = 1.15
REPORT_ROOT_BOOST = 1.2
REPORT_BOOSTS = (
    (("목표모델", "목표 모델", "tomodel"), 1.45),
    (("현황분석", "현황 분석", "asis", "as-is"), 1.35),
    (("환경분석", "환경 분석"), 1.25),
    (("이행계획", "이행 계획", "로드맵", "roadmap"), 1.15),
)
PROPOSAL_BOOSTS = (
    (("기술 및 기능", "기술및 기능", "기술및기능", "기술 기능", "기술부문", "기능부문"), 1.5),
    (("목표모델", "목표 모델", "tomodel"), 1.35),
    (("현황분석", "현황 분석", "asis", "as-is"), 1.25),
)
BOOST_COLUMNS = (
    "file_path", "document_title", "document_type", "section_title", "chapter_title", "heading_path", "chunk_text",
)


def normalise_by_max(rows: DataFrame, score: str, group: str, out: str) -> DataFrame:
    """Divide by the best score of the query. Only bounded candidate sets come here."""
    best = F.max(score).over(Window.partitionBy(group))
    return rows.withColumn(out, F.coalesce(F.try_divide(F.col(score), best), F.lit(0.0)))


def mean_score(
    keyword: Column, vector: Column, keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT
) -> Column:
    """Weighted mean of both scores."""
    return keyword * keyword_weight + vector * vector_weight


def fuse(
    keyword: DataFrame, vector: DataFrame, keys: list[str], allow_vector_only: bool = True,
    keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT,
) -> DataFrame:
    """Full outer join of both score lists, missing side 0, weighted mean."""
    both = keyword.join(vector, keys, "full_outer").fillna(0.0, ["keyword_score", "vector_score"])
    if not allow_vector_only:
        both = both.filter(F.col("keyword_score") > 0)
    mean = mean_score(F.col("keyword_score"), F.col("vector_score"), keyword_weight, vector_weight)
    return both.withColumn("score", F.round(mean, SCORE_DIGITS))


def recency_factor(mtime: Column, group: str) -> Column:
    """1.0 for the oldest candidate up to 1.15 for the newest."""
    known = F.when(mtime > 0, mtime)
    scope = Window.partitionBy(group)
    oldest, newest = F.min(known).over(scope), F.max(known).over(scope)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(mtime - oldest, newest - oldest)))
    return F.when((mtime > 0) & (newest > oldest), 1.0 + (MAX_RECENCY_BOOST - 1.0) * share).otherwise(F.lit(1.0))


def boost_for(hay: Column, rules) -> Column:
    """Largest boost whose terms occur, at least 1."""
    return F.greatest(*[F.when(contains_any(hay, terms), F.lit(w)).otherwise(F.lit(1.0)) for terms, w in rules], F.lit(1.0))


def scope_factor(
    scope: str | None, hay: Column, path: Column, report_roots: list[str], proposal_roots: list[str],
    report_rules=REPORT_BOOSTS, proposal_rules=PROPOSAL_BOOSTS,
) -> Column:
    """Boost by scope; in the `all` scope the root a file lies under decides the rule set."""
    report, proposal = boost_for(hay, report_rules), boost_for(hay, proposal_rules)
    if scope == "report":
        return report
    if scope == "proposal":
        return proposal
    if scope != "all":
        return F.lit(1.0)

    def under(roots: list[str]) -> Column:
        hit = F.lit(False)
        for root in roots:
            hit = hit | F.startswith(slash_form(path), F.lit(root.replace("\\", "/").rstrip("/")))
        return hit

    return (
        F.when(under(report_roots), report * REPORT_ROOT_BOOST)
        .when(under(proposal_roots), proposal)
        .otherwise(F.lit(1.0))
    )


def boost_haystack(columns: list[str]) -> Column:
    present = [c for c in BOOST_COLUMNS if c in columns]
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in present]))
