"""Table detection in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.text import bind, contains_any, count_contained, text_or_empty

# Terms that tell a table and its kind.
HEADER_TERMS = ("성명", "등급", "역할", "단가", "수량", "금액", "요구사항", "일정", "기간")
TABLE_TYPES = (
    ("staff", ("성명", "등급", "역할", "참여율", "주요경력", "투입인력", "참여인력")),
    ("cost", ("단가", "수량", "금액", "비용", "견적", "소요예산", "TCO")),
    ("requirement", ("요구사항", "요구ID", "요구 ID", "기능요건", "비기능")),
    ("schedule", ("일정", "기간", "착수", "완료", "단계", "로드맵")),
)
TITLE_TERMS = ("표", "Table", "목록", "내역", "현황")
TABLE_TEXT_CHARS = 1800
HEADER_CHARS = 400
TITLE_CHARS = 160


def looks_like_table(body: Column) -> Column:
    """Two lines with a cell bar, or two different header terms. `body` is cleaned text."""

    def laid_out(lines: Column) -> Column:
        barred = F.filter(lines, lambda l: F.contains(l, F.lit("|")))
        return (F.size(lines) >= 2) & ((F.size(barred) >= 2) | (count_contained(body, HEADER_TERMS) >= 2))

    # most texts have neither a bar nor a term, and are not split
    able = contains_any(body, ("|", *HEADER_TERMS))
    return F.when(~able, F.lit(False)).otherwise(bind(F.filter(F.split(body, "\n"), lambda l: F.trim(l) != ""), laid_out))


def table_type(hay: Column, kinds=TABLE_TYPES) -> Column:
    choice = None
    for kind, terms in kinds:
        hit = contains_any(hay, terms)
        choice = F.when(hit, F.lit(kind)) if choice is None else choice.when(hit, F.lit(kind))
    return choice.otherwise(F.lit("general"))


def with_table_columns(
    units: DataFrame, body: str = "unit_text", path: str = "canonical_heading_path", section: str = "section_title",
    kinds=TABLE_TYPES, title_terms=TITLE_TERMS,
) -> DataFrame:
    """table_type, table_title, table_headers, table_row_text; '' where the unit is no table."""
    is_table = looks_like_table(F.col(body))
    lines = F.split(F.col(body), "\n")
    hay = F.concat_ws(" ", text_or_empty(path), text_or_empty(section), F.col(body))
    named = F.get(F.filter(F.slice(lines, 1, 4), lambda l: contains_any(l, title_terms)), F.lit(0))
    fallback = F.trim(F.coalesce(F.nullif(text_or_empty(section), F.lit("")), text_or_empty(path)))
    flagged = units.withColumn("is_table", is_table)

    def only(value: Column) -> Column:
        return F.when(F.col("is_table"), value).otherwise(F.lit(""))

    return flagged.withColumns({
        "table_type": only(table_type(hay, kinds)),
        "table_title": only(F.substring(F.coalesce(named, fallback), 1, TITLE_CHARS)),
        "table_headers": only(F.substring(F.get(lines, F.lit(0)), 1, HEADER_CHARS)),
        "table_row_text": only(F.substring(body, 1, TABLE_TEXT_CHARS)),
    }).drop("is_table")
