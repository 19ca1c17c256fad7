"""Labels read from names and page text: page numbers, years, document types, amounts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierlake.functions.text import as_col, bind, contains_any, literal_array, squeeze, text_or_empty
from dossierlake.functions.tokens import tokenize

# Patterns and rules that decide the extracted labels.
AMOUNT = "[\\d,]+(?:\\.\\d+)?\\s*(?:원|천원|백만원|억원)"
QUANTITY = "\\d[\\d,]*(?:\\.\\d+)?\\s*(?:식|명|개|대|건|월|년|core|Core|GB|TB|EA)"
UNIT_PRICE = "단가\\s*[:：]?\\s*[\\d,]+(?:\\.\\d+)?\\s*(?:원|천원|백만원|억원)?"
EXPERIENCE_YEARS = "\\d+\\s*년\\s*(?:이상|초과|이내|미만|경력)?"
NUMBER = "\\d[\\d,]*(?:\\.\\d+)?"
PAGE_LABELS_ONE_GROUP = (
    "(?i)^(?:page|p\\.?)\\s*[-:]?\\s*(\\d{1,4})$",
    "^페이지\\s*(\\d{1,4})$",
    "^[-–—]\\s*(\\d{1,4})\\s*[-–—]$",
    "^(\\d{1,4})\\s*/\\s*\\d{1,4}$",
    "^(\\d{1,4})$",
)
PAGE_LABEL_ROMAN = "(?i)^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[IVXLCDM]+)\\s*[-–—]\\s*(\\d{1,4})$"
BUSINESS_TYPES = ("ISP", "ISMP", "BPR", "PI", "컨설팅", "구축", "운영")
DOCUMENT_TYPE_RULES = (
    ("제안요청서", "RFP"),
    ("rfp", "RFP"),
    ("제안서", "제안서"),
    ("보고서", "보고서"),
    ("회의록", "회의록"),
    ("요구사항", "요구사항정의서"),
    ("이행계획", "이행계획서"),
    ("목표모델", "목표모델"),
)
DEFAULT_DOCUMENT_TYPE = "기타 산출물"
FINAL_MARKS = ("final", "최종", "완료")
VERSION = "(?i)(?:rev\\.?\\s*\\d+(?:[._-]\\d+)*|v(?:er(?:sion)?)?\\.?\\s*\\d+(?:[._-]\\d+)*|최종|완료|수정|사본|copy|final)"
DATE = "(?:20\\d{2}[._ -]?\\d{2}[._ -]?\\d{2}|20\\d{6}|\\d{6,8})"
PUNCTUATION = "[\\s._\\-()\\[\\]{}]+"
VERSION_WORDS = ("보고서", "제안서", "최종", "수정", "사본")


def _page_label(line: Column) -> Column:
    choice = F.when(F.length(line) > 30, F.lit(""))
    for pattern in PAGE_LABELS_ONE_GROUP[:4]:
        choice = choice.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1))
    choice = choice.when(
        F.rlike(line, F.lit(PAGE_LABEL_ROMAN)),
        F.concat_ws("-", F.regexp_extract(line, PAGE_LABEL_ROMAN, 1), F.regexp_extract(line, PAGE_LABEL_ROMAN, 2)),
    )
    plain = PAGE_LABELS_ONE_GROUP[4]
    return choice.when(F.rlike(line, F.lit(plain)), F.regexp_extract(line, plain, 1)).otherwise(F.lit(""))


def display_page(body: Column, fallback: Column) -> Column:
    """Page label from the last twelve lines, then the first four, each read upwards."""
    lines = F.filter(
        F.transform(F.split(F.replace(text_or_empty(body), F.lit("\x01"), F.lit(" ")), "\n"), squeeze), lambda x: x != ""
    )

    def pick(ls: Column) -> Column:
        size = F.size(ls)
        tail = F.slice(ls, F.greatest(size - 11, F.lit(1)), F.lit(12))
        candidates = F.concat(F.reverse(tail), F.reverse(F.slice(ls, 1, 4)))
        found = F.filter(F.transform(candidates, _page_label), lambda y: (y != "") & ~F.rlike(y, F.lit("^0+$")))
        return F.coalesce(F.get(found, F.lit(0)), fallback, F.lit(""))

    return bind(lines, pick)


def year_of(token: Column) -> Column:
    """Four-digit year, or the year of a YYYYMMDD / YYMMDD date; '' otherwise."""
    century = F.when(F.substring(token, 1, 2) < "70", F.lit("20")).otherwise(F.lit("19"))
    return (
        F.when(F.rlike(token, F.lit("^20\\d{2}$")), token)
        .when(F.rlike(token, F.lit("^20\\d{6}$")), F.substring(token, 1, 4))
        .when(F.rlike(token, F.lit("^\\d{6}$")), F.concat(century, F.substring(token, 1, 2)))
        .otherwise(F.lit(""))
    )


def parse_project_folder(folder: Column) -> Column:
    """First date part -> year, first other part -> client, the rest -> project name."""
    parts = F.filter(F.split(folder, "[_\\-\\s]+"), lambda p: p != "")

    def assemble(ps: Column) -> Column:
        years = F.transform(ps, year_of)
        year = F.get(F.filter(years, lambda y: y != ""), F.lit(0))
        year_at = F.array_position(F.transform(years, lambda y: y != ""), F.lit(True))
        rest = F.filter(ps, lambda p, i: (i + 1) != year_at)
        names = F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))
        kinds = F.filter(names, lambda p: F.lower(p).isin(*[b.lower() for b in BUSINESS_TYPES]))
        return F.struct(
            F.coalesce(year, F.lit("")).alias("year"),
            F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("client_name"),
            F.when(F.size(names) > 0, F.concat_ws(" ", names)).otherwise(folder).alias("project_name"),
            F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.lit("")).alias("business_type"),
        )

    return bind(parts, assemble)


def document_type(file_name: Column | str) -> Column:
    """First matching rule on the lower-cased name."""
    name = F.lower(as_col(file_name))
    choice = None
    for term, kind in DOCUMENT_TYPE_RULES:
        hit = F.contains(name, F.lit(term))
        choice = F.when(hit, F.lit(kind)) if choice is None else choice.when(hit, F.lit(kind))
    return choice.otherwise(F.lit(DEFAULT_DOCUMENT_TYPE))


def is_final(stem: Column | str) -> Column:
    return F.when(contains_any(F.lower(as_col(stem)), FINAL_MARKS), 1).otherwise(0)


def canonical_key(stem: Column) -> Column:
    """The name without version, date and number, as tokens."""
    plain = F.trim(F.regexp_replace(F.lower(stem), PUNCTUATION, " "))
    bare = F.regexp_replace(F.regexp_replace(plain, VERSION, " "), DATE, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "\\b\\d+(?:[._-]\\d+)*\\b", " "), PUNCTUATION, " ")
    tokens = F.filter(tokenize(bare), lambda t: ~F.array_contains(literal_array(VERSION_WORDS), t))
    return F.coalesce(F.nullif(F.concat_ws(" ", tokens), F.lit("")), plain)
