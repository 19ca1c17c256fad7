"""Column expressions for cleaning and cutting text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The characters Python's str.strip() removes, usable inside a regex class
# by Java and by RE2 alike (both treat only ASCII blanks as \s by default).
BLANKS = "\t\n\x0b\x0c\r\x1c-\x1f \x85   -     　"
EDGE_BLANKS = f"^[{BLANKS}]+|[{BLANKS}]+$"
# A character in front of a class decides at once for most of a text: printing ASCII is no blank.
NOT_PRINTED = "(?![!-~])"
OTHER_BLANKS = BLANKS.replace(" ", "")
SENTENCE_END = f"(?:[.!?。][{BLANKS}]+|다\\.[{BLANKS}]+)"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, so a costly expression is not repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_rows(df: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
    """One row per array element; rows without elements vanish.

    A plain explode makes the optimizer push `size(values) > 0` below the projection that
    computes `values`, which then runs twice. The outer form with a filter on the element
    computes it once.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def text_or_empty(value: Column | str) -> Column:
    """NULL and '' are the same thing throughout the model."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def is_blank(value: Column | str) -> Column:
    return text_or_empty(value) == ""


def first_filled(*values: Column | str) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(text_or_empty(v), F.lit("")) for v in values], F.lit(""))


def strip(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), f"{NOT_PRINTED}(?:{EDGE_BLANKS})", "")


def squeeze(value: Column | str) -> Column:
    """Every blank run becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(value), f"{NOT_PRINTED}(?: [{BLANKS}]|[{OTHER_BLANKS}])[{BLANKS}]*", " "))


def clean_text(value: Column | str) -> Column:
    """One space between words, trimmed lines, no empty lines."""
    unix = F.regexp_replace(text_or_empty(value), "\r\n?", "\n")
    single = F.regexp_replace(unix, "(?: [ \t]|\t)[ \t]*", " ")
    return strip(F.regexp_replace(single, f"{NOT_PRINTED}[{BLANKS}]*\n[{BLANKS}]*", "\n"))


def clean_lines(value: Column | str) -> Column:
    """The non-empty cleaned lines, in order."""
    return F.filter(F.split(clean_text(value), "\n"), lambda line: line != "")


def trim_snippet(value: Column | str, limit: int = 500) -> Column:
    """One line, cut to `limit - 1` characters plus an ellipsis."""
    return bind(
        F.replace(clean_text(value), F.lit("\n"), F.lit(" ")),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), f"[{BLANKS}]+$", ""), F.lit("..."))
        ),
    )


def evidence_sentence(value: Column | str) -> Column:
    """The text in front of the first sentence end."""
    return strip(F.element_at(F.split(squeeze(value), SENTENCE_END, 2), 1))


def stable_id(value: Column | str, prefix: str) -> Column:
    """Identifier = prefix, underscore, first 16 hex digits of SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(text_or_empty(value)), 1, 16))


def contains_any(haystack: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """True when one of the fixed `terms` occurs; plain substring tests, no regex."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(haystack, F.lit(term))
    return found


def count_contained(haystack: Column, terms: list[str] | tuple[str, ...]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(haystack, F.lit(term)).cast("int")
    return total


def literal_array(values: list[str] | tuple[str, ...]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def first_contained(haystack: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The first of the fixed `terms` that occurs (both sides lower-cased), else ''."""
    choice = None
    for term in terms:
        hit = F.contains(haystack, F.lit(term.lower()))
        choice = F.when(hit, F.lit(term)) if choice is None else choice.when(hit, F.lit(term))
    return choice.otherwise(F.lit(""))
