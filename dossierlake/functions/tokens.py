"""Tokenizer and token coverage as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierlake.functions.text import as_col, bind, text_or_empty
from dossierlake.lexicons.fixed_values import KOREAN_SUFFIXES, TOKEN_STOPWORDS

# Patterns that decide what a token is.
TOKEN_PATTERN = "[가-힣A-Za-z0-9][가-힣A-Za-z0-9_+#.-]{1,}"
PLAIN_WORD = "^[A-Za-z]{3,}$"
WORD = "\\p{L}\\p{N}_"
# The letters are tried first and what stands in front of them afterwards: most places of a text fail on the letter.
RND_PATTERN = f"(?i)r(?<![{WORD}]r)(?:\\s*&\\s*d|\\s*[-_/]\\s*d|nd)(?![{WORD}])"
AI_PATTERN = f"(?i)ai(?<![{WORD}]ai)(?![{WORD}])"
SUFFIX_PATTERN = "^(.{2,}?)(?:" + "|".join(KOREAN_SUFFIXES) + ")$"
EXPANSIONS = {
    "rnd": ("rnd", "연구개발", "연구"),
    "연구개발": ("연구개발", "rnd", "연구"),
    "연구": ("연구", "연구개발", "rnd"),
    "ai": ("ai", "인공지능"),
    "인공지능": ("인공지능", "ai"),
}


def expand_synonyms(value: Column | str) -> Column:
    """R&D is written out, AI and its Korean name imply each other."""
    spelled = F.regexp_replace(text_or_empty(value), RND_PATTERN, " RND 연구개발 ")
    with_korean = bind(
        spelled, lambda t: F.concat(t, F.when(F.rlike(t, F.lit(AI_PATTERN)), F.lit(" 인공지능")).otherwise(F.lit("")))
    )
    return bind(
        with_korean, lambda t: F.concat(t, F.when(F.contains(t, F.lit("인공지능")), F.lit(" ai")).otherwise(F.lit("")))
    )


def normalize_token(token: Column) -> Column:
    """Drop trailing dots, then one Korean particle if two characters remain."""
    bare = F.rtrim(token, F.lit("."))
    return F.when(
        F.substring(bare, -1, 1) >= F.lit("가"),
        F.rtrim(F.regexp_replace(bare, SUFFIX_PATTERN, "$1"), F.lit(".")),
    ).otherwise(bare)


def _expansion(token: Column) -> Column:
    choice = None
    for source, targets in EXPANSIONS.items():
        values = F.array(*[F.lit(t) for t in targets])
        choice = F.when(token == source, values) if choice is None else choice.when(token == source, values)
    return choice.otherwise(F.array(token))


def tokenize(value: Column | str, plain_words: tuple[str, ...] | None = None) -> Column:
    """Ordered tokens, synonyms expanded, stop words and one-letter tokens dropped.

    With `plain_words`, of words of three and more Latin letters only these; the others go before anything else is done.
    """
    raw = F.regexp_extract_all(expand_synonyms(value), F.lit(TOKEN_PATTERN), F.lit(0))
    if plain_words is not None:
        raw = F.filter(raw, lambda t: ~F.rlike(t, F.lit(PLAIN_WORD)) | F.lower(t).isin(*plain_words, *EXPANSIONS))
    plain = F.transform(raw, lambda t: normalize_token(F.lower(t)))
    expanded = bind(
        plain,
        lambda tokens: F.when(
            F.exists(tokens, lambda t: t.isin(*EXPANSIONS)), F.flatten(F.transform(tokens, _expansion))
        ).otherwise(tokens),
    )
    return F.filter(expanded, lambda t: (F.length(t) > 1) & ~t.isin(*TOKEN_STOPWORDS))


def unique_tokens(value: Column | str) -> Column:
    return F.array_distinct(tokenize(value))


def matched_tokens(query_tokens: Column, haystack: Column) -> Column:
    """Query tokens that occur in the haystack, in query order."""
    return F.filter(query_tokens, lambda t: F.contains(haystack, t))


def missing_tokens(query_tokens: Column, haystack: Column) -> Column:
    return F.filter(query_tokens, lambda t: ~F.contains(haystack, t))


def coverage(hits: Column, total: Column) -> Column:
    """Share of query tokens found; 0 for an empty query."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def has_rnd(value: Column | str) -> Column:
    return F.rlike(text_or_empty(value), F.lit(RND_PATTERN))


def query_terms(value: Column | str) -> Column:
    """Distinct query tokens, plus the literal `r&d` when the query spells it in any way."""
    query = as_col(value)
    return F.when(
        has_rnd(query), F.array_distinct(F.array_append(unique_tokens(query), F.lit("r&d")))
    ).otherwise(unique_tokens(query))
