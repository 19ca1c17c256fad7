"""Heading detection and normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import re

from pyspark.sql import Column, functions as F

from dossierlake.functions.text import bind, contains_any, literal_array, squeeze, text_or_empty
from dossierlake.lexicons.fixed_values import CHAPTER_SYNONYMS, SENTENCE_MARKERS

# Default chapter and heading patterns. A Latin letter counts as a numeral only
# in upper case and in front of a separator or blank.
DEFAULT_CHAPTER = "기타"
NUMERALS = "(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+|[IVXLCDM]+[.)．:\\s])"
CHAPTER_WORD = "(?:[제第]\\s*\\d+\\s*장|(?i:chapter)\\s*\\d+)"
CHAPTER_PREFIX = f"^\\s*{CHAPTER_WORD}\\s*[.)．:]?\\s*"
NUMERAL_PREFIX = f"^\\s*{NUMERALS}\\s*[.)．:]?\\s*"
NUMBER_PREFIX = "^\\s*\\d+(?:\\.\\d+)*\\s*[.)．:]?\\s*"
HEADING_PREFIX = f"^\\s*(?:{CHAPTER_WORD}|{NUMERALS}|\\d+(?:\\.\\d+)*)\\s*[.)．:]?\\s*\\S"
# Everything but digits, Latin letters and Hangul syllables, as ranges: the JVM matches
# listed ranges several times faster than the negated class.
NOT_TITLE_CHARS = "[\\x00-/:-@\\[-`{-\\x{abff}\\x{d7a4}-\\x{10ffff}]+"
DROPPED_WORDS = "챕터|chapter|장|절"
SAME_TITLE_ENDINGS = ("수립", "설계")
TAXONOMY_PREFIX = (
    "^(?:\\s*(?:[제第]\\s*\\d+\\s*장|(?i:chapter)\\s*\\d+|" + NUMERALS + "|\\d+(?:\\.\\d+)*|\\(\\d+\\)|[①-⑳])"
    "\\s*[.)．:\\-]?\\s*|\\s*[가-힣]\\s*[.)．:\\-]\\s*)+"
)

Groups = Mapping[str, Sequence[str]]


def normalize_chapter(value: Column | str) -> Column:
    """Numbering and the words for chapter removed, letters and digits only."""
    return bind(F.lower(_unnumbered(value)), _title_norm)


def _unnumbered(value: Column | str) -> Column:
    text = F.trim(text_or_empty(value))
    for prefix in (CHAPTER_PREFIX, NUMERAL_PREFIX, NUMBER_PREFIX):
        text = F.regexp_replace(text, prefix, "")
    return text


def _title_norm(low: Column) -> Column:
    return _title_chars(F.when(contains_any(low, DROPPED_WORDS.split("|")), F.regexp_replace(low, DROPPED_WORDS, "")).otherwise(low))


def _title_chars(low: Column) -> Column:
    """Blanks, the most frequent by far, go by plain replacement; a Latin letter is passed over before the ranges are tried."""
    return F.regexp_replace(F.replace(low, F.lit(" "), F.lit("")), f"(?![a-z]){NOT_TITLE_CHARS}", "")


def normalize_taxonomy(value: Column | str) -> Column:
    """The same for taxonomy matching, where prefixes are stripped until none is left."""
    bare = F.regexp_replace(F.trim(text_or_empty(value)), TAXONOMY_PREFIX, "")
    return F.regexp_replace(F.lower(bare), NOT_TITLE_CHARS, "")


def plain_norm(value: str) -> str:
    """The chapter norm of a lexicon entry; entries carry no numbering."""
    return plain_compact(re.sub(DROPPED_WORDS, "", value.strip()))


def plain_compact(value: str) -> str:
    return re.sub("[^0-9a-zA-Z가-힣]+", "", value.lower())


def _distinct(values) -> list[str]:
    return [v for v in dict.fromkeys(values) if v]


def chapter_and_norm(value: Column | str, groups: Groups = CHAPTER_SYNONYMS) -> Column:
    """struct(name, norm), what `canonical_chapter` and `normalize_chapter` say, from one reading of the text."""

    def choose(pair: Column) -> Column:
        choice = F.when(pair["trimmed"] == DEFAULT_CHAPTER, F.lit(DEFAULT_CHAPTER))
        for name, aliases in groups.items():
            by_norm, by_compact = _distinct(plain_norm(a) for a in aliases), _distinct(plain_compact(a) for a in aliases)
            hit = contains_any(pair["norm"], by_norm) | (~pair["same"] & contains_any(pair["compact"], by_compact))
            others = [a for a in by_compact if a not in by_norm]
            choice = choice.when(hit | (pair["same"] & contains_any(pair["norm"], others)) if others else hit, F.lit(name))
        return F.struct(choice.otherwise(F.lit("")).alias("name"), pair["norm"].alias("norm"))

    def lowered(t: Column) -> Column:
        return bind(F.lower(t["bare"]), lambda l: F.struct(
            t["trimmed"].alias("trimmed"), t["bare"].alias("bare"), l.alias("low"),
            (~contains_any(l, DROPPED_WORDS.split("|")) & (t["bare"] == t["trimmed"])).alias("same")))

    def compacted(l: Column) -> Column:
        # without a numbering and a word for chapter both forms are the same
        whole = F.when(l["bare"] == l["trimmed"], l["low"]).otherwise(F.lower(l["trimmed"]))
        norm = F.when(l["same"], _title_chars(l["low"])).otherwise(_title_norm(l["low"]))
        return F.struct(
            l["trimmed"].alias("trimmed"), l["same"].alias("same"), norm.alias("norm"),
            F.when(~l["same"], bind(whole, _title_chars)).alias("compact"))

    trimmed = bind(F.trim(text_or_empty(value)), lambda t: F.struct(t.alias("trimmed"), _unnumbered(t).alias("bare")))
    return bind(bind(bind(trimmed, lowered), compacted), choose)


def canonical_chapter(value: Column | str, groups: Groups = CHAPTER_SYNONYMS) -> Column:
    """The first group one of whose aliases is contained in the heading, else ''."""
    return chapter_and_norm(value, groups)["name"]


def chapter_norms(chapter: str, groups: Groups = CHAPTER_SYNONYMS) -> list[str]:
    """All norms under which a chapter is searched."""
    wanted = plain_norm(chapter)
    name = next(
        (g for g, aliases in groups.items() if any(plain_norm(a) and plain_norm(a) in wanted for a in aliases)), chapter
    )
    return _distinct([plain_norm(name), *[plain_norm(a) for a in groups.get(name, (name,))]])


def search_norm(chapter: Column, section: Column, path: Column, groups: Groups = CHAPTER_SYNONYMS) -> Column:
    """Norms of the three heading texts and of the chapters they belong to, each once."""
    return known_norms([chapter_and_norm(value, groups) for value in (chapter, section, path)], groups)


def known_norms(known: Sequence[Column], groups: Groups = CHAPTER_SYNONYMS) -> Column:
    """P9 from what `chapter_and_norm` says of each heading text."""

    def of(pair: Column) -> Column:
        related = F.array().cast("array<string>")
        for group in groups:
            related = F.when(pair["name"] == group, literal_array(chapter_norms(group, groups))).otherwise(related)
        return F.concat(F.array(pair["norm"]), related)

    norms = F.array_distinct(F.concat(*[bind(pair, of) for pair in known]))
    return F.concat_ws(" ", F.filter(norms, lambda n: n != ""))


def heading_path(chapter: Column, section: Column) -> Column:
    parts = F.filter(F.array_distinct(F.array(F.trim(chapter), F.trim(section))), lambda p: p != "")
    return F.concat_ws(" > ", parts)


def detect_heading(line: Column, groups: Groups = CHAPTER_SYNONYMS) -> Column:
    """struct(chapter, section) a line sets, or NULL when it is no heading.

    `chapter` is NULL where the line leaves the chapter as it is. What a heading sets does
    not depend on what came before, so the carry-forward only needs the last one.
    """
    title = F.trim(squeeze(line), F.lit(" ."))

    def decide(t: Column) -> Column:
        def event(known: Column) -> Column:
            c, norm = known["name"], known["norm"]
            long_enough = F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 3
            prefixed = F.rlike(t, F.lit(HEADING_PREFIX))
            short = (F.length(t) <= 45) | ((F.length(t) <= 90) & ~contains_any(t, SENTENCE_MARKERS))
            is_heading = ((c != "") | (short & prefixed)) & long_enough
            same = bind(normalize_chapter(c), lambda own: (norm == own) | norm.isin(*[F.concat(own, F.lit(e)) for e in SAME_TITLE_ENDINGS]))
            document_level = F.rlike(t, F.lit(CHAPTER_PREFIX)) | F.rlike(t, F.lit(NUMERAL_PREFIX))
            chapter = F.when(c != "", c).when(document_level, F.lit(DEFAULT_CHAPTER))
            section = F.when((c != "") & same, F.lit("")).otherwise(t)
            return F.when(is_heading, F.struct(chapter.alias("chapter"), section.alias("section")))

        return bind(chapter_and_norm(t, groups), event)

    return bind(title, decide)
