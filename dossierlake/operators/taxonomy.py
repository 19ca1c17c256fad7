"""Fuzzy classification of headings against a three-level taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dossierlake.functions.headings import TAXONOMY_PREFIX, plain_compact
from dossierlake.lexicons import fixed_values as V

# Thresholds and confidences of heading matches.
HEADING_THRESHOLD = 0.72
QUERY_THRESHOLD = 0.70
CONTAINS_ALIAS = 0.92
INSIDE_ALIAS = 0.86
MATCH = "canonical string, confidence double, reason string"

KOREAN_TAXONOMY = (V.CANONICAL_CHAPTER_ALIASES, V.CANONICAL_SECTION_ALIASES, V.CANONICAL_SUBSECTION_ALIASES)

Aliases = Mapping[str, Sequence[str]]


_numbering = re.compile(TAXONOMY_PREFIX)
_parts = re.compile(r"[^\s/|,()\-_.]+")


def _norm(text: str) -> str:
    text = (text or "").strip()
    numbered = _numbering.match(text)
    return plain_compact(text[numbered.end():] if numbered else text)


def _words(text: str, most: int | None = None) -> frozenset[str]:
    """The distinct words; of a text that has more than `most` only the first ones, just one too many."""
    found: set[str] = set()
    for part in _parts.finditer(text or ""):
        word = _norm(part.group())
        if len(word) >= 2:
            found.add(word)
            if most is not None and len(found) > most:
                break
    return frozenset(found)


EVIDENCE = ("exact", "alias_contains", "token_overlap", "similarity")


class Lexicon:
    """P10: one level of the taxonomy, an alias each; a title is weighed against all of them at once."""

    def __init__(self, aliases: Aliases, threshold: float):
        pairs = [(name, alias) for name, values in aliases.items() for alias in (name, *values) if _norm(alias)]
        self.names, self.aliases = [n for n, _ in pairs], [a for _, a in pairs]
        self.norms, self.words = [_norm(a) for a in self.aliases], [_words(a) for a in self.aliases]
        self.most = 2 * max(map(len, self.words), default=0)
        self.threshold = threshold
        self.seen: dict[str, tuple[str, float, str]] = {}

    def evidence(self, title: str, norm: str | None = None) -> list[tuple[float, float, float, float]]:
        """Confidences by alias and kind of evidence; overlap and ratio count where nothing is contained."""
        norm = _norm(title) if norm is None else norm
        if not norm:
            return []
        # a title of more than twice an alias' words shares less than half of them
        words = _words(title, self.most)
        exact, matcher, rows = norm in self.norms, None, []
        for n, w in zip(self.norms, self.words):
            contained = CONTAINS_ALIAS if n in norm else INSIDE_ALIAS if norm in n else 0.0
            overlap = ratio = 0.0
            if not contained:
                shared = len(words & w) / max(1, len(words | w))
                overlap = min(0.88, 0.60 + 0.35 * shared) if shared >= 0.5 else 0.0
                # two bounds, the cheap one first: lengths rule out a long line before its characters are counted
                if not exact and 2 * min(len(norm), len(n)) / (len(norm) + len(n)) >= self.threshold:
                    matcher = matcher or SequenceMatcher(None, norm, "")
                    matcher.set_seq2(n)
                    if matcher.quick_ratio() >= self.threshold:
                        # the ratio depends on which side is indexed, so the alias is the second sequence
                        found = SequenceMatcher(None, norm, n).ratio()
                        ratio = min(0.91, found) if found >= self.threshold else 0.0
            rows.append((float(norm == n), contained, overlap, ratio))
        return rows

    def match(self, title: str, norm: str | None = None) -> tuple[str, float, str]:
        """Name, confidence and reason of the strongest evidence; earlier aliases, then stronger kinds, win ties."""
        if title not in self.seen:
            confidence, found = 0.0, ("", 0.0, "")
            for alias, row in enumerate(self.evidence(title, norm)):
                for kind, value in enumerate(row):
                    if value > confidence:
                        confidence = value
                        name = self.names[alias] if value >= self.threshold else ""
                        found = (name, round(value, 2), f"{EVIDENCE[kind]}:{self.aliases[alias]}")
            self.seen[title] = found
        return self.seen[title]


def best_of(aliases: Aliases, threshold: float = HEADING_THRESHOLD):
    """The strongest match over several heading texts, each distinct text of a batch weighed once."""

    @F.pandas_udf(MATCH)
    def choose(values: pd.Series) -> pd.DataFrame:
        lexicon = Lexicon(aliases, threshold)
        texts = values.explode().fillna("")
        matches = texts.map({t: lexicon.match(t) for t in texts.unique()})
        strongest = matches.groupby(level=0, sort=False).agg(lambda found: max(found, key=lambda m: m[1]))
        return pd.DataFrame(strongest.reindex(values.index).tolist(), columns=["canonical", "confidence", "reason"])

    return choose


def _placed(hits: list[tuple[str, float, str]]) -> tuple:
    """The canonical names by level, then path, confidence and reason over those that were found."""
    found = [h for h in hits if h[0]]
    return (*(h[0] for h in hits), " > ".join(h[0] for h in found), max((h[1] for h in found), default=0.0), " | ".join(h[2] for h in found if h[2]))


PLACED = (
    "canonical_chapter_title", "canonical_section_title", "canonical_subsection_title", "canonical_heading_path",
    "heading_classification_confidence", "heading_classification_reason",
)


def best_of_levels(taxonomy: Sequence[Aliases], threshold: float = HEADING_THRESHOLD):
    """`best_of` for all levels at once: the first weighs the chapter, the others the section; the path and its parts count for all.

    Each text comes once, and its norm is made once for all levels.
    """

    @F.pandas_udf(", ".join(f"{c} {'double' if c.endswith('confidence') else 'string'}" for c in PLACED))
    def choose(chapters: pd.Series, sections: pd.Series, paths: pd.Series) -> pd.DataFrame:
        lexicons, norms = [Lexicon(aliases, threshold) for aliases in taxonomy], {}

        def strongest(lexicon: Lexicon, texts: list[str]) -> tuple[str, float, str]:
            for t in texts:
                if t not in norms:
                    norms[t] = _norm(t)
            return max((lexicon.match(t, norms[t]) for t in texts), key=lambda m: m[1])

        rows = []
        for chapter, section, path in zip(chapters, sections, paths):
            shared = None if path is None else [path, *filter(None, (p.strip(" ") for p in path.split(">")))]
            owners = (chapter, section, section)
            rows.append(_placed([strongest(lexicon, [""] if shared is None else [own or "", *shared]) for lexicon, own in zip(lexicons, owners, strict=True)]))
        return pd.DataFrame(rows, columns=PLACED)

    return choose


def classify(
    units: DataFrame, taxonomy: Sequence[Aliases] = KOREAN_TAXONOMY, chapter: str = "raw_chapter_title",
    section: str = "section_title", path: str = "raw_heading_path",
) -> DataFrame:
    """Canonical chapter, section, subsection, path, confidence and reason."""
    matched = units.withColumn("m", best_of_levels(taxonomy)(F.col(chapter), F.col(section), F.col(path)))
    return matched.withColumns({c: F.col(f"m.{c}") for c in PLACED}).drop("m")


def suggest_chapters(chapters: DataFrame, label: str, norms: list[str], limit: int = 5) -> DataFrame:
    """Known chapter names closest to the requested one."""
    from dossierlake.functions.headings import normalize_chapter

    @F.pandas_udf("double")
    def closeness(values: pd.Series) -> pd.Series:
        def score(v: str) -> float:
            ratio = max((SequenceMatcher(None, n, v).ratio() for n in norms), default=0.0)
            return max(ratio, CONTAINS_ALIAS) if any(n and (n in v or v in n) for n in norms) else ratio

        return values.map(score)

    scored = chapters.select(label, F.round(closeness(normalize_chapter(label)), 6).alias("score"))
    return scored.filter(F.col("score") >= 0.2).orderBy(F.desc("score"), label).limit(limit)
