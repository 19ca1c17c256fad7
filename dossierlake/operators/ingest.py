"""Ingestion: paragraphs -> page-like units -> headings -> chunks, all inside the document's row.

No step shuffles: units and chunks are derived where the document was read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossierlake.functions import headings as HD, tables as TB
from dossierlake.functions.text import bind, clean_lines, explode_rows, first_filled, stable_id, text_or_empty
from dossierlake.functions.tokens import tokenize
from dossierlake.lexicons.fixed_values import CHAPTER_SYNONYMS

# Sizes of units and chunks, and the index version mark.
UNIT_CHARS = 1200
CHUNK_CHARS = 1000
OVERLAP_CHARS = 150
HEADING_LINES = 16
PARENT_CHARS = 1800
INDEX_VERSION = "hierarchy-embedding-v2"
SOFT_BREAKS = ("\n", ". ", "다.")
STATUTE_END = "(?:법률|시행령|시행규칙|고시|지침|규정|훈령|예규|조례|법)"
STATUTE = f"[가-힣A-Za-z0-9·ㆍ\\s]{{2,80}}{STATUTE_END}"


def paragraphs_of(body: Column | str) -> Column:
    """Lines as array<struct(text, heading)>; plain text has no heading style."""
    return F.transform(clean_lines(body), lambda line: F.struct(line.alias("text"), F.lit(False).alias("heading")))


def unit_starts(paragraphs: Column) -> Column:
    """Index of the first paragraph of each unit.

    A fold with reset: a unit closes once it holds 1,200 characters or a heading follows.
    """
    start = F.struct(
        F.lit(0).alias("chars"), F.lit(False).alias("open"), F.lit(1).alias("at"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(s: Column, p: Column) -> Column:
        fresh = ~s["open"] | p["heading"]
        chars = F.when(fresh, F.lit(0)).otherwise(s["chars"]) + F.length(p["text"])
        return F.struct(
            chars.alias("chars"), (chars < UNIT_CHARS).alias("open"), (s["at"] + 1).alias("at"),
            F.when(fresh, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(paragraphs, start, step, lambda s: s["starts"])


def with_units(docs: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """Adds `units`: array<struct(page_no, text, section_title)>."""
    docs = docs.withColumn("starts", unit_starts(F.col(paragraphs)))

    def unit(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get("starts", i + 1), F.size(paragraphs) + 1)
        members = F.slice(paragraphs, start, until - start)
        titles = F.filter(F.slice(paragraphs, 1, until - 1), lambda p: p["heading"])
        return F.struct(
            (i + 1).alias("page_no"),
            F.array_join(F.transform(members, lambda p: p["text"]), "\n").alias("text"),
            F.coalesce(F.try_element_at(titles, F.lit(-1))["text"], F.lit("")).alias("section_title"),
        )

    return docs.withColumn("units", F.transform("starts", unit)).drop("starts", paragraphs)


def with_headings(docs: DataFrame, groups: HD.Groups = CHAPTER_SYNONYMS) -> DataFrame:
    """One row per unit with the chapter and section carried forward."""

    def events(u: Column) -> Column:
        lines = F.concat(F.array(u["section_title"]), F.slice(F.split(u["text"], "\n"), 1, HEADING_LINES))
        found = F.filter(F.transform(lines, lambda l: HD.detect_heading(l, groups)), lambda e: e.isNotNull())
        return bind(
            found,
            lambda es: F.struct(
                F.try_element_at(F.filter(es, lambda e: e["chapter"].isNotNull()), F.lit(-1))["chapter"].alias("chapter"),
                F.try_element_at(es, F.lit(-1))["section"].alias("section"),
            ),
        )

    start = F.struct(
        F.lit(HD.DEFAULT_CHAPTER).alias("chapter"), F.lit("").alias("section"),
        F.array().cast("array<struct<chapter:string,section:string>>").alias("seen"),
    )

    def carry(s: Column, e: Column) -> Column:
        now = F.struct(
            F.coalesce(e["chapter"], s["chapter"]).alias("chapter"), F.coalesce(e["section"], s["section"]).alias("section")
        )
        return F.struct(
            now["chapter"].alias("chapter"), now["section"].alias("section"),
            F.concat(s["seen"], F.array(now)).alias("seen"),
        )

    carried = docs.withColumn("events", F.transform("units", events)).withColumn(
        "seen", F.aggregate("events", start, carry, lambda s: s["seen"])
    )
    kept = [c for c in docs.columns if c != "units"]

    def placed(pair: Column) -> Column:
        unit, state = pair["units"], pair["seen"]
        own = unit["section_title"]
        section = F.when((own == "") | (own == state["chapter"]), state["section"]).otherwise(own)
        return F.struct(
            unit["page_no"].alias("page_no"), unit["text"].alias("text"), state["chapter"].alias("chapter"),
            section.alias("section"), HD.heading_path(state["chapter"], section).alias("path"),
        )

    rows = carried.withColumn("placed", F.transform(F.arrays_zip("units", "seen"), placed)).drop("events", "seen", "units")
    rows = rows.withColumn("contexts", parent_contexts(F.col("placed")))
    rows = explode_rows(rows, kept + ["contexts"], F.col("placed"), "u")
    return rows.select(
        *kept, F.col("u.page_no").alias("page_no"), F.col("u.text").alias("unit_text"), F.col("u.chapter").alias("chapter_title"),
        F.col("u.section").alias("section_title"), F.col("u.path").alias("heading_path"),
        F.element_at("contexts", F.col("u.path")).alias("parent_context"),
    )


def parent_contexts(placed: Column) -> Column:
    """Map heading path -> start of the joined text of all its units, inside the document's row."""

    def context(path: Column) -> Column:
        texts = F.transform(F.filter(placed, lambda u: u["path"] == path), lambda u: u["text"])
        return F.substring(F.array_join(texts, "\n"), 1, PARENT_CHARS)

    paths = F.array_distinct(F.transform(placed, lambda u: u["path"]))
    return bind(paths, lambda ps: F.map_from_arrays(ps, F.transform(ps, context)))


def units_of(docs: DataFrame, body: str = "text", groups: HD.Groups = CHAPTER_SYNONYMS) -> DataFrame:
    """Documents -> one row per unit with its headings."""
    with_paragraphs = docs.withColumn("paragraphs", paragraphs_of(body)).drop(body)
    return with_headings(with_units(with_paragraphs), groups)


SPAN = T.ArrayType(
    T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
    ])
)


# The share of a window a soft break must lie beyond, and how far around a cut statute names are read.
SOFT_SHARE, STATUTE_REACH = 0.55, 90


def _cuts(text: str, size: int, overlap: int, breaks: tuple[str, ...], statute: re.Pattern) -> Iterator[tuple[int, int]]:
    """Windows of `size` that end behind their last soft break and never inside a statute name.

    All breaks are found at once; the last one before a cut is then a binary search.
    """
    named = re.compile(STATUTE_END)
    marks = sorted((m.end(), m.start()) for mark in breaks for m in re.finditer(re.escape(mark), text))
    ends, latest = [e for e, _ in marks], list(accumulate((s for _, s in marks), max))

    def softened(begin: int, stop: int) -> int:
        known = bisect_right(ends, stop)
        at = latest[known - 1] if known else -1
        return at + 1 if at - begin > size * SOFT_SHARE else stop

    def unbroken(stop: int) -> int:
        low, high = max(0, stop - STATUTE_REACH), min(len(text), stop + STATUTE_REACH)
        # the whole pattern tries up to eighty characters from each place: only where one of its last words stands
        near = statute.finditer(text, low, high) if named.search(text, low, high) else ()
        return next((m.end() for m in near if m.start() < stop < m.end()), stop)

    begin, stop = 0, 0
    while stop < len(text):
        stop = softened(begin, min(len(text), begin + size))
        stop = stop if stop == len(text) else unbroken(stop)
        yield begin, stop
        begin = max(0, stop - overlap)


def window_splitter(size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Each cut depends on the one before, which no built-in expression states; the text is cleaned already."""
    kept = max(0, min(overlap, size // 2))

    @F.pandas_udf(SPAN)
    def split(texts: pd.Series) -> pd.Series:
        statute = re.compile(STATUTE)
        return texts.map(
            lambda t: [
                {"text": t[a:b].strip(), "char_start": a, "char_end": b}
                for a, b in _cuts(t, size, kept, SOFT_BREAKS, statute) if t[a:b].strip()
            ]
        )

    return split


def with_chunks(units: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per chunk. Units that need no cutting pass the Python worker as empty strings."""
    whole = TB.looks_like_table(F.col("unit_text")) | (F.length("unit_text") <= size)
    span = F.struct(
        F.col("unit_text").alias("text"), F.lit(0).alias("char_start"), F.length("unit_text").alias("char_end")
    )
    to_cut = F.when(whole, F.lit("")).otherwise(F.col("unit_text"))
    parts = units.withColumn("cut", window_splitter(size, overlap)(to_cut)).withColumn(
        "spans", F.when(whole, F.array(span)).otherwise(F.col("cut"))
    )
    exploded = parts.select("*", F.posexplode_outer("spans").alias("part", "span")).drop("cut", "spans")
    return exploded.withColumns({
        "chunk_index": F.col("part") + 1, "chunk_text": F.col("span.text"),
        "char_start": F.col("span.char_start"), "char_end": F.col("span.char_end"),
    }).filter(F.col("chunk_text") != "").drop("part", "span")


def chunk_id(document_id: str, file_name: str, page: str, part: str, body: str) -> Column:
    return stable_id(
        F.concat_ws(":", document_id, file_name, F.col(page).cast("string"), F.col(part).cast("string"), F.substring(body, 1, 50)),
        "chk",
    )


def major_chapter(section: Column, groups: HD.Groups) -> Column:
    """The first of chapter, section and path that names a known chapter; `section` is the name that the section's title has."""

    def named(name: Column) -> Column:
        return bind(name, lambda n: F.when((n != "") & (n != HD.DEFAULT_CHAPTER), n))

    chapter, path = HD.canonical_chapter("chapter_title", groups), HD.canonical_chapter("heading_path", groups)
    return F.coalesce(named(chapter), named(section), named(path), F.lit(HD.DEFAULT_CHAPTER))


def embedding_text() -> Column:
    """Labelled lines, empty ones left out."""
    labelled = (
        ("문서명", "document_title"), ("프로젝트명", "project_name"), ("고객기관", "client_name"),
        ("문서영역", "canonical_heading_path"), ("원본경로", "raw_heading_path"), ("페이지", "display_page"),
        ("키워드", "domain_keywords"), ("상위문맥", "parent_context"), ("본문", "chunk_text"),
    )
    lines = []
    for label, column in labelled:
        value = F.substring(text_or_empty(column), 1, 700) if column == "parent_context" else text_or_empty(column)
        lines.append(F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), value)))
    return F.concat_ws("\n", *lines)


def chunk_table(docs: DataFrame, groups: HD.Groups = CHAPTER_SYNONYMS, tags=None, taxonomy=None) -> DataFrame:
    """Documents -> the chunk table. `docs` carries the columns of `corpus_documents`."""
    units = units_of(docs, "text", groups).withColumn("display_page", F.col("page_no").cast("string"))
    return chunks_of_units(units, groups, tags, taxonomy)


def chunks_of_units(
    units: DataFrame, groups: HD.Groups = CHAPTER_SYNONYMS, tags=None, taxonomy=None, size: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Units with headings, document and project columns -> the chunk table."""
    from dossierlake.operators import tagging, taxonomy as TX

    # A section's title can be a long line; it is read once for all that follows.
    units = units.withColumn("section_known", HD.chapter_and_norm("section_title", groups)).withColumns({
        "raw_chapter_title": F.col("chapter_title"), "raw_section_title": F.col("section_title"),
        "raw_heading_path": F.col("heading_path"), "chapter_title": major_chapter(F.col("section_known.name"), groups),
    })
    units = units.withColumn("repeats", F.col("section_known.norm") == HD.normalize_chapter("chapter_title"))
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("norm"))
    units = units.withColumns({
        "section_title": F.when(F.col("repeats"), F.lit("")).otherwise(F.col("section_title")),
        "section_known": F.when(F.col("repeats"), none).otherwise(F.col("section_known")),
    })
    units = units.withColumn("heading_path", HD.heading_path(F.col("chapter_title"), F.col("section_title"))).drop("repeats")
    units = TX.classify(units, taxonomy or TX.KOREAN_TAXONOMY)
    units = units.withColumns({
        "canonical_heading_path": first_filled(
            "canonical_heading_path",
            HD.heading_path(first_filled("canonical_chapter_title", "chapter_title"), F.col("canonical_section_title")),
        ),
        "canonical_chapter_title": first_filled("canonical_chapter_title", "chapter_title"),
        "normalized_chapter_title": HD.normalize_chapter("chapter_title"),
        "normalized_section_title": F.col("section_known.norm"),
        "normalized_heading_path": HD.normalize_chapter("heading_path"),
        "parent_chunk_id": stable_id(F.concat_ws(":", "document_id", "raw_heading_path"), "parent"),
    })
    path = F.concat_ws(" ", "heading_path", "canonical_heading_path")
    known = [HD.chapter_and_norm("canonical_chapter_title", groups), F.col("section_known"), HD.chapter_and_norm(path, groups)]
    units = units.withColumn("heading_norm", HD.known_norms(known, groups)).drop("section_known")
    units = TB.with_table_columns(units)
    units = units.withColumn(
        "domain_keywords",
        F.concat_ws(
            ", ",
            tagging.domain_tags(
                F.concat_ws(" ", "unit_text", "document_title", "file_name", "canonical_heading_path", "section_title"),
                tags or tagging.KOREAN_TAGS,
            ),
        ),
    )
    chunks = with_chunks(units, size, overlap)
    if "client_name" not in chunks.columns:
        chunks = chunks.withColumn("client_name", F.lit(""))
    return chunks.withColumns({
        "chunk_id": chunk_id("document_id", "file_name", "page_no", "chunk_index", "chunk_text"),
        "token_count": F.size(tokenize("chunk_text")), "page_range": F.col("page_no").cast("string"),
        "index_version": F.lit(INDEX_VERSION), "embedding_text": embedding_text(),
    }).withColumn("embedding_id", F.col("chunk_id")).drop("unit_text")
