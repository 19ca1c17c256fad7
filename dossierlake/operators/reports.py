"""Reports over the chunk table: counts, chapters, heading tree, validation, result metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions.headings import DEFAULT_CHAPTER
from dossierlake.functions.text import explode_rows, first_filled, is_blank, text_or_empty
from dossierlake.operators.keyword import top_rows_per
from dossierlake.session import checkpoint

# Limits of the reports and the confidence below which a heading is doubtful.
CHAPTER_LIMIT = 500
TREE_LIMIT = 200
TREE_KEYWORDS = 5
AREA_KEYWORDS = 6
DISTRIBUTION_LIMIT = 20
LOW_CONFIDENCE = 0.72
EXAMPLES = 10
UNKNOWN = "확인 필요"


def chapter_label() -> Column:
    return first_filled("canonical_chapter_title", "chapter_title", F.lit(DEFAULT_CHAPTER))


def section_label() -> Column:
    return first_filled("canonical_section_title", "section_title")


def index_stats(projects: DataFrame, documents: DataFrame, chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """A1: four counts, one row each."""
    named = {"projects": projects, "documents": documents, "chunks": chunks, "search_logs": logs}
    counts = [
        df.agg(F.count("*").cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in named.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def label_counts(chunks: DataFrame, labels: list[str], document: str, page: str) -> DataFrame:
    """Chunks, pages and documents per label, by three nested sums.

    (label, document, page) -> (label, document) -> label: every step combines before its
    shuffle, and no distinct expansion multiplies the rows.
    """
    pages = chunks.groupBy(*labels, document, page).agg(F.count("*").alias("n"))
    documents = pages.groupBy(*labels, document).agg(
        F.sum("n").alias("n"), F.count("*").alias("pages"), F.min(page).alias("first"), F.max(page).alias("last")
    )
    return documents.groupBy(*labels).agg(
        F.sum("n").cast("bigint").alias("chunk_count"), F.count("*").cast("bigint").alias("document_count"),
        F.sum("pages").cast("bigint").alias("page_count"), F.min("first").alias("first_page"), F.max("last").alias("last_page"),
    )


def chapter_names(chunks: DataFrame, limit: int = 300) -> DataFrame:
    """A2: chapters by number of chunks, grouped by the label that is shown."""
    counted = chunks.groupBy(chapter_label().alias("chapter_title")).agg(F.count("*").cast("bigint").alias("n"))
    return counted.orderBy(F.desc("n"), "chapter_title").limit(limit)


def chapter_report(chunks: DataFrame, document: str = "document_id", limit: int = CHAPTER_LIMIT) -> DataFrame:
    """A3: chunks, documents and page range per chapter."""
    counted = label_counts(chunks.withColumn("chapter", chapter_label()), ["chapter"], document, "page_no")
    page_range = F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string"))
    return (
        counted.select("chapter", "document_count", "chunk_count", page_range.alias("page_range"))
        .orderBy(F.desc("chunk_count"), "chapter").limit(limit)
    )


def top_words(
    words: DataFrame, labels: list[str], word: str, limit: int, out: str, weight: Column | None = None
) -> DataFrame:
    """The most frequent words per label, joined by commas; equal counts in word order."""
    uses = F.count("*") if weight is None else F.sum(weight)
    counted = words.groupBy(*labels, word).agg(uses.alias("uses"))
    order = Window.partitionBy(*labels).orderBy(F.desc("uses"), F.asc(word))
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    packed = best.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("place", word))).alias("items"))
    return packed.select(*labels, F.array_join(F.transform("items", lambda i: i[word]), ", ").alias(out))


def heading_tree(chunks: DataFrame, document: str = "document_id", subsection: Column | None = None) -> DataFrame:
    """A4: all three heading levels in one pass."""
    third = first_filled("canonical_subsection_title") if subsection is None else subsection
    levels = F.array(
        F.struct(F.lit(1).alias("level"), chapter_label().alias("label")),
        F.struct(F.lit(2).alias("level"), section_label().alias("label")),
        F.struct(F.lit(3).alias("level"), third.alias("label")),
    )
    rows = explode_rows(chunks, [document, "page_no", "domain_keywords"], levels, "h").select(
        F.col("h.level").alias("level"), F.col("h.label").alias("label"), document, "page_no", "domain_keywords"
    ).filter(F.col("label") != "")
    # Combined rows, written down once, feed the counts and the keywords alike; otherwise each reads and derives all chunks.
    cells = checkpoint(rows.groupBy("level", "label", document, "page_no", "domain_keywords").agg(F.count("*").alias("n")))
    pages = cells.groupBy("level", "label", document, "page_no").agg(F.sum("n").alias("n"))
    documents = pages.groupBy("level", "label", document).agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    counted = documents.groupBy("level", "label").agg(
        F.sum("n").cast("bigint").alias("chunk_count"), F.count("*").cast("bigint").alias("document_count"),
        F.sum("pages").cast("bigint").alias("page_count"),
    )
    order = Window.partitionBy("level").orderBy(F.desc("chunk_count"), "label")
    kept = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TREE_LIMIT)
    words = explode_rows(cells, ["level", "label", "n"], F.split("domain_keywords", "[,;\\s]+"), "word").filter("word <> ''")
    keywords = top_words(words, ["level", "label"], "word", TREE_KEYWORDS, "top_keywords", F.col("n"))
    return kept.join(keywords, ["level", "label"], "left").select(
        "level", "label", "chunk_count", "document_count", "page_count", text_or_empty("top_keywords").alias("top_keywords")
    )


def validation_counts(chunks: DataFrame, documents: DataFrame, index_version: str) -> DataFrame:
    """A5: every scalar check in one pass over the chunk table."""
    confidence = F.coalesce("heading_classification_confidence", F.lit(0.0))
    tagged = lambda word: F.contains(text_or_empty("domain_keywords"), F.lit(word))
    checks = {
        "chunks_with_heading_metadata": ~is_blank("chapter_title") & ~is_blank("heading_path") & ~is_blank("heading_norm"),
        "missing_chapter_title": is_blank("chapter_title"),
        "missing_heading_path": is_blank("heading_path"),
        "canonical_chapter_missing_count": is_blank("canonical_chapter_title"),
        "canonical_section_missing_count": is_blank("canonical_section_title"),
        "canonical_heading_path_missing_count": is_blank("canonical_heading_path"),
        "heading_classification_low_confidence_count": (confidence > 0) & (confidence < LOW_CONFIDENCE),
        "table_chunk_count": ~is_blank("table_type"),
        "staff_chunk_count": (F.col("table_type") == "staff") | tagged("STAFF"),
        "cost_chunk_count": (F.col("table_type") == "cost") | tagged("CLOUD_COST"),
        "vector_missing_chunk_count": is_blank("embedding_id"),
        "missing_normalized_heading_path": is_blank("normalized_heading_path"),
        "missing_heading_norm": is_blank("heading_norm"),
        "other_chunks": F.col("chapter_title") == DEFAULT_CHAPTER,
        "index_version_mismatch_chunks": text_or_empty("index_version") != index_version,
    }
    counted = chunks.agg(
        F.count("*").cast("bigint").alias("chunks"), F.countDistinct(chapter_label()).cast("bigint").alias("distinct_chapters"),
        *[F.count_if(test).cast("bigint").alias(name) for name, test in checks.items()],
    )
    total = documents.agg(F.count("*").cast("bigint")).scalar()
    ready = (
        (F.col("chunks") > 0) & (F.col("chunks_with_heading_metadata") == F.col("chunks"))
        & (F.col("missing_chapter_title") == 0) & (F.col("missing_heading_path") == 0)
        & (F.col("missing_normalized_heading_path") == 0) & (F.col("missing_heading_norm") == 0)
        & (F.col("index_version_mismatch_chunks") == 0)
    )
    return counted.withColumns({"documents": total, "metadata_ready": ready}).withColumn(
        "reindex_required", ~F.col("metadata_ready")
    )


def low_confidence_examples(chunks: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """A5: doubtful headings to look at."""
    confidence = F.coalesce("heading_classification_confidence", F.lit(0.0))
    return chunks.filter((confidence > 0) & (confidence < LOW_CONFIDENCE)).select(
        "document_id", "page_no", "raw_heading_path", "canonical_heading_path", "heading_classification_confidence",
        "heading_classification_reason",
    ).orderBy("document_id", "page_no").limit(limit)


def distribution(chunks: DataFrame, label: Column, document: str = "document_id", limit: int = DISTRIBUTION_LIMIT) -> DataFrame:
    """Labels by number of chunks."""
    counted = label_counts(chunks.withColumn("label", label), ["label"], document, "page_no")
    return counted.select("label", "chunk_count", "document_count").orderBy(F.desc("chunk_count"), "label").limit(limit)


def document_area() -> Column:
    """Canonical path, else path, else chapter and section, else the unknown mark."""
    pair = F.concat_ws(
        " > ", F.nullif(first_filled("canonical_chapter_title", "chapter_title"), F.lit("")),
        F.nullif(text_or_empty("section_title"), F.lit("")),
    )
    return first_filled("canonical_heading_path", "heading_path", pair, F.lit(UNKNOWN))


def _result_words(results: DataFrame, keep: list[str]) -> DataFrame:
    words = F.concat("matched_keywords", F.transform(F.split(text_or_empty("domain_keywords"), ","), lambda w: F.trim(w)))
    return explode_rows(results, keep, words, "word").filter(F.col("word") != "")


def result_metrics(results: DataFrame, query: str = "query_id", document: str = "document_id") -> DataFrame:
    """A10: per query: documents, pages, best score, commonest area, top five keywords."""
    rows = results.withColumn("area", document_area())
    totals = label_counts(rows, [query], document, "page_no").select(query, "document_count", "page_count")
    best = rows.groupBy(query).agg(F.round(F.max("score"), 6).alias("max_score"))
    areas = rows.groupBy(query, "area").agg(F.count("*").alias("uses"))
    top_area = top_rows_per(areas, query, "uses", "area", 1).select(query, F.col("area").alias("top_area"))
    words = top_words(_result_words(rows, [query]), [query], "word", TREE_KEYWORDS, "top_keywords")
    return totals.join(best, query).join(top_area, query).join(words, query, "left").withColumn(
        "top_keywords", first_filled("top_keywords", F.lit(UNKNOWN))
    )


def area_distribution(results: DataFrame, query: str = "query_id", document: str = "document_id") -> DataFrame:
    """Per query and document area: documents, pages, chunks, top six keywords."""
    rows = results.withColumn("area", document_area())
    counted = label_counts(rows, [query, "area"], document, "page_no").drop("first_page", "last_page")
    words = top_words(_result_words(rows, [query, "area"]), [query, "area"], "word", AREA_KEYWORDS, "top_keywords")
    return counted.join(words, [query, "area"], "left").withColumn("top_keywords", text_or_empty("top_keywords"))


def document_groups(results: DataFrame, query: str = "query_id", document: str = "document_id", key: str = "chunk_id") -> DataFrame:
    """Results gathered per document, best document first."""
    grouped = results.groupBy(query, document).agg(
        F.max("score").alias("best_score"), F.count("*").cast("bigint").alias("hits"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))), lambda x: x["k"]), ","
        ).alias("keys"),
    )
    order = Window.partitionBy(query).orderBy(F.desc("best_score"), F.asc(document))
    return grouped.withColumn("rank", F.row_number().over(order).cast("bigint"))
